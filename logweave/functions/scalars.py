"""Scalar kernels as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- text sizes and shards -------------------------------------------------


def utf8_bytes(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def shard_text(s: Column, most: int) -> Column:
    """Greedy pieces of at most ``most`` UTF-8 bytes that never split a code point; "" gives one empty piece.

    Code points get their byte offset from a running sum; the greedy cut is a fold over numbers alone, and
    text is sliced once per piece. A code point wider than ``most`` raises.
    """
    if most < 1:
        raise ValueError("a shard has at least one byte")
    sizes = F.transform(F.split(s, ""), F.octet_length)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("cuts"))

    def step(acc: Column, size: Column) -> Column:
        full = acc["n"] + size > most
        n = F.when(size > most, F.raise_error(F.lit("a code point is wider than a shard")).cast("int")).when(full, size).otherwise(acc["n"] + size)
        return F.struct(n.alias("n"), (acc["at"] + 1).alias("at"), F.when(full, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts"))

    cuts = F.aggregate(sizes, start, step, lambda a: a["cuts"])
    ends = F.concat(F.slice(cuts, 2, F.size(cuts)), F.array(F.length(s)))
    pieces = F.zip_with(cuts, ends, lambda a, b: F.substring(s, a + 1, b - a))
    return F.when(F.length(s) == 0, F.array(F.lit(""))).otherwise(pieces)


# --- 64-bit string hash ----------------------------------------------------

#: The multipliers and initial states of the public-domain cyrb hash.
STATE_1, STATE_2 = 0xDEADBEEF, 0x41C6CE57
MUL_1, MUL_2, MUL_3, MUL_4 = 2654435761, 1597334677, 2246822507, 3266489909
HASH_SEED = 777777
U32 = 0xFFFFFFFF


def _imul(a: Column, b: int) -> Column:
    """The low 32 bits of a product, in two halves so that no step leaves 64 bits."""
    high = (a * (b >> 16)).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (high + a * (b & 0xFFFF)).bitwiseAND(F.lit(U32))


def utf16_units(s: Column) -> Column:
    """UTF-16 code units as an array of long."""
    code = lambda c: F.ascii(c).cast("long")  # noqa: E731  the first code point
    pair = lambda v: F.array(F.lit(0xD800) + F.shiftright(v - 0x10000, 10), F.lit(0xDC00) + (v - 0x10000).bitwiseAND(F.lit(0x3FF)))
    units = F.flatten(F.transform(F.split(s, ""), lambda c: F.when(code(c) > 0xFFFF, pair(code(c))).otherwise(F.array(code(c)))))
    return F.when(F.length(s) == 0, F.array().cast("array<bigint>")).otherwise(units)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def cyrb64(s: Column, seed: int = 0) -> Column:
    """struct<h2, h1> of unsigned 32-bit values."""
    fold = lambda units, start, by: F.aggregate(units, F.lit(start ^ seed).cast("long"), lambda h, u: _imul(h.bitwiseXOR(u), by))
    shr = lambda x, n: x.bitwiseXOR(F.shiftrightunsigned(x, n))

    def final(p: Column) -> Column:
        h1 = _imul(shr(p["a"], 16), MUL_3).bitwiseXOR(_imul(shr(p["b"], 13), MUL_4))
        return _let(h1, lambda h: F.struct(_imul(shr(p["b"], 16), MUL_3).bitwiseXOR(_imul(shr(h, 13), MUL_4)).alias("h2"), h.alias("h1")))

    states = _let(utf16_units(s), lambda u: F.struct(fold(u, STATE_1, MUL_1).alias("a"), fold(u, STATE_2, MUL_2).alias("b")))
    return _let(states, final)


def padding(bits: int, radix: int) -> int:
    """The least k for which radix ** k >= 2 ** bits."""
    if not (isinstance(bits, int) and 1 <= bits <= 52 and isinstance(radix, int) and 2 <= radix <= 36):
        raise ValueError("bits are 1 to 52 and the radix is 2 to 36")
    return next(k for k in range(1, 54) if radix**k >= 1 << bits)


def padding_width(bits: Column, radix: Column) -> Column:
    """padding() of columns: the powers are doubles, exact wherever they decide."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(53)), lambda k: F.pow(radix.cast("double"), k) >= F.pow(F.lit(2.0), bits))
    return F.element_at(fits, 1).cast("long")


def cyrb64_hash(s: Column, radix: int = 36, seed: int = HASH_SEED) -> Column:
    """Both halves in ``radix``, padded: 14 characters at radix 36."""
    width = padding(32, radix)
    part = lambda h: F.lpad(F.lower(F.conv(h.cast("string"), 10, radix)), width, "0")
    return _let(cyrb64(s, seed), lambda p: F.concat(part(p["h2"]), part(p["h1"])))


# --- keys ------------------------------------------------------------------


def filter_text(address: Column, topics: Column) -> Column:
    """"addresses:topics": sorted lower-case addresses with commas or "*", topics as JSON with sorted alternatives or "*". ``topics`` is an array of arrays; a null position is null."""
    addresses = F.coalesce(F.array_join(F.array_sort(F.transform(address, F.lower)), ","), F.lit("*"))
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    one = lambda ts: F.when(ts.isNull(), F.lit("null")).when(F.size(ts) == 1, quoted(ts[0])).otherwise(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(ts), quoted), ","), F.lit("]")))
    return F.concat(addresses, F.lit(":"), F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(topics, one), ","), F.lit("]")), F.lit("*")))


def cache_key(chain: Column, filter_: Column, low: Column, high: Column) -> Column:
    return F.concat(chain.cast("string"), F.lit(":ethGetLogs:"), cyrb64_hash(filter_), F.lit("+"), low.cast("string"), F.lit(":"), high.cast("string"))


def split_key(key: Column, separator: str = "+") -> Column:
    """struct<group, rest>; a key without the separator raises."""
    missing = F.instr(key, separator) == 0
    part = lambda i: F.split_part(key, F.lit(separator), F.lit(i))
    return F.struct(F.when(missing, F.raise_error(F.concat(F.lit("no separator in key "), key))).otherwise(part(1)).alias("group"), part(2).alias("rest"))


# --- sizes of values as JSON text -----------------------------------------


def estimate_bytes(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value as JSON, without escapes: what a size limit compares with. Null counts four."""
    if isinstance(kind, T.StringType):
        size = F.octet_length(c) + 2
    elif isinstance(kind, T.BooleanType):
        size = F.when(c, 4).otherwise(5)
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        size = F.length(c.cast("string"))
    elif isinstance(kind, (T.LongType, T.DecimalType)):  # big integers travel as {"__bigint__":"n"}
        size = F.length(c.cast("string")) + 17
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        plain = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
        size = F.when(finite, F.length(plain)).otherwise(4)
    elif isinstance(kind, T.ArrayType):
        inner = F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(estimate_bytes(x, kind.elementType), F.lit(4)).cast("int"))
        size = inner + 2 + F.greatest(F.size(c) - 1, F.lit(0))
    elif isinstance(kind, T.MapType):
        size = estimate_bytes(F.map_values(c), T.ArrayType(kind.valueType)) + F.aggregate(F.map_keys(c), F.lit(0), lambda a, k: a + F.octet_length(k) + 3)
    elif isinstance(kind, T.StructType):
        parts = [estimate_bytes(c[f.name], f.dataType) + len(f.name.encode()) + 3 for f in kind.fields]
        size = reduce(lambda a, b: a + b, parts, F.lit(2 + max(0, len(parts) - 1)))
    else:
        raise TypeError(f"no size rule for {kind.simpleString()}")
    return F.coalesce(size.cast("long"), F.lit(4).cast("long"))


def node_log(block: str = "block_number") -> Column:
    """A log as a node returns it: the object whose size limits hold."""
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(F.col(c))))
    return F.struct("address", "topics", "data", hexed(block).alias("blockNumber"), F.col("tx_hash").alias("transactionHash"), hexed("tx_index").alias("transactionIndex"), F.col("block_hash").alias("blockHash"), hexed("log_index").alias("logIndex"), "removed")


NODE_LOG_TYPE = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "topics" else T.BooleanType() if n == "removed" else T.StringType()) for n in ("address", "topics", "data", "blockNumber", "transactionHash", "transactionIndex", "blockHash", "logIndex", "removed")])


def big_json(number: Column) -> Column:
    """A big integer as it travels in JSON: an object with its digits."""
    return F.struct(number.cast("string").alias("__bigint__"))


# --- trees and requests ----------------------------------------------------


def lower_hex(x: Column) -> Column:
    return F.when(F.substring(x, 1, 2) == "0x", F.lower(x)).otherwise(x)


def transform_tree(tree: Column, key=None, leaf=None, include=None) -> Column:
    """A map with sorted keys: keys and leaves transformed, entries kept where ``include(key, value)`` holds."""
    out = F.transform_keys(tree, lambda k, v: key(k)) if key else tree
    out = F.transform_values(out, lambda k, v: leaf(v)) if leaf else out
    out = F.map_filter(out, include) if include else out
    return F.map_from_entries(F.array_sort(F.map_entries(out)))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def _one_or_more(xs: Column) -> Column:
    """A set as JSON: one element stands alone, of none there is none."""
    low = F.transform(xs, lambda x: _quoted(lower_hex(x)))
    return F.when(F.size(xs) == 1, low[0]).when(F.size(xs) > 1, F.concat(F.lit("["), F.array_join(low, ","), F.lit("]")))


def canonical_address(addresses: Column) -> Column:
    """An address set in canonical form, null if it is empty or absent."""
    return F.when(F.size(addresses) > 0, F.when(F.size(addresses) == 1, _quoted(lower_hex(addresses[0]))).otherwise(_one_or_more(addresses)))


def canonical_topics(topics: Column) -> Column:
    """Topics by position in canonical form, null if every position is open."""
    each = F.transform(topics, lambda ts: F.coalesce(_one_or_more(ts), F.lit("null")))
    return F.when(F.exists(each, lambda x: x != "null"), F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))


# --- freshness -------------------------------------------------------------

DAY_MS = 24 * 60 * 60 * 1000


def simple_invalidation(confirmations: Column, age_ms: Column, chunks: Column, min_age_ms: int = 5_000, max_age_days: float = 31, hot_blocks: int = 128, average: float = 0.001) -> Column:
    """The chance to refetch: none for the young, certain near the tip, else from average/chunks up to one at the greatest age."""
    first = F.least(F.lit(1.0), F.lit(float(average)) / chunks)
    grown = F.least(F.lit(1.0), first * F.exp(-F.log(first) / max_age_days * (age_ms / DAY_MS))) if average else F.lit(0.0)
    return F.when(age_ms < min_age_ms, 0.0).when(confirmations < hot_blocks, 1.0).otherwise(grown)


def exponential_invalidation(confirmations: Column, age_ms: Column, alpha_age: float = 1 / 8, max_age_days: float = 31, alpha_blocks: float = 1 / 64, scale_blocks: float = 7 / 8) -> Column:
    """An age term that reaches one at the greatest age plus a term that falls with confirmations, clamped to [0, 1]."""
    floor = F.exp(F.lit(-alpha_age * max_age_days))
    age = (F.exp((age_ms / DAY_MS - max_age_days) * alpha_age) - floor) / (F.lit(1.0) - floor)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), age + F.exp(confirmations * -alpha_blocks) * scale_blocks))


# --- errors ----------------------------------------------------------------

#: Codes and messages by which sources say that a range was too wide.
RANGE_CODES = (-32602, -32005, -32012, -32000)
RANGE_MESSAGES = (r"range.*exceed", r"range.*too", r"exceed.*block", r"max.*block", r"blocks", r"returned more than", r"response size")


def is_range_error(code: Column, message: Column) -> Column:
    said = message.rlike("(?i)" + "|".join(RANGE_MESSAGES))
    return F.coalesce(code.isin(*RANGE_CODES), F.lit(False)) | F.coalesce(said, F.lit(False))


def says_range_error(code: int | None, message: str) -> bool:
    """is_range_error() of one error, on the driver."""
    return code in RANGE_CODES or bool(re.search("|".join(RANGE_MESSAGES), message, re.I))


# --- interchange -----------------------------------------------------------


def raw_key(key: Column) -> Column:
    """The key as a JSON token, by which stored entries sort."""
    text = F.to_json(F.array(key))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def write_id(payload: Column) -> Column:
    """struct<id, body>: a 16-digit hex id before "|" or, in older payloads, a zero id."""
    ok = payload.rlike(r"^[0-9A-Fa-f]{16}\|")
    return F.struct(F.when(ok, F.substring(payload, 1, 16)).otherwise(F.lit("0" * 16)).alias("id"), F.when(ok, F.substring(payload, 18, 1 << 30)).otherwise(payload).alias("body"))
