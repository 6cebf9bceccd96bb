"""Keyed storage semantics over DataFrames: upserts, tiers, shards, and the byte-bounded LRU."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import scalars as S
from logweave.operators.replay import Flushes, Fold, Lru, replay


def upsert(stored: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """Stored entries with incoming ones in their place or added. ``incoming`` has one row a key."""
    new = incoming.select(key, F.struct(value).alias("_new"))
    joined = stored.select(key, F.struct(value).alias("_old")).join(new, key, "full_outer")
    return joined.select(key, F.coalesce("_new", "_old")[value].alias(value))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """key, value (JSON text) of {"key":…,"value":…} lines; blank lines and malformed envelopes go, other columns stay."""
    text = F.rtrim(F.col(line))
    cut = F.instr(text, ',"value":')
    token = F.substring(text, F.lit(8), cut - 8)
    keep = [c for c in lines.columns if c != line]
    shaped = lines.where(text.startswith('{"key":"') & text.endswith("}") & (cut > 0))
    out = shaped.select(*keep, token.alias("raw"), F.get_json_object(F.concat(F.lit('{"k":'), token, F.lit("}")), "$.k").alias("key"), F.substring(text, cut + 9, F.length(text) - cut - 9).alias("value"))
    return out.where(F.col("key").isNotNull() & F.col("raw").endswith('"'))


def sound_prefix(entries: DataFrame, raw: str = "raw", number: str = "line_no", run: int = 1 << 16) -> DataFrame:
    """Stored entries up to the first whose raw key doesn't exceed its predecessor's; what follows is given up.

    Neighbours are compared within runs of line numbers; only the first and last keys of the runs meet in one place.
    """
    marked = entries.withColumn("_run", F.floor(F.col(number) / run))
    inner = Window.partitionBy("_run").orderBy(number)
    within = marked.withColumn("_prev", F.lag(raw).over(inner)).where(F.col(raw) <= F.col("_prev")).agg(F.min(number).alias("cut"))
    edges = marked.groupBy("_run").agg(F.min(number).alias("at"), F.min_by(raw, number).alias("head"), F.max_by(raw, number).alias("tail"))
    between = edges.withColumn("_prev", F.lag("tail").over(Window.orderBy("_run"))).where(F.col("head") <= F.col("_prev")).agg(F.min("at").alias("cut"))
    cut = within.unionByName(between).agg(F.min("cut")).first()[0]
    return entries if cut is None else entries.where(F.col(number) < cut)


def merge_lines(stored: DataFrame, pending: DataFrame) -> DataFrame:
    """raw, key, value: the sound stored entries with pending ones (raw, key, value, seq) over them, last pending write first."""
    last = pending.groupBy("raw").agg(F.max_by(F.struct("key", "value"), "seq").alias("p")).select("raw", "p.key", "p.value")
    kept = sound_prefix(stored).select("raw", "key", "value").join(last.select("raw"), "raw", "left_anti")
    return kept.unionByName(last)


def tiered(keys: DataFrame, tiers: list[DataFrame], key: str, value: str) -> DataFrame:
    """key, value and tier (from 1; null: nowhere) of the first tier that has each key."""
    out = keys
    for i, tier in enumerate(tiers, 1):
        out = out.join(tier.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    found = [F.when(F.col(f"_v{i}").isNotNull(), F.lit(i)) for i in range(1, len(tiers) + 1)]
    return out.select(key, F.coalesce(*[F.col(f"_v{i}") for i in range(1, len(tiers) + 1)]).alias(value), F.coalesce(*found).alias("tier"))


def to_shards(values: DataFrame, key: str, value: str, most: int, write_id: str | Column, expires_at: Column | None = None) -> DataFrame:
    """key, shard_no, n_shards, payload: base64 text in pieces that fit ``most`` bytes with their write id (one, or one for each row), and expires_at if given."""
    room = most - 17
    if room < 1:
        raise ValueError("a shard must hold more than its write id")
    text = F.base64(F.col(value))
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / room)).cast("int")
    write = F.lit(write_id) if isinstance(write_id, str) else write_id
    expiry = [] if expires_at is None else [expires_at.alias("expires_at")]
    rows = values.select(key, *expiry, write.alias("_w"), text.alias("_t"), n.alias("n_shards"), F.explode(F.sequence(F.lit(0), n - 1)).alias("shard_no"))
    return rows.select(key, *(["expires_at"] if expiry else []), "shard_no", "n_shards", F.concat("_w", F.lit("|"), F.substring(F.col("_t"), F.col("shard_no") * room + 1, F.lit(room))).alias("payload"))


def from_shards(shards: DataFrame, key: str, value: str, now: int | None = None) -> DataFrame:
    """The values whose shards are all there and of one write; others are null. What has expired by ``now`` isn't there."""
    if now is not None:
        shards = shards.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    part = shards.withColumn("_p", S.write_id(F.col("payload")))
    agg = part.groupBy(key).agg(F.max("n_shards").alias("n"), F.countDistinct("shard_no").alias("have"), F.countDistinct("_p.id").alias("ids"), F.array_sort(F.collect_list(F.struct("shard_no", F.col("_p.body").alias("body")))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["body"]), "")
    return agg.select(key, F.when((F.col("have") == F.col("n")) & (F.col("ids") == 1), F.unbase64(text)).alias(value))


def fold(records: DataFrame, group: str, order: str, value: str, reducer: Callable, start, name: str, kind: str) -> DataFrame:
    """The fold of each group's values in order, as a stream: no group is held as a whole. An associative reducer belongs in agg()."""
    return replay(records.select(group, order, value), group, [order], lambda: Fold(reducer, start, value), f"{name} {kind}")


def lru(ops: DataFrame, budget: int, cache: str = "cache_id") -> DataFrame:
    """seq, hit and bytes after each operation of each cache's log (cache, seq, op: get/set/delete, key, bytes)."""
    return replay(ops.select(cache, "seq", "op", "key", "bytes"), cache, ["seq"], lambda: Lru(budget), "seq long, hit boolean, cached_bytes long")


def lru_keys(ops: DataFrame, budget: int, cache: str = "cache_id", order: str = "at") -> DataFrame:
    """The keys that each cache holds at the end of its log."""
    log = ops.select(cache, F.col(f"{order}.*"), "op", F.col("key").alias("_key"), "bytes").drop("key").withColumnRenamed("_key", "key")
    return replay(log, cache, [*[f for f in ops.select(f"{order}.*").columns if f != "key"], "key"], lambda: Lru(budget, keys_only=True), "key string")


def flush_ids(upserts: DataFrame, threshold: int, group: str, order: str, size: str) -> DataFrame:
    """The flush that each buffered write falls into: a flush starts once the bytes since the last one reach ``threshold``."""
    rest = [c for c in upserts.columns if c != group]
    kinds = dict(upserts.dtypes)
    return replay(upserts, group, [order], lambda: Flushes(threshold, size, rest), ", ".join(f"{c} {kinds[c]}" for c in rest) + ", flush_id long")
