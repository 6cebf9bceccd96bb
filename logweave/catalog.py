"""Named queries over the operators of this engine, each with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions import scalars as S
from logweave.model import EVENT_LOGS_SQL, LogFilter, event_logs
from logweave.operators import bins as B
from logweave.operators import kv, sched
from logweave.operators import ranges as R
from logweave.operators.stores import OPTIMISED, CodedStore, LogStore, TieredStore, optimised
from logweave.plans.query import CachedQuery, DividedQuery, size_sieve
from logweave.shared import fresh_path
from logweave.sources import files
from logweave.sources.bins import BinStore
from logweave.sources.logs import EventSource, NarrowSource, SievedSource, layered

#: Blocks in a bin of the views below, whose blocks hold four logs.
BIN = 50
LOG = ["address", "block_number", "block_hash", "log_index", "tx_hash", "data"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ranges(spark: SparkSession, *rows: tuple[int, int]) -> DataFrame:
    return spark.createDataFrame(list(rows), "from_block long, to_block long")


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range for each order: its customer's number of blocks from its key on."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 97).alias("lane"), (F.col("o_orderkey") * 7).alias("from_block"), (F.col("o_orderkey") * 7 + F.col("o_custkey") % 11).alias("to_block"))


ORDER_RANGES = "r AS (SELECT o_custkey % 97 AS lane, o_orderkey * 7 AS from_block, o_orderkey * 7 + o_custkey % 11 AS to_block FROM orders)"


# --- scans -------------------------------------------------------------------


@query(f"WITH {EVENT_LOGS_SQL} SELECT address, block_number, block_hash, log_index, tx_hash, data FROM logs WHERE topic0 = 'error' AND block_number BETWEEN 100 AND 2000")
def range_scan(spark, sf_dir):
    query = DividedQuery(LogFilter(topics=(("error",),), from_block=100, to_block=2000), max_range=BIN, align=BIN)
    return query.execute(EventSource(spark, sf_dir)).select(*LOG)


@query(f"WITH {EVENT_LOGS_SQL} SELECT address, block_number, block_hash, log_index, tx_hash, data FROM logs WHERE topic0 IN ('click', 'view') AND address IN ('0x' || lpad('7', 40, '0'), '0x' || lpad('8', 40, '0'))")
def address_topic_scan(spark, sf_dir):
    wanted = LogFilter(addresses=tuple("0x" + n.rjust(40, "0") for n in "78"), topics=(("CLICK", "view"),))
    return DividedQuery(wanted).execute(EventSource(spark, sf_dir)).select(*LOG)


@query(f"WITH {EVENT_LOGS_SQL}, tip AS (SELECT max(block_number) AS tip FROM logs) SELECT address, block_number, block_hash, log_index, tx_hash, data FROM logs, tip WHERE block_number BETWEEN tip - 10 AND least(tip + 1000, tip)")
def tip_clamp(spark, sf_dir):
    source = EventSource(spark, sf_dir)
    tip = source.tip()
    return DividedQuery(LogFilter(from_block=tip - 10, to_block=tip + 1000)).execute(source, tip).select(*LOG)


@query(f"WITH {EVENT_LOGS_SQL} SELECT address, block_number, block_hash, log_index, tx_hash, data FROM logs WHERE block_hash = '0x' || lpad('42', 64, '0')")
def point_by_hash(spark, sf_dir):
    return DividedQuery(LogFilter(block_hash="0x" + "42".rjust(64, "0"))).execute(EventSource(spark, sf_dir)).select(*LOG)


# --- ranges --------------------------------------------------------------------


@query(
    f"WITH {ORDER_RANGES}, a AS (SELECT lane, from_block // 10 * 10 AS s, to_block // 10 * 10 + 9 AS e FROM r), c AS (SELECT lane, s, e, unnest(range(0, (e - s) // 4 + 1)) AS chunk_index FROM a) "
    "SELECT lane, chunk_index, s + 4 * chunk_index AS from_block, least(s + 4 * chunk_index + 3, e) AS to_block FROM c"
)
def divide_aligned(spark, sf_dir):
    return R.divide(order_ranges(spark, sf_dir), 4, 10)


MERGE_SQL = (
    "m AS (SELECT lane, from_block, to_block, CASE WHEN from_block <= max(to_block) OVER (PARTITION BY lane ORDER BY from_block, to_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM w), "
    "i AS (SELECT lane, from_block, to_block, sum(n) OVER (PARTITION BY lane ORDER BY from_block, to_block ROWS UNBOUNDED PRECEDING) AS island FROM m)"
)


@query(f"WITH {ORDER_RANGES}, w AS (SELECT lane % 7 AS lane, from_block, to_block FROM r), {MERGE_SQL} SELECT lane, min(from_block) AS from_block, max(to_block) AS to_block FROM i GROUP BY lane, island")
def merge_ranges(spark, sf_dir):
    return R.merge(order_ranges(spark, sf_dir).withColumn("lane", F.col("lane") % 7), ["lane"])


@query(
    f"WITH {ORDER_RANGES}, h AS (SELECT lane, from_block, to_block, from_block + (to_block - from_block + 1) // 2 - 1 AS mid FROM r WHERE from_block < to_block) "
    "SELECT lane, 0::BIGINT AS half, from_block, mid AS to_block FROM h UNION ALL SELECT lane, 1, mid + 1, to_block FROM h"
)
def halve_once(spark, sf_dir):
    return R.halve(order_ranges(spark, sf_dir))


def event_counts(spark, sf_dir):
    """Logs of each block of a skewed view: a user's number of logs in the user's block."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") * 3).alias("block_number")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH RECURSIVE c AS (SELECT user_id * 3 AS b, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(b) AS top FROM c),
    t(f, t, d, n) AS (
      SELECT CAST(0 AS BIGINT), CAST(top AS BIGINT), CAST(0 AS BIGINT), CAST((SELECT sum(n) FROM c) AS BIGINT) FROM m
      UNION ALL
      SELECT x.f, x.t, x.d, CAST(coalesce((SELECT sum(c.n) FROM c WHERE c.b BETWEEN x.f AND x.t), 0) AS BIGINT) FROM (
        SELECT CASE WHEN h = 0 THEN f ELSE f + (t - f + 1) // 2 END AS f, CASE WHEN h = 0 THEN f + (t - f + 1) // 2 - 1 ELSE t END AS t, d + 1 AS d
        FROM t, (VALUES (0), (1)) v(h) WHERE n > 300 AND f < t) x
    ) SELECT f AS from_block, t AS to_block, d AS depth, n AS n_rows, n <= 300 AS accepted FROM t WHERE n <= 300 OR f = t"""
)
def adaptive_bisect(spark, sf_dir):
    counts = event_counts(spark, sf_dir)
    return R.bisect(counts, 0, counts.agg(F.max("block_number")).first()[0], 300)


@query("WITH t AS (SELECT user_id, arg_max(event_type <> 'signup', event_id) AS at_tip, min(CASE WHEN event_type <> 'signup' AND event_id >= 10 THEN event_id END) AS first FROM events GROUP BY user_id) SELECT user_id, coalesce(CASE WHEN at_tip THEN first END, -1) AS deploy_block FROM t")
def deploy_block(spark, sf_dir):
    """-1: no code at the tip."""
    probes = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("block_number"), (F.col("event_type") != "signup").alias("has_code"))
    return R.boundary(probes, "user_id", 10, (1 << 62)).fillna(-1, ["deploy_block"])


@query(
    """WITH RECURSIVE h AS (SELECT max(event_id) AS hi FROM events), e AS (SELECT user_id, event_id, event_type <> 'signup' AS c FROM events),
    t(user_id, lo, hi, x) AS (
      SELECT user_id, CAST(10 AS BIGINT), any_value(h.hi), CAST(NULL AS BIGINT) FROM e, h GROUP BY user_id
      UNION ALL
      SELECT user_id, CASE WHEN c THEN lo ELSE mid + 1 END, CASE WHEN c THEN mid - 1 ELSE hi END, CASE WHEN c THEN mid ELSE x END FROM (
        SELECT t.user_id, t.lo, t.hi, t.x, (t.lo + t.hi) // 2 AS mid, coalesce((SELECT arg_max(e.c, e.event_id) FROM e WHERE e.user_id = t.user_id AND e.event_id <= (t.lo + t.hi) // 2), false) AS c FROM t WHERE t.lo <= t.hi)
    ), tip AS (SELECT user_id, arg_max(c, event_id) AS c FROM e GROUP BY user_id)
    SELECT t.user_id, CASE WHEN tip.c THEN x END AS deploy_block FROM t JOIN tip ON t.user_id = tip.user_id WHERE t.lo > t.hi"""
)
def boundary_search(spark, sf_dir):
    """The binary search where code comes and goes."""
    probes = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("block_number"), (F.col("event_type") != "signup").alias("has_code"))
    return R.boundary_search(probes, "user_id", 10, probes.agg(F.max("block_number")).first()[0])


# --- bins ------------------------------------------------------------------------


def responses(spark, sf_dir):
    """A response for every order; some overlap, some leave holes."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") * 5
    return o.select(start.alias("from_block"), (start + F.col("o_custkey") % 9).alias("to_block"), (F.col("o_orderkey") + 1000).alias("fetched_at"), (F.col("o_orderkey") + F.col("o_custkey")).alias("fetched_at_block"))


RESPONSES = "p AS (SELECT o_orderkey * 5 AS f, o_orderkey * 5 + o_custkey % 9 AS t, o_orderkey + 1000 AS fetched_at, o_orderkey + o_custkey AS fetched_at_block FROM orders)"
PARTS = "q AS (SELECT f, t, fetched_at, fetched_at_block, unnest(range(f // 20 * 20, t // 20 * 20 + 1, 20)) AS bin_start FROM p), w AS (SELECT bin_start AS lane, greatest(f, bin_start) AS from_block, least(t, bin_start + 19) AS to_block, fetched_at, fetched_at_block FROM q)"


@query(f"WITH {RESPONSES}, {PARTS} SELECT lane AS bin_start, from_block AS covered_from, to_block AS covered_to, fetched_at, fetched_at_block FROM w")
def bin_assign(spark, sf_dir):
    return B.fan_out(responses(spark, sf_dir), 20)


@query(
    f"WITH {RESPONSES}, {PARTS}, {MERGE_SQL}, g AS (SELECT lane, island, min(from_block) AS a, max(to_block) AS b FROM i GROUP BY 1, 2), "
    "d AS (SELECT lane FROM g GROUP BY lane HAVING count(*) = 1 AND min(a) <= lane AND max(b) >= lane + 19) "
    "SELECT lane AS bin_start, lane + 19 AS bin_end, max(fetched_at) AS fetched_at, max(fetched_at_block) AS fetched_at_block FROM w WHERE lane IN (SELECT lane FROM d) GROUP BY lane"
)
def bin_complete(spark, sf_dir):
    return B.complete_bins(responses(spark, sf_dir), 20)


@query(f"WITH {RESPONSES}, {PARTS}, {MERGE_SQL} SELECT lane AS bin_start, count(DISTINCT island) AS n_ranges, min(from_block) AS first_block, max(to_block) AS last_block FROM i GROUP BY lane")
def bin_coverage(spark, sf_dir):
    parts = B.fan_out(responses(spark, sf_dir), 20)
    merged = R.merge(parts.select("bin_start", F.col("covered_from").alias("from_block"), F.col("covered_to").alias("to_block")), ["bin_start"])
    return merged.groupBy("bin_start").agg(F.count(F.lit(1)).alias("n_ranges"), F.min("from_block").alias("first_block"), F.max("to_block").alias("last_block"))


ITEM_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(ITEM_ORDER)}) = 1")
def dedupe_first(spark, sf_dir):
    return B.first_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ITEM_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def manifest(spark, sf_dir):
    """Every third bin is stored; every ninth ends early."""
    logs = event_logs(spark, sf_dir)
    starts = logs.select(R.align_down(F.col("block_number"), BIN).alias("bin_start")).distinct().where(F.col("bin_start") % (3 * BIN) == 0)
    return starts.select("bin_start", (F.col("bin_start") + BIN - 1 - F.when(F.col("bin_start") % (9 * BIN) == 0, 1).otherwise(0)).alias("fetched_to"), F.lit(0).cast("long").alias("fetched_at"), (F.col("bin_start") + 1000).alias("fetched_at_block"))


MANIFEST = f"man AS (SELECT DISTINCT block_number // {BIN} * {BIN} AS bin_start FROM logs WHERE block_number // {BIN} * {BIN} % {3 * BIN} = 0), hit AS (SELECT bin_start FROM man WHERE bin_start % {9 * BIN} <> 0 AND bin_start BETWEEN 100 // {BIN} * {BIN} AND 2000 // {BIN} * {BIN})"
WANTED = f"tip AS (SELECT least(2000, max(block_number)) AS hi FROM logs), wanted AS (SELECT unnest(range(100 // {BIN} * {BIN}, hi // {BIN} * {BIN} + 1, {BIN})) AS bin_start FROM tip)"
CACHED = CachedQuery(LogFilter(topics=(("error",),), from_block=100, to_block=2000), BIN)


@query(f"WITH {EVENT_LOGS_SQL}, {MANIFEST}, {WANTED} SELECT bin_start, bin_start + {BIN - 1} AS bin_end FROM wanted WHERE bin_start IN (SELECT bin_start FROM hit)")
def cache_hits(spark, sf_dir):
    return CACHED.plan(manifest(spark, sf_dir), EventSource(spark, sf_dir).tip())[0]


@query(
    f"WITH {EVENT_LOGS_SQL}, {MANIFEST}, {WANTED}, w AS (SELECT 0 AS lane, bin_start AS from_block, bin_start + {BIN - 1} AS to_block FROM wanted WHERE bin_start NOT IN (SELECT bin_start FROM hit)), {MERGE_SQL} "
    "SELECT min(from_block) AS from_block, max(to_block) AS to_block FROM i GROUP BY island"
)
def cache_gaps(spark, sf_dir):
    return CACHED.plan(manifest(spark, sf_dir), EventSource(spark, sf_dir).tip())[1]


def earlier_bins(spark, sf_dir) -> BinStore:
    """A store with the bins of manifest()."""
    source, store = EventSource(spark, sf_dir), BinStore(spark, fresh_path(spark, "bins"))
    bins = manifest(spark, sf_dir)
    low, high = bins.agg(F.min("bin_start"), F.max("fetched_to")).first()
    logs = B.bin_logs(source.logs(LogFilter(topics=CACHED.filter.topics), [] if low is None else [(low, high)]), BIN)
    held = logs.join(bins.select("bin_start", "fetched_to"), "bin_start").where(F.col("block_number") <= F.col("fetched_to"))
    store.write(held.drop("fetched_to"), bins)
    return store


@query(SQL["range_scan"])
def cached_range_query(spark, sf_dir):
    """Every third bin was written before, some not to their end; the others are fetched, stored and read."""
    source, store = EventSource(spark, sf_dir), earlier_bins(spark, sf_dir)
    return CACHED.execute(source, store).select(*LOG)


# --- freshness -------------------------------------------------------------------


def ages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("event_id") % 700).alias("confirmations"), (F.col("event_id") * 300_000 % 3_000_000_000).alias("age_ms"), (F.col("event_id") % 9 + 1).alias("chunks"))


AGES = "g AS (SELECT event_id, event_id % 700 AS confirmations, event_id * 300000 % 3000000000 AS age_ms, event_id % 9 + 1 AS chunks FROM events)"


@query(
    f"WITH {AGES}, v AS (SELECT *, least(CAST(1 AS DOUBLE), CAST(0.001 AS DOUBLE) / chunks) AS p FROM g) SELECT event_id, round(CASE WHEN age_ms < 5000 THEN 0 WHEN confirmations < 128 THEN 1 "
    "ELSE least(CAST(1 AS DOUBLE), p * exp(-ln(p) / 31 * (age_ms / CAST(86400000 AS DOUBLE)))) END, 9) AS chance FROM v"
)
def invalidate_simple(spark, sf_dir):
    return ages(spark, sf_dir).select("event_id", F.round(S.simple_invalidation(F.col("confirmations"), F.col("age_ms"), F.col("chunks")), 9).alias("chance"))


@query(
    f"WITH {AGES} SELECT event_id, round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (exp(0.125::DOUBLE * (age_ms / CAST(86400000 AS DOUBLE) - 31)) - exp(-3.875::DOUBLE)) / (1 - exp(-3.875::DOUBLE)) "
    "+ 0.875::DOUBLE * exp(-confirmations / CAST(64 AS DOUBLE)))), 9) AS chance FROM g"
)
def invalidate_exp(spark, sf_dir):
    return ages(spark, sf_dir).select("event_id", F.round(S.exponential_invalidation(F.col("confirmations"), F.col("age_ms")), 9).alias("chance"))


# --- scalars -----------------------------------------------------------------------


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_points FROM documents")
def utf8_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.utf8_bytes(F.col("text")).alias("n_bytes"), F.length("text").cast("long").alias("n_points"))


NODE_SIZE = "(strlen(address) + 2 + strlen(topic0) + 4 + strlen(data) + 2 + (2 + strlen(to_hex(block_number))) + 2 + strlen(tx_hash) + 2 + 5 + strlen(block_hash) + 2 + 5 + 5 + 120)"


@query(f"WITH {EVENT_LOGS_SQL} SELECT tx_hash, CAST({NODE_SIZE} AS BIGINT) AS n_bytes FROM logs WHERE {NODE_SIZE} <= 416")
def size_sieve_logs(spark, sf_dir):
    kept = size_sieve(event_logs(spark, sf_dir), 416)
    return kept.select("tx_hash", S.estimate_bytes(S.node_log(), S.NODE_LOG_TYPE).alias("n_bytes"))


IMUL = "CAST((CAST({a} AS HUGEINT) * {b}) % 4294967296 AS BIGINT)"


def _cyrb_sql(text: str, source: str, keep: str) -> str:
    """The hash of ``text`` as hash, beside ``keep``, over BMP text."""
    fold = lambda start, by: f"list_reduce(list_prepend(CAST({start ^ S.HASH_SEED} AS BIGINT), list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda h, u: {IMUL.format(a='xor(h, u)', b=by)})"
    shr = lambda x, n: f"xor({x}, {x} >> {n})"
    return (
        f"f AS (SELECT {keep}, {fold(S.STATE_1, S.MUL_1)} AS a, {fold(S.STATE_2, S.MUL_2)} AS b FROM {source}), "
        f"f1 AS (SELECT *, xor({IMUL.format(a=shr('a', 16), b=S.MUL_3)}, {IMUL.format(a=shr('b', 13), b=S.MUL_4)}) AS h1 FROM f), "
        f"f2 AS (SELECT *, xor({IMUL.format(a=shr('b', 16), b=S.MUL_3)}, {IMUL.format(a=shr('h1', 13), b=S.MUL_4)}) AS h2 FROM f1), "
        f"hashed AS (SELECT {keep}, lower(to_base(h2, 36, 7)) || lower(to_base(h1, 36, 7)) AS hash FROM f2)"
    )


@query(f"WITH u AS (SELECT DISTINCT user_id, '0x' || lpad(CAST(user_id AS VARCHAR), 40, '0') AS address FROM events), {_cyrb_sql('address', 'u', 'user_id')} SELECT user_id, hash FROM hashed")
def cyrb64_hashes(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", S.cyrb64_hash(F.concat(F.lit("0x"), F.lpad(F.col("user_id").cast("string"), 40, "0"))).alias("hash"))


@query(
    "WITH u AS (SELECT DISTINCT user_id, event_type, '0x' || lpad(CAST(user_id AS VARCHAR), 40, '0') || ':[\"' || event_type || '\",null,[\"0xabc\",\"0xdef\"]]' AS t FROM events), "
    f"{_cyrb_sql('t', 'u', 'user_id, event_type')} SELECT user_id, event_type, '1:ethGetLogs:' || hash || '+' || CAST(user_id * 10000 AS VARCHAR) || ':' || CAST(user_id * 10000 + 9999 AS VARCHAR) AS cache_key FROM hashed"
)
def cache_keys(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    address = F.array(F.concat(F.lit("0x"), F.lpad(F.col("user_id").cast("string"), 40, "0")))
    topics = F.array(F.array("event_type"), F.lit(None).cast("array<string>"), F.array(F.lit("0xdef"), F.lit("0xabc")))
    low = F.col("user_id") * 10_000
    return users.select("user_id", "event_type", S.cache_key(F.lit(1), S.filter_text(address, topics), low, low + 9_999).alias("cache_key"))


@query(
    "WITH k AS (SELECT doc_id, '1:ethGetLogs:x' || CAST(doc_id % 7 AS VARCHAR) || '+' || CAST(doc_id AS VARCHAR) AS key FROM documents) SELECT split_part(key, '+', 1) AS key_group, count(*) AS n_keys, max(split_part(key, '+', 2)) AS last_rest FROM k GROUP BY 1"
)
def group_by_prefix(spark, sf_dir):
    key = F.concat(F.lit("1:ethGetLogs:x"), (F.col("doc_id") % 7).cast("string"), F.lit("+"), F.col("doc_id").cast("string"))
    parts = table(spark, sf_dir, "documents").select(S.split_key(key).alias("k"))
    return parts.groupBy(F.col("k.group").alias("key_group")).agg(F.count(F.lit(1)).alias("n_keys"), F.max("k.rest").alias("last_rest"))


@query(
    """WITH RECURSIVE t(item_id, place, n, largest) AS (
      SELECT item_id, CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM benchmark
      UNION ALL
      SELECT item_id, place + k, n + 1, greatest(largest, strlen(substr(text, place, k))) FROM (
        SELECT t.*, b.text, coalesce(list_max(list_filter(range(1, 49), lambda k: strlen(substr(b.text, t.place, k)) <= 48 AND t.place + k - 1 <= length(b.text))), 0) AS k FROM t JOIN benchmark b USING (item_id) WHERE t.place <= length(b.text))
    ) SELECT item_id, greatest(max(n), 1) AS n_shards, max(largest) AS largest, true AS joins_back FROM t GROUP BY item_id"""
)
def shard_greedy(spark, sf_dir):
    """Pieces of each question: number, bytes of the largest, and whether they join back."""
    text = F.col("text")
    pieces = table(spark, sf_dir, "benchmark").select("item_id", text.alias("text"), S.shard_text(text, 48).alias("s"))
    return pieces.select("item_id", F.size("s").cast("long").alias("n_shards"), F.array_max(F.transform("s", F.octet_length)).cast("long").alias("largest"), (F.array_join("s", "") == F.col("text")).alias("joins_back"))


@query(
    "WITH e AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN -32602 WHEN 1 THEN -32005 WHEN 2 THEN -32001 ELSE 3 END AS code, "
    "CASE event_id % 5 WHEN 0 THEN 'block Range is TOO wide' WHEN 1 THEN 'query returned more than 10000 results' WHEN 2 THEN 'nonce low' WHEN 3 THEN 'exceeds max block span' ELSE event_type END AS message FROM events) "
    "SELECT event_id, code IN (-32602, -32005, -32012, -32000) OR regexp_matches(message, '(?i)range.*exceed|range.*too|exceed.*block|max.*block|blocks|returned more than|response size') AS is_range FROM e"
)
def error_classify(spark, sf_dir):
    i = F.col("event_id")
    code = F.when(i % 8 == 0, -32602).when(i % 8 == 1, -32005).when(i % 8 == 2, -32001).otherwise(3)
    said = F.when(i % 5 == 0, "block Range is TOO wide").when(i % 5 == 1, "query returned more than 10000 results").when(i % 5 == 2, "nonce low").when(i % 5 == 3, "exceeds max block span").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", S.is_range_error(code, said).alias("is_range"))


# --- keyed storage -------------------------------------------------------------------


@query(
    "WITH s AS (SELECT c_custkey AS k, c_name AS v FROM customer), n AS (SELECT o_custkey + 100 AS k, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1) SELECT coalesce(n.k, s.k) AS k, coalesce(n.v, s.v) AS v FROM s FULL JOIN n ON s.k = n.k"
)
def upsert_merge(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = B.latest_per_key(table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("k"), "o_orderkey", F.col("o_orderpriority").alias("v")), "k", "o_orderkey", "v")
    return kv.upsert(stored, new, "k", "v")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'signup'")
def latest_per_key(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "signup", "delete").otherwise("set").alias("op"))
    return B.latest_per_key(changes, "user_id", "event_id", "value", "op")


@query(
    "WITH k AS (SELECT p_partkey AS k FROM part), a AS (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 5 = 0), b AS (SELECT s_suppkey AS k, s_name AS v FROM supplier) "
    "SELECT k.k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 ELSE 0 END AS tier FROM k LEFT JOIN a ON k.k = a.k LEFT JOIN b ON k.k = b.k"
)
def tiered_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keys = part.select(F.col("p_partkey").alias("k"))
    near = part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    far = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return kv.tiered(keys, [near, far], "k", "v").fillna(0, ["tier"])


@query("WITH k AS (SELECT DISTINCT c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' x' ELSE '' END AS key FROM customer) SELECT key, row_number() OVER (ORDER BY '\"' || key || '\"') AS position FROM k")
def rawkey_sort(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, " x").otherwise("")).alias("key")).distinct()
    return R.numbered(keys.withColumn("raw", S.raw_key(F.col("key"))), "raw", "position").drop("raw")


@query(
    "WITH e AS (SELECT event_id, event_type, 'k' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS key, props AS value FROM events), s AS (SELECT key, arg_max(value, event_id) AS value FROM e WHERE event_type IN ('view', 'click') GROUP BY key), p AS (SELECT key, arg_max(value, event_id) AS value FROM e WHERE event_type NOT IN ('view', 'click') GROUP BY key) "
    "SELECT coalesce(p.key, s.key) AS key, coalesce(p.value, s.value) AS value FROM s FULL JOIN p ON s.key = p.key"
)
def line_map_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").isin("view", "click").alias("old"), F.concat(F.lit("k"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("key"), F.col("props").alias("value"))
    stored = B.latest_per_key(e.where("old"), "key", "event_id", "value")
    line = F.concat(F.lit('{"key":'), S.raw_key(F.col("key")), F.lit(',"value":'), "value", F.lit("}"))
    lines = R.numbered(stored.select("key", line.alias("line")), "key", "line_no").drop("key")
    pending = e.where("NOT old").select(S.raw_key(F.col("key")).alias("raw"), "key", "value", F.col("event_id").alias("seq"))
    return kv.merge_lines(kv.parse_lines(lines), pending).select("key", "value")


@query("SELECT c_custkey, c_name AS value FROM customer WHERE c_custkey % 13 <> 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 13 = 0 AND length(c_name) > 0")
def sharded_values(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    shards = kv.to_shards(c.select("c_custkey", F.encode("c_name", "utf-8").alias("v")), "c_custkey", "v", 27, "0" * 15 + "1")
    torn = F.when((F.col("c_custkey") % 13 == 0) & (F.col("shard_no") == 1), F.concat(F.lit("f" * 16 + "|"), F.substring("payload", 18, 100))).otherwise(F.col("payload"))
    return kv.from_shards(shards.withColumn("payload", torn), "c_custkey", "v").select("c_custkey", F.decode("v", "utf-8").alias("value"))


@query(
    """WITH RECURSIVE o AS (SELECT user_id % 16 AS cache_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'get' WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, user_id AS k, CAST(strlen(props) AS BIGINT) AS b,
      row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS i FROM events),
    t(cache_id, i, seq, hit, held) AS (
      SELECT DISTINCT cache_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST([] AS STRUCT(k BIGINT, b BIGINT)[]) FROM o
      UNION ALL
      SELECT cache_id, i, seq, hit, CASE WHEN op = 'get' THEN CASE WHEN hit THEN list_append(others, mine[1]) ELSE others END WHEN op = 'delete' OR b > 60 THEN others
        ELSE list_append(list_filter(others, lambda e, j: list_sum(list_transform(others[j:], lambda x: x.b)) + b <= 60), {'k': k, 'b': b}) END FROM (
        SELECT o.*, list_filter(t.held, lambda e: e.k <> o.k) AS others, list_filter(t.held, lambda e: e.k = o.k) AS mine, len(list_filter(t.held, lambda e: e.k = o.k)) > 0 AS hit FROM t JOIN o ON t.cache_id = o.cache_id AND o.i = t.i + 1)
    ) SELECT cache_id, seq, hit, CAST(coalesce(list_sum(list_transform(held, lambda x: x.b)), 0) AS BIGINT) AS cached_bytes FROM t WHERE i > 0"""
)
def lru_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type").isin("view", "click"), "get").when(F.col("event_type") == "error", "delete").otherwise("set")
    ops = e.select((F.col("user_id") % 16).alias("cache_id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.octet_length("props").cast("long").alias("bytes"))
    return kv.lru(ops, 60)


@query(
    """WITH RECURSIVE o AS (SELECT user_id % 16 AS lane, event_id, CAST(strlen(props) AS BIGINT) AS n_bytes, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS i FROM events),
    t(lane, event_id, n_bytes, i, flush_id, held) AS (
      SELECT lane, event_id, n_bytes, i, CAST(0 AS BIGINT), n_bytes FROM o WHERE i = 1
      UNION ALL
      SELECT o.lane, o.event_id, o.n_bytes, o.i, CASE WHEN t.held >= 100 THEN t.flush_id + 1 ELSE t.flush_id END, CASE WHEN t.held >= 100 THEN o.n_bytes ELSE t.held + o.n_bytes END FROM t JOIN o ON t.lane = o.lane AND o.i = t.i + 1
    ) SELECT lane, event_id, n_bytes, flush_id FROM t"""
)
def flush_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("lane"), "event_id", F.octet_length("props").cast("long").alias("n_bytes"))
    return kv.flush_ids(e, 100, "lane", "event_id", "n_bytes")


# --- scheduling ----------------------------------------------------------------------


def trace(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival_us"), (F.col("event_id") % 50 * 1_000_000_000).alias("duration_us"), "event_type")


TRACE = "x AS (SELECT user_id, event_id AS seq, epoch_us(ts) AS arrival_us, event_id % 50 * 1000000000 AS duration_us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"


@query(
    f"WITH {TRACE}, m AS (SELECT *, max(arrival_us - i * 20000000000) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS r FROM x) SELECT user_id, seq, greatest(arrival_us, r + (i + 1 - 3) * 20000000000) AS start_us, greatest(arrival_us, r + (i + 1 - 3) * 20000000000) - arrival_us AS wait_us FROM m"
)
def token_bucket(spark, sf_dir):
    return sched.token_bucket(trace(spark, sf_dir), ["user_id"], 3, 20_000_000_000).select("user_id", "seq", "start_us", "wait_us")


@query(
    f"WITH {TRACE}, b AS (SELECT *, coalesce(sum(duration_us) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x), m AS (SELECT *, max(arrival_us - before) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) + before AS start_us FROM b) "
    "SELECT user_id, seq, CAST(start_us AS BIGINT) AS start_us, CAST(start_us + duration_us AS BIGINT) AS end_us FROM m"
)
def keyed_mutex(spark, sf_dir):
    return sched.mutex(trace(spark, sf_dir), "user_id", "arrival_us", "duration_us", "seq").select("user_id", "seq", "start_us", "end_us")


@query(f"WITH {ORDER_RANGES}, c AS (SELECT lane, from_block AS f, unnest(range(0, (to_block - from_block) // 4 + 1)) AS chunk_index FROM r) SELECT lane, f, chunk_index, 10 + chunk_index / CAST(count(*) OVER (PARTITION BY lane, f) AS DOUBLE) AS priority FROM c")
def chunk_priority(spark, sf_dir):
    ranges = order_ranges(spark, sf_dir).withColumn("f", F.col("from_block"))
    return sched.chunk_priority(R.divide(ranges, 4), 10, ["lane", "f"]).select("lane", "f", "chunk_index", "priority")


@query(
    f"WITH {TRACE}, m AS (SELECT *, CASE WHEN arrival_us - lag(arrival_us) OVER (PARTITION BY user_id ORDER BY seq) < 3600000000 THEN 0 ELSE 1 END AS n FROM x), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM m) "
    "SELECT user_id, min(arrival_us) AS first_us, max(arrival_us) AS last_us, count(*) AS n_writes, max(seq) AS last_seq FROM s GROUP BY user_id, g"
)
def debounce_sessions(spark, sf_dir):
    return sched.debounce_sessions(trace(spark, sf_dir), "user_id", "arrival_us", 3_600_000_000, "seq")


@query(
    """WITH RECURSIVE x AS (SELECT user_id, epoch_us(ts) AS moment, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
    t(user_id, i, moment, seq, first, n) AS (
      SELECT user_id, i, moment, seq, moment, CAST(1 AS BIGINT) FROM x WHERE i = 1
      UNION ALL
      SELECT x.user_id, x.i, x.moment, x.seq, CASE WHEN least(t.moment + 3600000000, t.first + 9000000000) < x.moment THEN x.moment ELSE t.first END, CASE WHEN least(t.moment + 3600000000, t.first + 9000000000) < x.moment THEN 1 ELSE t.n + 1 END
      FROM t JOIN x ON t.user_id = x.user_id AND x.i = t.i + 1
    ), w AS (SELECT *, least(moment + 3600000000, first + 9000000000) AS due, lead(moment) OVER (PARTITION BY user_id ORDER BY i) AS next FROM t)
    SELECT user_id, due AS written_at, seq, n AS n_coalesced FROM w WHERE (next IS NULL OR due < next) AND due - moment <= 7200000000"""
)
def debounce_full(spark, sf_dir):
    ops = trace(spark, sf_dir).select("user_id", F.col("arrival_us").alias("at"), "seq")
    return sched.debounced_writes(ops, "user_id", 3_600_000_000, 9_000_000_000, 7_200_000_000)


@query(
    f"""WITH RECURSIVE {TRACE}, o AS (SELECT x.user_id, x.seq, CAST(x.arrival_us AS DOUBLE) AS a, CAST(x.duration_us AS DOUBLE) AS d, row_number() OVER (PARTITION BY x.user_id ORDER BY x.arrival_us, x.seq) AS i,
      CASE e.event_type WHEN 'error' THEN 0.0::DOUBLE WHEN 'purchase' THEN 1.0::DOUBLE ELSE 9.0::DOUBLE END AS p FROM x JOIN events e ON x.seq = e.event_id),
    t(user_id, i, now, tokens, stamp, waiting, running, seq, start) AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT), 0.0::DOUBLE, 2.0::DOUBLE, 0.0::DOUBLE, CAST([] AS STRUCT(p DOUBLE, s BIGINT, d DOUBLE)[]), CAST([] AS DOUBLE[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM o
      UNION ALL
      SELECT user_id, CASE WHEN comes THEN i + 1 ELSE i END,
        CASE WHEN comes THEN greatest(now, a) WHEN len(busy) >= 2 THEN greatest(now, list_min(busy)) WHEN have < 1 - 1e-9::DOUBLE THEN now + (1 - have) * 10000000000.0::DOUBLE ELSE now END,
        CASE WHEN comes THEN tokens WHEN starts THEN have - 1 ELSE have END, CASE WHEN comes THEN stamp ELSE now END,
        CASE WHEN comes THEN list_sort(list_append(waiting, {{'p': p, 's': s, 'd': d}})) WHEN starts THEN waiting[2:] ELSE waiting END,
        CASE WHEN comes THEN running WHEN starts THEN list_append(busy, now + waiting[1].d) ELSE busy END,
        CASE WHEN starts THEN waiting[1].s END, CASE WHEN starts THEN CAST(round(now) AS BIGINT) END FROM (
        SELECT *, NOT comes AND len(busy) < 2 AND have >= 1 - 1e-9::DOUBLE AS starts FROM (
          SELECT t.*, o.a, o.p, o.seq AS s, o.d, o.a IS NOT NULL AND (len(t.waiting) = 0 OR t.now >= o.a) AS comes, list_filter(t.running, lambda e: e > t.now) AS busy, least(2.0::DOUBLE, t.tokens + (t.now - t.stamp) / 10000000000.0::DOUBLE) AS have
          FROM (SELECT user_id, i, now, tokens, stamp, waiting, running FROM t) t LEFT JOIN o ON t.user_id = o.user_id AND o.i = t.i + 1 WHERE o.a IS NOT NULL OR len(t.waiting) > 0))
    ) SELECT user_id, seq, start AS start_us FROM t WHERE seq IS NOT NULL"""
)
def limiter_trace(spark, sf_dir):
    priority = F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "purchase", 1.0)
    return sched.limiter(trace(spark, sf_dir).withColumn("priority", priority), "user_id", 2, 0.0001, 2)


@query(
    """WITH RECURSIVE x AS (SELECT user_id, epoch_us(ts) AS call_start, epoch_us(ts) + event_id % 50 * 1000000000 AS call_end FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY call_start, call_end) AS i FROM x),
    t(user_id, call_start, call_end, i, lead, until) AS (
      SELECT user_id, call_start, call_end, i, call_start, call_end FROM o WHERE i = 1
      UNION ALL
      SELECT o.user_id, o.call_start, o.call_end, o.i, CASE WHEN o.call_start >= t.until THEN o.call_start ELSE t.lead END, CASE WHEN o.call_start >= t.until THEN o.call_end ELSE t.until END FROM t JOIN o ON t.user_id = o.user_id AND o.i = t.i + 1
    ) SELECT user_id, call_start, call_end, lead AS leader_start FROM t"""
)
def in_flight_calls(spark, sf_dir):
    calls = trace(spark, sf_dir).select("user_id", F.col("arrival_us").alias("call_start"), (F.col("arrival_us") + F.col("duration_us")).alias("call_end"))
    return sched.in_flight_dedupe(calls, "user_id", "call_start", "call_end")


@query("SELECT c_mktsegment AS lane, min(c_custkey) AS first_key, max(c_custkey) AS last_key, CAST(sum(strlen(c_name)) AS BIGINT) AS n_bytes FROM customer GROUP BY 1")
def fold_and_totals(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("lane")).agg(F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"), F.sum(F.octet_length("c_name")).alias("n_bytes"))


# --- small forms -----------------------------------------------------------------------


@query(f"WITH {EVENT_LOGS_SQL} SELECT tx_hash, lower(to_hex(block_number)) AS block_hex, block_number FROM logs")
def hex_numbers(spark, sf_dir):
    """Numbers to hex text and back."""
    logs = event_logs(spark, sf_dir).select("tx_hash", F.lower(F.hex("block_number")).alias("block_hex"))
    return logs.withColumn("block_number", F.conv("block_hex", 16, 10).cast("long"))


@query("SELECT c_custkey, base64(encode(c_name)) AS packed, c_name AS unpacked FROM customer")
def base64_round_trip(spark, sf_dir):
    packed = table(spark, sf_dir, "customer").select("c_custkey", F.base64(F.encode("c_name", "utf-8")).alias("packed"))
    return packed.withColumn("unpacked", F.decode(F.unbase64("packed"), "utf-8"))


@query("SELECT c_custkey, c_mktsegment, CAST(NULL AS VARCHAR) AS missing FROM customer")
def pick_fields(spark, sf_dir):
    """A field that isn't there is null; dropping one that isn't there changes nothing."""
    return table(spark, sf_dir, "customer").drop("c_name", "no_such_field").select("c_custkey", "c_mktsegment", F.lit(None).cast("string").alias("missing"))


@query("SELECT user_id, arg_min(event_id, {'p': event_id % 7, 's': event_id}) AS next_seq FROM events GROUP BY user_id")
def next_by_priority(spark, sf_dir):
    """Of each queue the job of least priority value, first come first served."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(F.col("event_id") % 7, "event_id")).alias("next_seq"))


@query("SELECT event_type, arg_min(user_id, {'p': -(event_id % 5), 'd': epoch_us(ts)}) AS next_key FROM events GROUP BY event_type")
def next_flush(spark, sf_dir):
    """Of each store the key of highest flush priority, earliest deadline first."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min_by("user_id", F.struct(-(F.col("event_id") % 5), F.unix_micros(F.col("ts").cast("timestamp")))).alias("next_key"))


@query(f"WITH {EVENT_LOGS_SQL}, tip AS (SELECT max(block_number) - 7 AS tip FROM logs) SELECT DISTINCT block_number // {BIN} * {BIN} AS bin_start FROM logs, tip WHERE block_number // {BIN} * {BIN} + {BIN - 1} <= tip")
def cold_bins(spark, sf_dir):
    """Bins that the tip has passed: only these can be stored."""
    logs = event_logs(spark, sf_dir)
    tip = EventSource(spark, sf_dir).tip() - 7
    return B.bin_logs(logs, BIN).where(F.col("bin_start") + BIN - 1 <= tip).select("bin_start").distinct()


@query(f"WITH {TRACE}, e AS (SELECT user_id, seq, arrival_us, max(arrival_us + duration_us) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM x) SELECT user_id, seq, greatest(arrival_us, coalesce(until, arrival_us)) AS released_us FROM e")
def flush_barrier(spark, sf_dir):
    """When a flush asked for with each request is released: once all work accepted before it has ended."""
    w = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.col("arrival_us") + F.col("duration_us")).over(w)
    return trace(spark, sf_dir).select("user_id", "seq", F.greatest("arrival_us", F.coalesce(until, F.col("arrival_us"))).alias("released_us"))


@query("WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS t, max(epoch_us(ts)) OVER () AS tip FROM events) SELECT user_id, count(*) AS n_fresh, max(event_id) AS last_seq FROM e WHERE tip - t <= 86400000000 GROUP BY user_id")
def stale_drop(spark, sf_dir):
    """Buffered writes that are younger than a day at the last event."""
    t = trace(spark, sf_dir)
    now = t.agg(F.max("arrival_us")).first()[0]
    return t.where(F.lit(now) - F.col("arrival_us") <= 86_400_000_000).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_fresh"), F.max("seq").alias("last_seq"))


@query("WITH w AS (SELECT conv_id, turn, strlen(role) + strlen(text) + strlen('{\"role\":\"\",\"text\":\"\",\"ref\":null}') AS n FROM conversations) SELECT conv_id, count(*) AS n_turns, CAST(sum(n) AS BIGINT) AS n_bytes FROM w GROUP BY conv_id")
def json_sizes(spark, sf_dir):
    """Bytes of each conversation's turns as JSON objects of role, text and a null ref."""
    turn = F.struct("role", "text", F.lit(None).cast("string").alias("ref"))
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("role", "text", "ref")])
    sized = table(spark, sf_dir, "conversations").select("conv_id", S.estimate_bytes(turn, kind).alias("n"))
    return sized.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("n").alias("n_bytes"))


# --- divided and cached execution, layers and stores ---------------------------------------


def _of_responses(spark, responses) -> DataFrame:
    """from_block, to_block, priority and n_logs of each answered range."""
    out = spark.createDataFrame([], "from_block long, to_block long, priority double, n_logs long")
    for r in responses:
        out = out.unionByName(r.logs.agg(F.count(F.lit(1)).alias("n_logs")).select(F.lit(r.from_block).cast("long").alias("from_block"), F.lit(r.to_block).cast("long").alias("to_block"), F.lit(float(r.priority)).alias("priority"), "n_logs"))
    return out


ERRORS = LogFilter(topics=(("error",),), from_block=30, to_block=230)


@query(f"WITH {EVENT_LOGS_SQL}, tip AS (SELECT max(block_number) AS tip FROM logs), c AS (SELECT unnest(range(0, 300, 60)) AS f), k AS (SELECT f, least(f + 59, 249, tip) AS t, f / 300.0::DOUBLE AS p FROM c, tip) SELECT f AS from_block, t AS to_block, p AS priority, CAST((SELECT count(*) FROM logs WHERE topic0 = 'error' AND block_number BETWEEN f AND t) AS BIGINT) AS n_logs FROM k WHERE f <= t")
def progressive_chunks(spark, sf_dir):
    """What a progressive sink gets: each aligned chunk before the trim, in order of its priority."""
    seen = []
    DividedQuery(ERRORS, max_range=60, align=50).execute(EventSource(spark, sf_dir), on_response=seen.append)
    return _of_responses(spark, seen)


@query(
    f"""WITH RECURSIVE {EVENT_LOGS_SQL}, h AS (SELECT least(999, max(block_number)) AS hi FROM logs), n AS (SELECT hi, hi // 200 + 1 AS n FROM h),
    t(f, t, p) AS (SELECT 200 * i, least(200 * i + 199, hi), i / CAST(n AS DOUBLE) FROM (SELECT hi, n, unnest(range(0, n)) AS i FROM n)
      UNION ALL SELECT CASE WHEN s = 0 THEN f ELSE f + (t - f + 1) // 2 END, CASE WHEN s = 0 THEN f + (t - f + 1) // 2 - 1 ELSE t END, p FROM t, (VALUES (0), (1)) v(s) WHERE t - f + 1 > 40)
    SELECT f AS from_block, t AS to_block, p AS priority, (SELECT count(*) FROM logs WHERE topic0 = 'error' AND block_number BETWEEN f AND t) AS n_logs FROM t WHERE t - f + 1 <= 40"""
)
def refused_ranges(spark, sf_dir):
    """A source that refuses more than 40 blocks: chunks of 200 are halved until it answers, at their chunk's priority."""
    wanted = LogFilter(topics=(("error",),), from_block=0, to_block=999)
    return _of_responses(spark, DividedQuery(wanted, max_range=200).responses(NarrowSource(EventSource(spark, sf_dir), 40)))


@query(f"WITH {EVENT_LOGS_SQL} SELECT address, block_number, block_hash, log_index, tx_hash, data FROM logs WHERE false")
def sink_only(spark, sf_dir):
    """With a sink alone the result is empty."""
    return DividedQuery(ERRORS, max_range=100).execute(EventSource(spark, sf_dir), on_response=lambda r: None, only=True).select(*LOG)


@query(f"WITH {EVENT_LOGS_SQL}, b AS (SELECT unnest(range(0, 1000, {BIN})) AS bin_start), tip AS (SELECT max(block_number) AS tip FROM logs) SELECT bin_start, count(topic0) AS n_logs, min(log_index + 4 * block_number) AS first_event FROM b JOIN tip ON bin_start + {BIN - 1} <= tip LEFT JOIN logs ON block_number // {BIN} * {BIN} = bin_start AND topic0 = 'purchase' GROUP BY bin_start")
def bins_written(spark, sf_dir):
    """The bins that a cached query writes: complete ones, each with its logs, and nothing of the bin that the tip is in."""
    store = BinStore(spark, fresh_path(spark, "bins"))
    CachedQuery(LogFilter(topics=(("purchase",),), from_block=0, to_block=999), BIN).execute(EventSource(spark, sf_dir), store)
    held = store.manifest().select("bin_start")
    logs = B.bin_logs(store.read([r.bin_start for r in held.collect()]), BIN)
    return held.join(logs, "bin_start", "left").groupBy("bin_start").agg(F.count("block_number").alias("n_logs"), F.min(F.col("log_index") + 4 * F.col("block_number")).alias("first_event"))


@query(f"WITH {EVENT_LOGS_SQL} SELECT address, block_number, block_hash, log_index, tx_hash, data FROM logs WHERE topic0 = 'error' AND block_number BETWEEN 30 AND 230 AND {NODE_SIZE} <= 416")
def layered_query(spark, sf_dir):
    """A sieve around a source that refuses wide ranges around the table."""
    source = layered(EventSource(spark, sf_dir), lambda s: NarrowSource(s, 25), lambda s: SievedSource(s, 416))
    return DividedQuery(ERRORS, max_range=100, align=50).execute(source).select(*LOG)


@query(f"WITH {EVENT_LOGS_SQL}, {MANIFEST}, {WANTED}, m AS (SELECT bin_start, bin_start + 1000 - (bin_start + {BIN - 1}) AS confirmations FROM wanted WHERE bin_start IN (SELECT bin_start FROM hit)) SELECT bin_start, bin_start + {BIN - 1} AS bin_end FROM m WHERE bin_start % 100 / CAST(100 AS DOUBLE) >= confirmations / CAST(2000 AS DOUBLE)")
def refetch_decisions(spark, sf_dir):
    """Hits under a strategy of the caller and a fixed draw: what falls below the chance is fetched anew."""
    query_ = CachedQuery(CACHED.filter, BIN, lambda confirmations, age_ms, chunks: confirmations / F.lit(2000.0))
    return query_.plan(manifest(spark, sf_dir), EventSource(spark, sf_dir).tip(), draw=F.col("bin_start") % 100 / F.lit(100.0))[0]


def _entries(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.encode(value, "utf-8").alias("value"), F.lit("set").alias("op"), F.lit(0).cast("long").alias("seq"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_brand AS value FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0")
def warmed_tiers(spark, sf_dir):
    """What the near store holds after reads through both: its own entries and those that the reads missed."""
    near, far = (LogStore(spark, fresh_path(spark, "store")) for _ in range(2))
    near.apply(_entries(table(spark, sf_dir, "part").where("p_partkey % 5 = 0"), "p_partkey", "p_brand"))
    far.apply(_entries(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name"))
    TieredStore([near, far], populate_on_miss=True).get(table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("key")))
    return near.entries().select("key", F.decode("value", "utf-8").alias("value"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS value FROM supplier")
def checked_values(spark, sf_dir):
    """Values behind checksums, some of them damaged: these read as none."""
    raw = LogStore(spark, fresh_path(spark, "store"))
    store, s = CodedStore(raw), table(spark, sf_dir, "supplier")
    store.apply(_entries(s, "s_suppkey", "s_name"))
    bad = raw.entries().where(F.col("key").cast("long") % 7 == 0)
    raw.apply(bad.select("key", F.concat("value", F.encode(F.lit("!"), "utf-8")).alias("value"), F.lit("set").alias("op"), F.lit(1).cast("long").alias("seq")))
    return store.get(s.select(F.col("s_suppkey").cast("string").alias("key"))).select("key", F.decode("value", "utf-8").alias("value"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS value FROM customer WHERE c_custkey % 6 = 0")
def cached_stack(spark, sf_dir):
    """Sets and deletes through the cached, debounced stack, read again through a new cache.

    The keys come at the rate at which the stack writes: of more at once it drops, by its staleness, what it can't write in time.
    """
    remote, c = LogStore(spark, fresh_path(spark, "store")), table(spark, sf_dir, "customer")
    stack = optimised(remote, LogStore(spark, fresh_path(spark, "cache")))
    ops = _entries(c, "c_custkey", "c_name").withColumn("at", F.floor(F.col("key").cast("long") * 1000 / OPTIMISED[1].per_second))
    gone = ops.where(F.col("key").cast("long") % 4 == 0).select("key", F.lit(None).cast("binary").alias("value"), F.lit("delete").alias("op"), F.lit(1).cast("long").alias("seq"), (F.col("at") + 10).alias("at"))
    stack.apply(ops.unionByName(gone).withColumn("seq", F.col("key").cast("long") * 2 + F.col("seq")))
    again = optimised(remote, LogStore(spark, fresh_path(spark, "cache")))
    return again.get(c.where("c_custkey % 6 = 0").select(F.col("c_custkey").cast("string").alias("key"))).select("key", F.decode("value", "utf-8").alias("value"))


@query("WITH l AS (SELECT c_custkey AS k, '{\"key\":\"' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '\",\"value\":' || CAST(c_nationkey AS VARCHAR) || '}' AS line FROM customer) SELECT line, count(*) AS n FROM (SELECT line FROM l WHERE k % 3 > 0 UNION ALL SELECT line FROM l WHERE k % 3 = 2 UNION ALL SELECT 'end') GROUP BY line")
def compressed_lines(spark, sf_dir):
    """Compressed lines of a map, each rewritten to none, one or two, with a last line of its own; read again."""
    c = table(spark, sf_dir, "customer")
    entries = c.select(S.raw_key(F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("raw"), F.col("c_nationkey").cast("string").alias("value"))
    slot = files.Slot(spark, fresh_path(spark, "lines"))
    slot.put(lambda path: files.write_map(entries, path))
    slot.put(lambda path: files.rewrite_lines(slot.lines(), lambda line: [line] * (int(line[8:16]) % 3), path, trailer=["end"]))
    return slot.lines().groupBy("line").agg(F.count(F.lit(1)).alias("n"))


# --- streams -----------------------------------------------------------------------------------


@query(f"SELECT event_type, count(*) AS n_writes, CAST(sum(last) AS BIGINT) AS last_events FROM (SELECT event_type, event_id // 4 AS block, max(event_id) AS last FROM events GROUP BY 1, 2) GROUP BY event_type")
def streamed_first_wins(spark, sf_dir):
    """A stream of events with one write for each type and block: the last one of each, kept by a stateful operator over micro-batches."""
    events, arrived, out = table(spark, sf_dir, "events"), fresh_path(spark, "arrived"), fresh_path(spark, "stream")
    events.repartition(6).write.parquet(arrived)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(arrived)
    keyed = source.groupBy("event_type", F.expr("event_id div 4").alias("block")).agg(F.max("event_id").alias("last"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/part={number}")

    keyed.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("event_type", "block").agg(F.max("last").alias("last"))
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_writes"), F.sum("last").alias("last_events"))


# --- values and requests ---------------------------------------------------------------------


@query("SELECT event_id, '{\"id\":{\"__bigint__\":\"' || CAST(event_id + 9007199254740992 AS VARCHAR) || '\"},\"type\":\"' || event_type || '\"}' AS json, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id + 9007199254740992 END AS parsed FROM events")
def json_round_trip(spark, sf_dir):
    """Values as JSON text with marked big integers, and back; broken text reads as none."""
    value = F.struct(S.big_json(F.col("event_id") + (1 << 53)).alias("id"), F.col("event_type").alias("type"))
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(value).alias("json"))
    broken = F.when(F.col("event_id") % 5 == 0, F.substring("json", 1, 9)).otherwise(F.col("json"))
    return e.withColumn("parsed", F.from_json(broken, "id struct<__bigint__: string>, type string")["id"]["__bigint__"].cast("long"))


@query("SELECT event_id, '{' || CASE WHEN event_id % 2 = 0 THEN '\"0xab\":\"0xfe' || CAST(event_id AS VARCHAR) || '\",' ELSE '' END || '\"B\":\"' || event_type || '\",\"c\":\"Xy\"}' AS tree FROM events")
def transformed_trees(spark, sf_dir):
    """Objects with sorted keys, lower-case hex in keys and values, and without absent entries."""
    i = F.col("event_id")
    tree = F.create_map(F.lit("c"), F.lit("Xy"), F.lit("0xAB"), F.when(i % 2 == 0, F.concat(F.lit("0xFE"), i.cast("string"))), F.lit("B"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(S.transform_tree(tree, key=S.lower_hex, leaf=S.lower_hex, include=lambda k, v: v.isNotNull())).alias("tree"))


@query(
    "WITH u AS (SELECT user_id, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '\"0xa\"' WHEN 2 THEN '[\"0xb\",\"0xa\"]' ELSE NULL END AS address, CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '[null,\"0xc\"]' ELSE '[[\"0xd\",\"0xe\"]]' END AS topics FROM (SELECT DISTINCT user_id FROM events)) "
    "SELECT user_id, coalesce(address, '') AS address, coalesce(topics, '') AS topics FROM u"
)
def canonical_filters(spark, sf_dir):
    """Requests in canonical form: one address stands alone, empty sets and all-open topics are absent."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    i, strings = F.col("user_id"), "array<string>"
    address = F.when(i % 4 == 0, F.array().cast(strings)).when(i % 4 == 1, F.array(F.lit("0xA"))).when(i % 4 == 2, F.array(F.lit("0xB"), F.lit("0xa")))
    topics = F.when(i % 3 == 0, F.array(F.array().cast(strings), F.lit(None).cast(strings))).when(i % 3 == 1, F.array(F.array().cast(strings), F.array(F.lit("0xC")))).otherwise(F.array(F.array(F.lit("0xD"), F.lit("0xe"))))
    return u.select("user_id", F.coalesce(S.canonical_address(address), F.lit("")).alias("address"), F.coalesce(S.canonical_topics(topics), F.lit("")).alias("topics"))


@query("WITH g AS (SELECT b AS bits, r AS radix FROM range(1, 53) x(b), range(2, 37) y(r)) SELECT bits, radix, (SELECT min(k) FROM range(1, 54) z(k) WHERE pow(CAST(radix AS DOUBLE), k) >= pow(2.0::DOUBLE, bits)) AS width FROM g")
def padding_table(spark, sf_dir):
    """The digits that hold a number of bits, for every radix."""
    grid = spark.range(52 * 35).select((F.col("id") % 52 + 1).alias("bits"), (F.floor(F.col("id") / 52) + 2).alias("radix"))
    return grid.withColumn("width", S.padding_width(F.col("bits"), F.col("radix")))


@query("WITH o AS (SELECT user_id % 64 AS lane, event_id, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS BIGINT) AS v FROM events), l AS (SELECT lane, list(v ORDER BY event_id) AS vs FROM o GROUP BY lane) SELECT lane, list_reduce(list_prepend(CAST(7 AS BIGINT), vs), lambda a, x: (a * 31 + x) % 1000003) AS folded FROM l")
def fold_records(spark, sf_dir):
    """A fold with a reducer of the caller that depends on the order of records."""
    names = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    records = table(spark, sf_dir, "events").select((F.col("user_id") % 64).alias("lane"), "event_id", F.array_position(names, F.col("event_type")).alias("v"))
    return kv.fold(records, "lane", "event_id", "v", lambda a, x: (a * 31 + x) % 1_000_003, 7, "folded", "long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached_range_query(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


