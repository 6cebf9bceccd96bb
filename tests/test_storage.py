import gzip
import random
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from logweave.model import LogFilter, event_logs
from logweave.operators import bins as B
from logweave.operators import kv, sched, stores
from logweave.operators import ranges as R
from logweave.plans import control
from logweave.plans.query import CachedQuery, DividedQuery
from logweave.sources import files
from logweave.sources import logs as logs_module
from logweave.sources.bins import BinStore
from logweave.sources.logs import EventSource, NarrowSource, SourceError, TableSource
from tests import simulations as sim

SF = "/root/testdata/sf0.001"
ENTRY = "line_no long, line string"


def entries(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), ENTRY)


def merged(spark, stored, pending):
    p = spark.createDataFrame([(f'"{k}"', k, v, i) for i, (k, v) in enumerate(pending)], "raw string, key string, value string, seq long")
    return [(r.key, r.value) for r in kv.merge_lines(kv.parse_lines(entries(spark, *stored)), p).orderBy("raw").collect()]


def line(k, v):
    return f'{{"key":"{k}","value":{v}}}'


def test_malformed_lines(spark):
    got = kv.parse_lines(entries(spark, "", "not-json", '{"key":5,"value":1}', line("a", 1))).collect()
    assert [(r.key, r.value) for r in got] == [("a", "1")]


def test_merge_lines(spark):
    assert merged(spark, [line("x", 1), line("y", 2), line("z", 3)], [("x", "9"), ("a", "0")]) == [("a", "0"), ("x", "9"), ("y", "2"), ("z", "3")]
    assert merged(spark, [line("a", "bad"), line("b", 2)], [("c", "3")]) == [("a", "bad"), ("b", "2"), ("c", "3")]
    assert merged(spark, [line("a", 1), line("a", 2), line("b", 3)], [("a", "9"), ("c", "4")]) == [("a", "9"), ("c", "4")]
    assert merged(spark, [line("b", 1), line("a", 2), line("c", 3)], [("d", "4")]) == [("b", "1"), ("d", "4")]


def test_sound_prefix_across_runs(spark):
    e = spark.createDataFrame([(i, f"{k:03}") for i, k in enumerate([1, 2, 3, 4, 4, 5])], "line_no long, raw string")
    for run in (1, 2, 3, 100):
        assert kv.sound_prefix(e, run=run).count() == 4


def test_lru(spark):
    rng = random.Random(4)
    ops = [(c, s, rng.choice(["get", "set", "set", "delete"]), str(rng.randint(0, 6)), rng.randint(1, 9)) for c in range(3) for s in range(80)]
    got = kv.lru(spark.createDataFrame(ops, "cache_id long, seq long, op string, key string, bytes long"), 12).collect()
    for c in range(3):
        expected = sim.lru([(o, k, b) for x, _, o, k, b in ops if x == c], 12)
        assert [(r.hit, r.cached_bytes) for r in sorted((r for r in got if r.cache_id == c), key=lambda r: r.seq)] == expected


def test_shards_round_trip(spark):
    df = spark.createDataFrame([(1, b"hello world" * 5), (2, b"")], "k long, v binary")
    shards = kv.to_shards(df, "k", "v", 37, "0" * 16)
    assert {r.k: bytes(r.v) for r in kv.from_shards(shards, "k", "v").collect()} == {1: b"hello world" * 5, 2: b""}
    assert {r.k: r.v for r in kv.from_shards(shards.where("NOT (k = 1 AND shard_no = 1)"), "k", "v").collect()}[1] is None


def test_shards_of_several_writes_that_expire(spark):
    df = spark.createDataFrame([(1, b"one" * 30, 100), (2, b"two" * 30, None), (3, b"three" * 30, 50)], "k long, v binary, until long")
    shards = kv.to_shards(df, "k", "v", 40, F.lpad(F.col("k").cast("string"), 16, "0"), F.col("until"))
    assert {r.k: bytes(r.v) for r in kv.from_shards(shards, "k", "v", now=60).collect()} == {1: b"one" * 30, 2: b"two" * 30}
    mixed = shards.withColumn("k", F.when(F.col("k") == 3, 2).otherwise(F.col("k")))
    assert {r.k: r.v is None for r in kv.from_shards(mixed, "k", "v").collect()} == {1: False, 2: True}


def test_token_bucket(spark):
    rng = random.Random(9)
    at = sorted(rng.randint(0, 4000) for _ in range(60))
    rows = [(0, i, a) for i, a in enumerate(at)]
    got = sched.token_bucket(spark.createDataFrame(rows, "lane long, seq long, arrival_us long"), ["lane"], 3, 100).orderBy("seq").collect()
    assert [r.start_us for r in got] == sim.bucket(at, 3, 100)


def test_limiter_orders_by_priority(spark):
    rows = [(0, 0, 0, 100, None), (0, 1, 1, 100, 10.0), (0, 2, 2, 100, 0.0), (0, 3, 3, 100, 5.0)]
    df = spark.createDataFrame(rows, "lane long, seq long, arrival_us long, duration_us long, priority double")
    assert [r.seq for r in sched.limiter(df, "lane", 10, 1e6, 1).orderBy("start_us").collect()] == [0, 2, 3, 1]


def test_debounce_max_delay(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate((0, 80, 160, 240))], "k string, at long, seq long")
    assert [(r.written_at, r.seq) for r in sched.debounced_writes(df, "k", 100, 250, 10_000).collect()] == [(250, 3)]


def test_mutex(spark):
    df = spark.createDataFrame([("k", 0, 10, 1), ("k", 1, 10, 2), ("k", 50, 10, 3)], "k string, at long, d long, seq long")
    assert [(r.start_us, r.end_us) for r in sched.mutex(df, "k", "at", "d", "seq").orderBy("seq").collect()] == [(0, 10), (10, 20), (50, 60)]


def responses(spark, *rows):
    return spark.createDataFrame(list(rows), "from_block long, to_block long, fetched_at long, fetched_at_block long")


def test_bin_completion(spark):
    assert B.complete_bins(responses(spark, (0, 5000, 1, 1)), 10_000).count() == 0
    got = B.complete_bins(responses(spark, (0, 4999, 1000, 50_000), (5000, 9999, 2000, 40_000)), 10_000).collect()
    assert [tuple(r) for r in got] == [(0, 9999, 2000, 50_000)]


def logs_of(spark):
    return TableSource(event_logs(spark, SF))


def test_divided_execution(spark):
    """Chunks, halves, priorities, the end at the tip, errors with their range."""
    query = DividedQuery(LogFilter(from_block=0, to_block=199), max_range=100)
    seen = []
    assert query.execute(logs_of(spark), on_response=seen.append, only=True).count() == 0
    assert [(r.from_block, r.to_block, r.priority, r.logs.count()) for r in seen] == [(0, 99, 0.0, 400), (100, 199, 0.5, 400)]
    deep = DividedQuery(LogFilter(from_block=0, to_block=7)).responses(NarrowSource(logs_of(spark), 2))
    assert [(r.from_block, r.to_block) for r in deep] == [(0, 1), (2, 3), (4, 5), (6, 7)]
    based = DividedQuery(LogFilter(from_block=0, to_block=199), 100, priority=10.0).responses(logs_of(spark))
    assert [r.priority for r in based] == [10.0, 10.5]
    late = DividedQuery(LogFilter(from_block=10, to_block=500), max_range=100, align=100).responses(logs_of(spark), tip=130, now_ms=7)
    assert [(r.from_block, r.to_block, r.fetched_at, r.fetched_at_block) for r in late] == [(0, 99, 7, 130), (100, 130, 7, 130)]
    assert len(R.chunks_of(0, 999_999, 100_000)) == 10
    with pytest.raises(SourceError, match=r"\[5, 5\]: .*range"):
        DividedQuery(LogFilter(from_block=5, to_block=5)).execute(NarrowSource(logs_of(spark), 0))

    class Broken(TableSource):
        def logs(self, wanted, ranges):
            raise SourceError("no such method", 1)

    with pytest.raises(SourceError, match=r"\[0, 99\]: no such method"):
        query.execute(Broken(event_logs(spark, SF)))


def test_one_scan_with_pushed_ranges(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    divided = plan(DividedQuery(LogFilter(topics=(("error",),), from_block=10, to_block=90), max_range=20).execute(EventSource(spark, SF)))
    assert divided.count("FileScan") == 1
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(event_id,40\).*LessThanOrEqual\(event_id,363\)", divided) and "EqualTo(event_type,error)" in divided
    point = plan(DividedQuery(LogFilter(block_hash="0x" + "42".rjust(64, "0"))).execute(EventSource(spark, SF)))
    assert "GreaterThanOrEqual(event_id,168)" in point


def test_write_back_and_reread(spark, tmp_path):
    source, store = EventSource(spark, SF), BinStore(spark, str(tmp_path))
    query = CachedQuery(LogFilter(from_block=0, to_block=199), 50, max_range=30)
    plain = [tuple(r) for r in DividedQuery(query.filter).execute(source).collect()]
    hits, gaps, _ = query.plan(store.manifest(), 249)
    assert hits.count() == 0 and [tuple(r) for r in gaps.collect()] == [(0, 199)]
    assert [tuple(r) for r in query.execute(source, store).collect()] == plain
    assert sorted(r.bin_start for r in store.manifest().collect()) == [0, 50, 100, 150]
    hits, gaps, _ = query.plan(store.manifest(), 249)
    assert hits.count() == 4 and gaps.count() == 0

    class Silent(EventSource):
        def logs(self, wanted, ranges):
            raise AssertionError("the source is asked for what is stored")

    silent = query.execute(Silent(spark, SF), store, tip=249)
    scans = silent._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in silent.collect()] == plain
    assert scans.count("FileScan") == 1 and "event_id" not in scans and "PartitionFilters" in scans
    always = CachedQuery(query.filter, 50, lambda conf, age, n: F.lit(1.0))
    assert always.plan(store.manifest(), 249, draw=F.lit(0.5))[0].count() == 0


def test_hit_bins_are_not_read_from_the_source(spark, tmp_path):
    store = BinStore(spark, str(tmp_path))
    CachedQuery(LogFilter(from_block=50, to_block=149), 50).execute(EventSource(spark, SF), store)
    asked = []

    class Noted(EventSource):
        def logs(self, wanted, ranges):
            asked.extend(ranges)
            return super().logs(wanted, ranges)

    got = CachedQuery(LogFilter(from_block=10, to_block=210), 50).execute(Noted(spark, SF), store)
    assert got.count() == 4 * 201 and not any(a < 150 and b >= 50 for a, b in asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "event_id" not in plan and "PartitionFilters: [" in plan  # gaps were stored before they are read
    # The bin of the tip is never stored.
    late = CachedQuery(LogFilter(from_block=200, to_block="latest"), 50)
    assert late.execute(EventSource(spark, SF), store, tip=230).count() == 31 * 4
    assert 200 not in {r.bin_start for r in store.manifest().where("fetched_at_block = 230").collect()}


def test_a_bin_fetched_anew_replaces_the_old_one(spark, tmp_path):
    store, logs = BinStore(spark, str(tmp_path)), event_logs(spark, SF).where("block_number < 50")
    store.write(B.bin_logs(logs, 50), [(0, 49, 1, 100)])
    store.write(B.bin_logs(logs.where("block_number < 3"), 50), [(0, 49, 2, 200)])
    assert store.read([0]).count() == 12
    store.write(B.bin_logs(logs.limit(0), 50), [(0, 49, 3, 300)])
    assert store.read([0]).count() == 0 and store.manifest().first().fetched_at_block == 300


def test_topics_and_sinks(spark):
    source = logs_of(spark)
    assert DividedQuery(LogFilter(topics=(None, ("x",)))).execute(source).count() == 0
    seen = []
    assert DividedQuery(LogFilter(topics=(("error", "view"),)), max_range=100).execute(source, on_response=lambda r: seen.append(r.logs.count()), only=True).count() == 0
    assert sum(seen) == source.table.where("topics[0] IN ('error', 'view')").count()
    many = [(7 * k, 7 * k + 2) for k in range(40)]
    expected = source.table.where("block_number % 7 < 3").count()
    for most in (500, 10):
        logs_module.MOST_RANGES, before = most, logs_module.MOST_RANGES
        assert source.logs(LogFilter(), many).count() == expected
        logs_module.MOST_RANGES = before


def test_limiter_against_simulation(spark):
    rng = random.Random(13)
    rows = []
    for lane in range(6):
        for seq, at in enumerate(sorted(rng.randint(0, 3000) * 1000 for _ in range(60))):
            rows.append((lane, seq, at, rng.randint(0, 300) * 1000, rng.choice([None, 0.0, 1.0, 5.0])))
    df = spark.createDataFrame(rows, "lane long, seq long, arrival_us long, duration_us long, priority double")
    got = {(r.lane, r.seq): r.start_us for r in sched.limiter(df, "lane", 2, 20.0, 3).collect()}
    for lane in range(6):
        expected = sim.limiter([(a // 1000, s, d // 1000, p) for x, s, a, d, p in rows if x == lane], 2, 50, 3)
        assert {s: got[lane, s] for s in expected} == {s: t * 1000 for s, t in expected.items()}
    assert sched.limiter(df, "lane", 2, 0.0, 3).count() == 12
    none = sched.token_bucket(df, ["lane"], 3, 0).groupBy("lane").agg(F.count("start_us").alias("n")).collect()
    assert [r.n for r in none] == [3] * 6


def test_debounced_store_against_simulation(spark):
    rng = random.Random(3)
    options = stores.DebounceOptions(40, 110, 60, 2, 12, 60)
    rows = []
    for store in range(5):
        for seq, at in enumerate(sorted(rng.randint(0, 1500) for _ in range(70))):
            op = rng.choice(["set"] * 8 + ["delete", "flush"])
            rows.append((store, at, seq, None if op == "flush" else f"k{rng.randint(0, 4)}", op, rng.choice([0, 5, 30, 80])))
    df = spark.createDataFrame(rows, "store long, at long, seq long, key string, op string, duration long")
    got = sorted((r.store, r.seq, r.outcome, r.started, r.ended) for r in sched.debounced_store(df, "store", options).collect())
    expected = sorted((s, *x) for s in range(5) for x in sim.debounced([r[1:] for r in rows if r[0] == s], options))
    assert got == expected and {x[2] for x in got} == {"written", "timeout", "stale", "flushed"}


def test_debounce_and_flushes_against_simulation(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randint(0, 5)}", rng.randint(0, 4000), i, rng.randint(1, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, seq long, size long")
    got = sorted((r.k, r.written_at, r.seq, r.n_coalesced) for r in sched.debounced_writes(df, "k", 100, 250, 80).collect())
    assert got == sorted(sim.debounce([(k, at, s) for k, at, s, _ in rows], 100, 250, 80))
    ids = {r.seq: r.flush_id for r in kv.flush_ids(df, 100, "k", "seq", "size").collect()}
    for key in {r[0] for r in rows}:
        held = flush = 0
        for k, _, s, size in sorted(rows, key=lambda r: r[2]):
            if k == key:
                assert ids[s] == flush
                held += size
                if held >= 100:
                    held, flush = 0, flush + 1


def test_calls_in_flight(spark):
    rng = random.Random(6)
    rows = [(f"c{rng.randint(0, 4)}", s := rng.randint(0, 1000), s + rng.randint(1, 120)) for _ in range(200)]
    got = sorted((r.c, r.a, r.b, r.leader_start) for r in sched.in_flight_dedupe(spark.createDataFrame(rows, "c string, a long, b long"), "c", "a", "b").collect())
    expected, state = [], {}
    for c, a, b in sorted(rows):
        if c not in state or a >= state[c][1]:
            state[c] = (a, b)
        expected.append((c, a, b, state[c][0]))
    assert got == expected


def test_a_log_is_replayed_over_batches(spark):
    """Machines live on from batch to batch, and start anew with each key."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([(k, i, 1) for k in "abc" for i in range(50)], "k string, seq long, v long")
        assert {r.k: r.n for r in kv.fold(df, "k", "seq", "v", lambda a, x: 2 * a + x, 0, "n", "long").collect()} == {k: (1 << 50) - 1 for k in "abc"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert kv.fold(df.limit(0), "k", "seq", "v", lambda a, x: a, 0, "n", "long").count() == 0


def ops_of(spark, *rows):
    return spark.createDataFrame([(k, None if v is None else v.encode(), o, s) for k, v, o, s in rows], stores.OPS)


def read(store, spark, *keys):
    return {r.key: None if r.value is None else bytes(r.value).decode() for r in store.get(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}


def test_stores(spark, tmp_path):
    near, far = (stores.LogStore(spark, f"{tmp_path}/{n}") for n in ("near", "far"))
    assert read(near, spark, "a") == {"a": None}
    far.apply(ops_of(spark, ("a", "1", "set", 0), ("a", "2", "set", 1), ("b", "3", "set", 2)))
    far.apply(ops_of(spark, ("b", None, "delete", 0)))
    assert read(far, spark, "a", "b") == {"a": "2", "b": None}
    tiers = stores.TieredStore([near, far], populate_on_miss=True)
    assert read(tiers, spark, "a", "b") == {"a": "2", "b": None} and read(near, spark, "a", "b") == {"a": "2", "b": None}
    tiers.apply(ops_of(spark, ("c", "4", "set", 0)))
    assert read(near, spark, "c") == read(far, spark, "c") == {"c": "4"}
    tiers.flush()
    cache = stores.LruStore(stores.LogStore(spark, f"{tmp_path}/cache"), 2)
    cache.apply(ops_of(spark, ("a", "1", "set", 0), ("b", "2", "set", 1)))
    assert read(cache, spark, "a") == {"a": "1"}
    cache.apply(ops_of(spark, ("c", "3", "set", 0)))
    assert read(cache, spark, "a", "b", "c") == {"a": "1", "b": None, "c": "3"}
    failed = []
    slow = stores.DebouncedStore(stores.LogStore(spark, f"{tmp_path}/slow"), stores.DebounceOptions(10, 20, 100, 1, 1000, 50), lambda df: failed.append([r.seq for r in df.collect()]))
    slow.apply(ops_of(spark, ("a", "1", "set", 0), ("b", "2", "set", 1)).withColumn("at", F.lit(0).cast("long")).withColumn("duration", F.when(F.col("seq") == 1, 60).otherwise(1).cast("long")))
    assert read(slow, spark, "a", "b") == {"a": "1", "b": None} and failed == [[1]]


def test_line_files(spark, tmp_path):
    """Compressed lines with either end, a slot that is replaced as a whole, aborts that leave it alone."""
    with gzip.open(f"{tmp_path}/x.gz", "wb") as f:
        f.write(b"one\r\ntwo\n\nlast")
    assert [r.line for r in files.read_lines(spark, f"{tmp_path}/x.gz").orderBy("line_no").collect()] == ["one", "two", "", "last"]
    slot = files.Slot(spark, f"{tmp_path}/slot")
    assert slot.lines().count() == 0
    start = spark.createDataFrame([(i, f"l{i}") for i in range(6)], "line_no long, line string")
    slot.put(lambda path: files.rewrite_lines(start, lambda x: [x] * (int(x[1:]) % 3), path, trailer=["end"]))
    lines = sorted(["l1", "l2", "l2", "l4", "l5", "l5", "end"])
    assert sorted(r.line for r in slot.lines().collect()) == lines
    gone = threading.Event()
    gone.set()
    slow = lambda path: files.rewrite_lines(slot.lines(), lambda x: time.sleep(3) or [], path)
    for options in ({"timeout_ms": 100}, {"abort": gone}):
        with pytest.raises(control.Aborted):
            slot.put(slow, **options)
    with pytest.raises(ZeroDivisionError):
        slot.put(lambda path: 1 / 0)
    assert sorted(r.line for r in slot.lines().collect()) == lines
    slot.put(lambda path: files.rewrite_lines(slot.lines(), lambda x: [], path))
    assert slot.lines().count() == 0


def test_control(spark):
    started = time.monotonic()
    control.sleep(30)
    assert time.monotonic() - started >= 0.03
    assert control.limited(spark, lambda: spark.range(5).count(), timeout_ms=60_000) == 5
