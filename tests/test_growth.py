"""Queries over more rows than the tables of the other tests hold."""

import glob
import random
import time

from pyspark.sql import functions as F

from logweave import catalog
from logweave.model import LogFilter, event_logs
from logweave.operators import bins as B
from logweave.operators import stores
from logweave.operators.replay import DebouncedWriter
from logweave.sources.bins import BinStore
from logweave.sources.logs import TableSource


def test_a_full_write_buffer_costs_no_scan_for_each_write():
    writer, n, began = DebouncedWriter(stores.DebounceOptions(500, 2000, 1_000_000, 3, 300.0)), 20_000, time.monotonic()
    got = [r for i in range(n) for r in writer.feed({"at": 0, "seq": i, "key": str(i), "op": "set", "duration": 0})] + writer.close()
    assert sorted(r[0] for r in got if r[1] == "written") == list(range(n))
    assert time.monotonic() - began < 60  # with a scan for each write this takes many minutes


def test_cached_stack_keeps_more_keys_than_staleness_lets_it_write_at_once(spark, tmp_path):
    n = 12_000
    spark.range(n).select(F.col("id").alias("c_custkey"), F.concat(F.lit("n"), "id").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.key, r.value) for r in catalog.cached_stack(spark, str(tmp_path)).collect()}
    assert got == {(str(k), f"n{k}" if k % 4 else None) for k in range(0, n, 6)}


def blocks(spark, n):
    """Logs of ``n`` blocks, one in each."""
    return event_logs(spark, "", spark.range(n).select((F.col("id") * 4).alias("event_id"), F.lit(1).alias("user_id"), F.lit("error").alias("event_type"), F.lit("").alias("props")))


def test_many_ranges_are_searched_not_compared_one_by_one(spark):
    rng = random.Random(8)
    ranges = [(a, a + rng.randint(-1, 3)) for a in (rng.randint(-50, 40_000) for _ in range(3000))]
    got = TableSource(blocks(spark, 40_000)).logs(LogFilter(), ranges)
    wanted = {b for a, e in ranges for b in range(a, e + 1) if 0 <= b < 40_000}
    assert sorted(r.block_number for r in got.select("block_number").collect()) == sorted(wanted)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "filter(" not in plan
    assert TableSource(blocks(spark, 10)).logs(LogFilter(), [(5, 4)] * 600).count() == 0


def test_bins_are_not_a_file_each(spark, tmp_path):
    store, logs = BinStore(spark, str(tmp_path)), B.bin_logs(blocks(spark, 7000), 10)
    store.write(logs, [(s, s + 9, 1, 100) for s in range(0, 7000, 10)])
    assert len(glob.glob(f"{tmp_path}/logs/**/*.parquet", recursive=True)) <= 4
    store.write(logs.where("bin_start < 100 AND block_number % 10 = 0"), [(s, s + 9, 2, 200) for s in range(0, 100, 10)])
    few = store.read([50, 6000])
    assert sorted(r.block_number for r in few.collect()) == [50, *range(6000, 6010)]
    assert "bin_start" in few._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("ReadSchema")[0]
    many = store.read(list(range(0, 6990, 10)))
    assert sorted(r.block_number for r in many.select("block_number").collect()) == [*range(0, 100, 10), *range(100, 6990)]


def test_the_cached_query_stores_bins_of_many_blocks_in_few_files(spark, tmp_path):
    n = 40_000
    spark.range(n).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.lit("error").alias("event_type"), F.lit("").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    store = catalog.earlier_bins(spark, str(tmp_path))
    held = {r.bin_start: r.fetched_to for r in store.manifest().collect()}
    assert held == {s: s + 49 - (s % 450 == 0) for s in range(0, n // 4, 150)}
    folder = store.path.removeprefix("file://")
    assert len(glob.glob(f"{folder}/logs/**/*.parquet", recursive=True)) <= 4
    assert store.read(list(held)).count() == 4 * sum(e - s + 1 for s, e in held.items())
    assert catalog.cached_range_query(spark, str(tmp_path)).count() == 4 * 1901
