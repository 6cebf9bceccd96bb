"""Scheduling semantics over request traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.replay import Debounce, DebouncedWriter, Limiter, Shared, replay


def token_bucket(trace: DataFrame, by: list[str], burst: int, micros_per_token: int, arrival: str = "arrival_us", order: str = "seq") -> DataFrame:
    """start_us and wait_us of FIFO requests to a bucket that starts full: request i waits for its token, the (i − j + 1 − burst)-th after any earlier arrival j.

    Without a rate (``micros_per_token`` 0) the burst starts on arrival and no other request ever does: its start is null.
    """
    w = Window.partitionBy(*by).orderBy(order)
    lane = trace.withColumn("_i", F.row_number().over(w).cast("long"))
    if not micros_per_token:
        start = F.when(F.col("_i") <= burst, F.max(arrival).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return lane.withColumn("start_us", start).withColumn("wait_us", F.col("start_us") - F.col(arrival)).drop("_i")
    running = F.max(F.col(arrival) - F.col("_i") * micros_per_token).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = F.greatest(F.col(arrival), running + (F.col("_i") + 1 - burst) * micros_per_token)
    return lane.withColumn("start_us", start).withColumn("wait_us", F.col("start_us") - F.col(arrival)).drop("_i")


def mutex(trace: DataFrame, key: str, arrival: str, duration: str, order: str) -> DataFrame:
    """start_us and end_us of jobs that hold their key one at a time in FIFO order."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.max(F.col(arrival) - before).over(w.rowsBetween(Window.unboundedPreceding, 0)) + before
    return trace.withColumn("start_us", start).withColumn("end_us", F.col("start_us") + F.col(duration))


def chunk_priority(chunks: DataFrame, base: float, by: list[str]) -> DataFrame:
    """priority base + i/n of the i-th of n chunks."""
    w = Window.partitionBy(*by)
    return chunks.withColumn("priority", F.lit(float(base)) + F.col("chunk_index") / F.count(F.lit(1)).over(w))


def debounce_sessions(writes: DataFrame, key: str, time: str, gap: int, order: str) -> DataFrame:
    """Bursts of writes to a key with less than ``gap`` between neighbours: first and last time, writes, and the last write's order."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(time) - F.lag(time).over(w) < gap, 0).otherwise(1)
    marked = writes.withColumn("_new", new).withColumn("_session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_session").agg(F.min(time).alias("first_us"), F.max(time).alias("last_us"), F.count(F.lit(1)).alias("n_writes"), F.max(order).alias("last_seq")).drop("_session")


def in_flight_dedupe(calls: DataFrame, call_id: str, start: str, end: str) -> DataFrame:
    """leader_start of each call: calls with the id of one under way share its result; the id is free again once that one ends."""
    return replay(calls.select(call_id, start, end), call_id, [start, end], lambda: Shared(start, end), f"{start} long, {end} long, leader_start long")


def limiter(trace: DataFrame, by: str, burst: int, per_second: float, slots: int) -> DataFrame:
    """start_us of each request (seq, arrival_us, duration_us, priority) under a token bucket and a cap on requests under way; lower priorities first, FIFO among equals, null last.

    Requests that never start (no rate, and the burst used up) have no row.
    """
    log = trace.select(by, "arrival_us", "seq", "duration_us", "priority")
    return replay(log, by, ["arrival_us", "seq"], lambda: Limiter(burst, per_second, slots), "seq long, start_us long")


def debounced_writes(ops: DataFrame, key: str, debounce: int, max_delay: int, staleness: int) -> DataFrame:
    """The upstream writes of a debounced store, with instant upstream and free tokens: written_at, seq and n_coalesced of each (key, at, seq).

    A key is due at min(last + debounce, first + max_delay); what waited longer than ``staleness`` since its last write is dropped.
    """
    return replay(ops.select(key, "at", "seq"), key, ["at", "seq"], lambda: Debounce(debounce, max_delay, staleness), "written_at long, seq long, n_coalesced long")


def debounced_store(ops: DataFrame, store: str, options) -> DataFrame:
    """The writes of whole stores (at, seq, key, op, duration): seq, outcome, started and ended, under ``options`` (see stores.DebounceOptions)."""
    log = ops.select(store, "at", "seq", "key", "op", "duration")
    return replay(log, store, ["at", "seq"], lambda: DebouncedWriter(options), "seq long, outcome string, started long, ended long")
