"""Structured Streaming forms: sieve and first-wins dedupe, block bins, debounce sessions, stateful bin completion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.operators import ranges as R


def sieve_and_dedupe(logs: DataFrame, most_bytes: Callable[[DataFrame], DataFrame], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Small logs, the first of each (block_hash, log_index) within the watermark."""
    return most_bytes(logs).withWatermark(time, delay).dropDuplicatesWithinWatermark(["block_hash", "log_index"])


def in_flight(calls: DataFrame, call_id: str, time: str, delay: str) -> DataFrame:
    """One call for each id within the watermark."""
    return calls.withWatermark(time, delay).dropDuplicatesWithinWatermark([call_id])


def block_bins(logs: DataFrame, size: int) -> DataFrame:
    return logs.groupBy(R.align_down(F.col("block_number"), size).alias("bin_start")).agg(F.count(F.lit(1)).alias("n_logs"))


def debounce(writes: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """The last value of each burst of writes to a key; the last open burst waits for the watermark."""
    window = F.session_window(time, gap)
    return writes.withWatermark(time, delay).groupBy(key, window).agg(F.max_by("value", time).alias("value"), F.count(F.lit(1)).alias("n_writes"))


class BinCompletion(StatefulProcessor):
    """Covered ranges of one bin until they are the whole bin; then one row, and the state is forgotten."""

    OUTPUT = T.StructType([T.StructField(n, T.LongType()) for n in ("bin_start", "bin_end", "fetched_at", "fetched_at_block")])

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bin", T.StructType([T.StructField("ranges", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("at", T.LongType()), T.StructField("block", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = key[0]
        held = self.state.get() if self.state.exists() else ([], 0, 0)
        ranges, at, block = [tuple(r) for r in held[0]], held[1], held[2]
        for frame in rows:
            ranges += list(zip(frame.covered_from, frame.covered_to, strict=True))
            at, block = max(at, int(frame.fetched_at.max())), max(block, int(frame.fetched_at_block.max()))
        merged: list[list[int]] = []
        for a, b in sorted((int(a), int(b)) for a, b in ranges):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        if merged and merged[0][0] <= start and merged[0][1] >= start + self.size - 1:
            self.state.clear()
            yield pd.DataFrame({"bin_start": [start], "bin_end": [start + self.size - 1], "fetched_at": [at], "fetched_at_block": [block]})
        else:
            self.state.update((merged, at, block))

    def close(self) -> None:
        pass


def complete_bins(parts: DataFrame, size: int) -> DataFrame:
    """Bins as they complete, from a stream of fan_out() rows (bin_start, covered_from, covered_to, fetched_at, fetched_at_block)."""
    return parts.groupBy("bin_start").transformWithStateInPandas(BinCompletion(size), BinCompletion.OUTPUT, "Append", "None")


def progressive(stream: DataFrame, on_response: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch to ``on_response`` as it arrives."""
    return stream.writeStream.foreachBatch(on_response).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
