"""Log queries: a divided scan, and a cached scan over materialised bins and gaps.

Ranges, chunks and bins are control data: a few numbers for each ten thousand blocks, handled on the driver.
Logs stay in DataFrames. All ranges that a source accepts become one scan with their bounds as pushed-down
comparisons; stored bins lie sorted in files, and those that answer are pushed down too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import scalars as S
from logweave.model import LogFilter
from logweave.operators import bins as B
from logweave.operators import ranges as R
from logweave.sources.bins import BinStore
from logweave.sources.logs import Range, Source, SourceError

SORT = ("block_number", "log_index")


def size_sieve(logs: DataFrame, most: int) -> DataFrame:
    """Logs whose JSON form has at most ``most`` bytes."""
    if not isinstance(most, int) or most < 1:
        raise ValueError("the limit is a positive integer")
    return logs.where(S.estimate_bytes(S.node_log(), S.NODE_LOG_TYPE) <= most)


@dataclass(frozen=True)
class Response:
    """One answered range: its logs before the trim to the range asked for, and when it was fetched."""

    logs: DataFrame
    from_block: int
    to_block: int
    fetched_at: int
    fetched_at_block: int
    priority: float


OnResponse = Callable[[Response], None]


@dataclass
class DividedQuery:
    """A filter over a source in aligned chunks. A chunk that the source finds too wide is halved until it answers."""

    filter: LogFilter
    max_range: int | None = None
    align: int | None = None
    priority: float = 0.0

    def responses(self, source: Source, tip: int | None = None, now_ms: int = 0) -> Iterator[Response]:
        """The answered ranges in order. Chunks and their halves end at the tip; those beyond it aren't asked for."""
        tip = source.tip() if tip is None else tip
        low, high = self.filter.bounds(tip)
        chunks = R.chunks_of(low, high, self.max_range, self.align)
        for i, (a, b) in enumerate(chunks):
            yield from self._fetch(source, (a, b), tip, now_ms, self.priority + i / len(chunks))

    def _fetch(self, source: Source, chunk: Range, tip: int, now_ms: int, priority: float) -> Iterator[Response]:
        open_ = [chunk]
        while open_:
            a, b = open_.pop()
            b = min(b, tip)
            if a > b:
                continue
            try:
                logs = source.logs(self.filter, [(a, b)])
            except SourceError as error:
                if not error.is_range_error() or a == b:
                    raise SourceError(f"[{a}, {b}]: {error}", error.code) from error
                middle = a + (b - a + 1) // 2 - 1
                open_ += [(middle + 1, b), (a, middle)]
                continue
            yield Response(logs, a, b, now_ms, tip, priority)

    def execute(self, source: Source, tip: int | None = None, on_response: OnResponse | None = None, only: bool = False, now_ms: int = 0) -> DataFrame:
        """The logs in order. ``on_response`` gets each answered range first; with ``only`` the result is empty."""
        if self.filter.block_hash:
            return source.block(self.filter)
        tip = source.tip() if tip is None else tip
        low, high = self.filter.bounds(tip)
        answered: list[Response] = []
        for response in self.responses(source, tip, now_ms) if low <= high else ():
            if on_response:
                on_response(response)
            answered.append(response)
        if only or not answered:
            return source.logs(self.filter, [(0, 0)]).limit(0)
        try:  # all ranges in one scan, if the source takes them together
            logs = source.logs(self.filter, R.merged([(r.from_block, r.to_block) for r in answered]))
        except SourceError:
            logs = answered[0].logs
            for r in answered[1:]:
                logs = logs.unionByName(r.logs)
        return logs.where(F.col("block_number").between(low, high)).orderBy(*SORT)


@dataclass
class CachedQuery:
    """A filter over a source and its materialised bins: hits come from the store, the other bins as merged gaps from the source."""

    filter: LogFilter
    bin_size: int = 10_000
    invalidation: Callable[[Column, Column, Column], Column] | None = None
    max_range: int | None = None
    chain: int = 1
    options: dict = field(default_factory=dict)

    def wanted(self, spark, low: int, high: int) -> DataFrame:
        one = spark.createDataFrame([(low, high)], "from_block long, to_block long")
        return R.divide(one, self.bin_size, self.bin_size).select(F.col("from_block").alias("bin_start"), F.col("to_block").alias("bin_end"))

    def plan(self, manifest: DataFrame, tip: int, now_ms: int = 0, draw: Column | None = None) -> tuple[DataFrame, DataFrame, Range]:
        """Hit bins, merged gaps, and the range asked for."""
        low, high = self.filter.bounds(tip)
        wanted = self.wanted(manifest.sparkSession, low, high)
        chance = None
        if self.invalidation:
            count = F.lit((high // self.bin_size) - (low // self.bin_size) + 1)
            chance = self.invalidation(F.col("fetched_at_block") - F.col("fetched_to"), F.lit(now_ms) - F.col("fetched_at"), count)
        hits, gaps = B.hits_and_gaps(wanted, manifest, chance, draw)
        return hits, gaps, (low, high)

    def execute(self, source: Source, store: BinStore, tip: int | None = None, now_ms: int = 0, draw: Column | None = None) -> DataFrame:
        """Stored and fetched logs, trimmed to the range and sorted.

        Gaps are fetched in a divided query. Bins that its answers complete are written before they are read,
        so the source is scanned once for them; what stays incomplete (the bin of the tip) is scanned in place.
        """
        if self.filter.block_hash:
            return source.block(self.filter)
        tip = source.tip() if tip is None else tip
        low, high = self.filter.bounds(tip)
        if low > high:
            return source.logs(self.filter, [(0, 0)]).limit(0)
        hits, gaps, _ = self.plan(store.manifest(), tip, now_ms, draw)
        hits, gaps = [r.bin_start for r in hits.collect()], [tuple(r) for r in gaps.select("from_block", "to_block").collect()]  # bins and ranges, no logs
        answered: list[Response] = []
        for a, b in sorted(gaps):
            part = DividedQuery(LogFilter(self.filter.addresses, self.filter.topics, a, b), self.max_range, self.bin_size if self.max_range else None)
            try:
                answered += part.responses(source, tip, now_ms)
            except SourceError as error:
                raise SourceError(f"{len(gaps)} gaps {sorted(gaps)}: {error}", error.code) from error
        new, rest = self._complete(answered)
        if new:
            ranges = R.merged([(s, s + self.bin_size - 1) for s in new])
            logs = B.first_wins(self._union(source, answered, ranges), ["block_hash", "log_index"], ["block_number"])
            store.write(B.bin_logs(logs, self.bin_size), [(s, s + self.bin_size - 1, now_ms, tip) for s in new])
        out = store.read(sorted({*hits, *new}))
        if rest:
            out = out.unionByName(self._union(source, answered, rest).select(*out.columns))
        return out.where(F.col("block_number").between(low, high)).orderBy(*SORT)

    def _complete(self, answered: list[Response]) -> tuple[list[int], list[Range]]:
        """The bins that the answered ranges cover as a whole, and the ranges in other bins."""
        new, rest = [], []
        for a, b in R.merged([(r.from_block, r.to_block) for r in answered]):
            first, last = -(-a // self.bin_size) * self.bin_size, (b + 1) // self.bin_size * self.bin_size
            new += range(first, last, self.bin_size)
            rest += [(a, b)] if first >= last else [r for r in ((a, first - 1), (last, b)) if r[0] <= r[1]]
        return new, rest

    def _union(self, source: Source, answered: list[Response], ranges: list[Range]) -> DataFrame:
        try:
            return source.logs(self.filter, ranges)
        except SourceError:  # refused as a whole: as it was answered
            inside = F.lit(False)
            for a, b in ranges:
                inside = inside | F.col("block_number").between(a, b)
            logs = answered[0].logs
            for r in answered[1:]:
                logs = logs.unionByName(r.logs)
            return logs.where(inside)
