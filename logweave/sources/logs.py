"""Sources of logs: what a query asks for a filter and ranges, and how layers are put around one another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import scalars as S
from logweave.model import LogFilter, event_logs
from logweave.operators import ranges as R

Range = tuple[int, int]
#: Ranges (or bins) that a predicate holds; beyond them a join takes their place.
MOST_RANGES = 500


class SourceError(Exception):
    """What a source answers in place of logs."""

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.code = code

    def is_range_error(self) -> bool:
        return S.says_range_error(self.code, str(self))


class Source(Protocol):
    """Anything that gives logs: the base of a query, or a layer around another source."""

    def tip(self) -> int: ...

    def logs(self, wanted: LogFilter, ranges: list[Range]) -> DataFrame:
        """The logs of closed ranges of blocks; raises SourceError where it won't answer."""

    def block(self, wanted: LogFilter) -> DataFrame:
        """The logs of the block with the filter's hash."""


def layered(base: Source, *layers: Callable[[Source], Source]) -> Source:
    """``base`` with each layer around the one before."""
    return reduce(lambda source, layer: layer(source), layers, base)


def any_range(column: Column, ranges: list[Range]) -> Column:
    """Whether a number lies in one of the ranges: comparisons with literals, which reach the file scan."""
    return reduce(lambda a, b: a | b, [column.between(a, b) for a, b in ranges], F.lit(False))


@dataclass(frozen=True)
class TableSource:
    """Logs in a DataFrame of LOG_SCHEMA; filters are pushed down as far as its scan takes them."""

    table: DataFrame

    def tip(self) -> int:
        return self.table.agg(F.coalesce(F.max("block_number"), F.lit(0))).first()[0]

    def logs(self, wanted: LogFilter, ranges: list[Range]) -> DataFrame:
        return within(self.table, "block_number", ranges).where(wanted.predicate())

    def block(self, wanted: LogFilter) -> DataFrame:
        return self.table.where((F.col("block_hash") == wanted.block_hash) & wanted.predicate())


def within(table: DataFrame, column: str, ranges: list[Range]) -> DataFrame:
    """The rows of any_range() while the ranges are few, else those in their hull that a binary search in their broadcast bounds finds."""
    if len(ranges) <= MOST_RANGES:
        return table.where(any_range(F.col(column), ranges))
    ranges = R.merged([(int(a), int(b)) for a, b in ranges if a <= b])
    if not ranges:
        return table.where(F.lit(False))
    bounds = table.sparkSession.createDataFrame([([a for a, _ in ranges], [b for _, b in ranges])], "_lows array<long>, _highs array<long>")
    # How many ranges start up to the number: the sum of those powers of two at which one still does. get() is null outside the bounds.
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(len(ranges).bit_length()))])
    longer = lambda n, step: F.when(F.get("_lows", n + step - 1) <= F.col(column), n + step).otherwise(n)
    inside = F.aggregate(powers, F.lit(0), longer, lambda n: F.get("_highs", n - 1) >= F.col(column))
    return table.where(F.col(column).between(ranges[0][0], ranges[-1][1])).join(F.broadcast(bounds), inside, "left_semi")


@dataclass(frozen=True)
class EventSource:
    """The driver's events as logs, four a block. Ranges, hashes, topics and addresses become conditions on the columns of the file."""

    spark: SparkSession
    sf_dir: str

    def _events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    def tip(self) -> int:
        return self._events().agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] // 4

    def _view(self, wanted: LogFilter, events: DataFrame) -> DataFrame:
        if wanted.addresses is not None:
            users = [int(a[2:]) for a in wanted.addresses if a.startswith("0x") and a[2:].isdecimal()]
            events = events.where(F.col("user_id").isin(users))
        if wanted.topics and wanted.topics[0] is not None:
            events = events.where(F.col("event_type").isin([t.lower() for t in wanted.topics[0]]))
        rest = replace(wanted, addresses=None, topics=(None, *wanted.topics[1:]) if wanted.topics else ())
        return event_logs(self.spark, self.sf_dir, events).where(rest.predicate())

    def logs(self, wanted: LogFilter, ranges: list[Range]) -> DataFrame:
        events = self._events()
        return self._view(wanted, within(events, "event_id", [(4 * a, 4 * b + 3) for a, b in ranges]))

    def block(self, wanted: LogFilter) -> DataFrame:
        digits = wanted.block_hash[2:]
        number = int(digits) if digits.isdecimal() else -1
        return self.logs(wanted, [(number, number)]).where(F.col("block_hash") == wanted.block_hash)


@dataclass(frozen=True)
class NarrowSource:
    """A source that refuses ranges of more than ``most`` blocks."""

    base: Source
    most: int

    def tip(self) -> int:
        return self.base.tip()

    def logs(self, wanted: LogFilter, ranges: list[Range]) -> DataFrame:
        if any(b - a + 1 > self.most for a, b in ranges):
            raise SourceError(f"exceeds max block range of {self.most}", -32005)
        return self.base.logs(wanted, ranges)

    def block(self, wanted: LogFilter) -> DataFrame:
        return self.base.block(wanted)


@dataclass(frozen=True)
class SievedSource:
    """A source without the logs whose JSON form has more than ``most`` bytes."""

    base: Source
    most: int

    def __post_init__(self):
        if not isinstance(self.most, int) or self.most < 1:
            raise ValueError("the limit is a positive integer")

    def tip(self) -> int:
        return self.base.tip()

    def _sieve(self, logs: DataFrame) -> DataFrame:
        return logs.where(S.estimate_bytes(S.node_log(), S.NODE_LOG_TYPE) <= self.most)

    def logs(self, wanted: LogFilter, ranges: list[Range]) -> DataFrame:
        return self._sieve(self.base.logs(wanted, ranges))

    def block(self, wanted: LogFilter) -> DataFrame:
        return self._sieve(self.base.block(wanted))
