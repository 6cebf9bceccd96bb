"""Keyed stores in layers: change logs in Parquet, tiers with warm-up, codecs, buffered and debounced writes.

A store answers whole frames of keys and takes whole frames of operations (key, value, op: set or delete, seq).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import bins as B
from logweave.operators import kv, sched

OPS = "key string, value binary, op string, seq long"


class Store(Protocol):
    def get(self, keys: DataFrame) -> DataFrame:
        """key and value of each row of ``keys``; the value is null where there is none."""

    def apply(self, ops: DataFrame) -> None:
        """Carry out sets and deletes; of several for a key the one with the greatest seq counts."""

    def flush(self) -> None:
        """Returns once all operations before it are carried out."""


@dataclass
class LogStore:
    """A change log in Parquet files: writes append, reads take the last operation of each key."""

    spark: SparkSession
    path: str
    writes: int = 0

    def entries(self) -> DataFrame:
        """key and value of all keys that are set."""
        try:
            log = self.spark.read.schema(OPS + ", batch long").parquet(self.path)
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], "key string, value binary")
        return B.latest_per_key(log.withColumn("at", F.struct("batch", "seq")), "key", "at", "value", "op")

    def get(self, keys: DataFrame) -> DataFrame:
        return keys.select("key").join(self.entries(), "key", "left")

    def apply(self, ops: DataFrame) -> None:
        self.writes += 1
        last = ops.groupBy("key").agg(F.max_by(F.struct("value", "op"), "seq").alias("o"), F.max("seq").alias("seq"))
        last.select("key", "o.value", "o.op", "seq", F.lit(self.writes).cast("long").alias("batch")).write.mode("append").parquet(self.path)

    def flush(self) -> None:
        """Every write has ended when apply() returns."""


@dataclass
class TieredStore:
    """Stores from the nearest to the farthest: reads take the first that has a key, writes go to all."""

    tiers: list[Store]
    populate_on_miss: bool = False

    def get(self, keys: DataFrame) -> DataFrame:
        found = kv.tiered(keys.select("key").distinct(), [t.get(keys.select("key").distinct()) for t in self.tiers], "key", "value")
        if self.populate_on_miss:
            for i, tier in enumerate(self.tiers[:-1], 1):
                late = found.where(F.col("tier") > i)
                tier.apply(late.select("key", "value", F.lit("set").alias("op"), F.lit(0).cast("long").alias("seq")))
        return keys.select("key").join(found.select("key", "value"), "key", "left")

    def apply(self, ops: DataFrame) -> None:
        for tier in self.tiers:
            tier.apply(ops)

    def flush(self) -> None:
        for tier in self.tiers:
            tier.flush()


@dataclass(frozen=True)
class Codec:
    """How values are stored: two functions of a binary column. What can't be decoded is null."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


def _checked(value: Column) -> Column:
    """The value behind its checksum of eight hex digits, null if they disagree."""
    body = F.expr("substring(value, 9, octet_length(value))") if value is None else F.substring(value, F.lit(9), F.octet_length(value))
    return F.when(F.decode(F.substring(value, F.lit(1), F.lit(8)), "utf-8") == F.lpad(F.lower(F.hex(F.crc32(body))), 8, "0"), body)


#: Values behind a checksum, so that a damaged one reads as none.
CHECKED = Codec(lambda v: F.concat(F.encode(F.lpad(F.lower(F.hex(F.crc32(v))), 8, "0"), "utf-8"), v), _checked)


@dataclass
class CodedStore:
    """A store whose values pass a codec; a corrupt value reads as none."""

    store: Store
    codec: Codec = CHECKED

    def get(self, keys: DataFrame) -> DataFrame:
        return self.store.get(keys).select("key", self.codec.decode(F.col("value")).alias("value"))

    def apply(self, ops: DataFrame) -> None:
        self.store.apply(ops.withColumn("value", self.codec.encode(F.col("value"))))

    def flush(self) -> None:
        self.store.flush()


@dataclass
class LruStore:
    """A cache of at most ``budget`` bytes of values. Gets and sets are one log, replayed for what is still there."""

    store: LogStore
    budget: int
    log: list[DataFrame] = field(default_factory=list)

    def _note(self, rows: DataFrame, op: str | Column) -> None:
        op = F.lit(op) if isinstance(op, str) else op
        rows = rows.select(F.lit(len(self.log)).cast("long").alias("round"), "key", op.alias("op"), F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("bytes"), F.col("seq") if "seq" in rows.columns else F.lit(0).cast("long").alias("seq"))
        self.log.append(rows)

    def held(self) -> DataFrame:
        """The keys that the replay leaves."""
        if not self.log:
            return self.store.spark.createDataFrame([], "key string")
        ops = self.log[0]
        for more in self.log[1:]:
            ops = ops.unionByName(more)
        return kv.lru_keys(ops.withColumn("cache_id", F.lit(0)).withColumn("at", F.struct("round", "seq", "key")), self.budget)

    def get(self, keys: DataFrame) -> DataFrame:
        found = self.store.get(keys).join(self.held().select("key", F.lit(True).alias("held")), "key", "left")
        found = found.select("key", F.when(F.col("held"), F.col("value")).alias("value"))
        self._note(found.where("value IS NOT NULL"), "get")
        return found

    def apply(self, ops: DataFrame) -> None:
        self.store.apply(ops)
        self._note(ops, F.col("op"))

    def flush(self) -> None:
        self.store.flush()


@dataclass(frozen=True)
class DebounceOptions:
    """Times in milliseconds; a key's deadline is debounce after its last write, but no later than max_delay after its first."""

    debounce: int
    max_delay: int
    max_staleness: int
    burst: int
    per_second: float
    timeout: int = 10_000


@dataclass
class DebouncedStore:
    """A store behind a write buffer. The trace of operations (with at, in milliseconds) is scheduled as one; reads don't see the buffer."""

    store: Store
    options: DebounceOptions
    on_write_error: Callable[[DataFrame], None] | None = None

    def get(self, keys: DataFrame) -> DataFrame:
        return self.store.get(keys)

    def apply(self, ops: DataFrame) -> None:
        if "at" not in ops.columns:
            ops = ops.withColumn("at", F.lit(0).cast("long"))
        if "duration" not in ops.columns:
            ops = ops.withColumn("duration", F.lit(0).cast("long"))
        written = sched.debounced_store(ops.withColumn("store", F.lit(0)), "store", self.options)
        done = written.where("outcome = 'written'").select("seq")
        self.store.apply(ops.drop("at", "duration").join(done, "seq", "left_semi"))
        if self.on_write_error:
            self.on_write_error(written.where("outcome = 'timeout'"))

    def flush(self) -> None:
        self.store.flush()


#: The optimised stack's fixed values: cache bytes, debounce, delay, staleness, burst and writes a second.
OPTIMISED = (1 << 28, DebounceOptions(500, 2000, 30_000, 3, 300.0))


def optimised(remote: Store, cache: LogStore, on_write_error: Callable[[DataFrame], None] | None = None) -> TieredStore:
    """A byte-bounded cache in front of a debounced remote store; reads warm the cache."""
    budget, options = OPTIMISED
    return TieredStore([LruStore(cache, budget), DebouncedStore(remote, options, on_write_error)], populate_on_miss=True)
