"""Record types: logs, filters and closed block ranges, and the views of the driver's tables as logs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("tx_hash", T.StringType()),
        T.StructField("tx_index", T.LongType()),
        T.StructField("block_hash", T.StringType()),
        T.StructField("log_index", T.LongType()),
        T.StructField("removed", T.BooleanType()),
    ]
)


class UnresolvableBlock(ValueError):
    """A block tag that no number stands for."""


def resolve_block(block: int | str, latest: int = 0) -> int:
    """The number of a block given as a number, a hex string, "earliest" or "latest"."""
    if isinstance(block, int):
        return block
    if block.startswith("0x"):
        return int(block, 16)
    if block in ("earliest", "latest"):
        return 0 if block == "earliest" else latest
    raise UnresolvableBlock(f"can't resolve block {block!r}")


@dataclass(frozen=True)
class LogFilter:
    """What to look for: addresses (none: any), topics by position (None: any; several: any of them), a block range or a block hash."""

    addresses: tuple[str, ...] | None = None
    topics: tuple[tuple[str, ...] | None, ...] = field(default=())
    from_block: int | str = "earliest"
    to_block: int | str = "latest"
    block_hash: str | None = None

    def bounds(self, tip: int) -> tuple[int, int]:
        """The range with its end clamped to the tip; it is empty if the first exceeds the second."""
        return resolve_block(self.from_block, tip), min(resolve_block(self.to_block, tip), tip)

    def predicate(self) -> Column:
        """Addresses and topics as a condition on canonical (lower-case) logs; the scan gets it as it is."""
        out = F.lit(True)
        if self.addresses is not None:
            out = out & F.col("address").isin([a.lower() for a in self.addresses])
        for i, wanted in enumerate(self.topics):
            if wanted is not None:  # a missing topic is null here, and so no match
                out = out & F.coalesce(F.get("topics", F.lit(i)).isin([t.lower() for t in wanted]), F.lit(False))
        return out


def canonical_logs(raw: DataFrame) -> DataFrame:
    """Logs as a node returns them (camel case, hex numbers) in LOG_SCHEMA: numbers as BIGINT, hex in lower case."""
    number = lambda c: F.conv(F.substring(F.col(c), 3, 16), 16, 10).cast("long")
    return raw.select(
        F.lower("address").alias("address"),
        F.transform("topics", F.lower).alias("topics"),
        F.lower("data").alias("data"),
        number("blockNumber").alias("block_number"),
        F.lower("transactionHash").alias("tx_hash"),
        number("transactionIndex").alias("tx_index"),
        F.lower("blockHash").alias("block_hash"),
        number("logIndex").alias("log_index"),
        "removed",
    )


def _hex(number: Column, width: int) -> Column:
    return F.concat(F.lit("0x"), F.lpad(number.cast("string"), width, "0"))


def event_logs(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The events (or some of them) as logs, four a block; no duplicates."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
    block = F.expr("event_id div 4")
    return e.select(
        _hex(F.col("user_id"), 40).alias("address"),
        F.array("event_type").alias("topics"),
        F.col("props").alias("data"),
        block.alias("block_number"),
        _hex(F.col("event_id"), 64).alias("tx_hash"),
        F.lit(0).cast("long").alias("tx_index"),
        _hex(block, 64).alias("block_hash"),
        (F.col("event_id") % 4).alias("log_index"),
        F.lit(False).alias("removed"),
    )


EVENT_LOGS_SQL = """
logs AS (
  SELECT '0x' || lpad(CAST(user_id AS VARCHAR), 40, '0') AS address, event_type AS topic0, props AS data, event_id // 4 AS block_number,
         '0x' || lpad(CAST(event_id AS VARCHAR), 64, '0') AS tx_hash, '0x' || lpad(CAST(event_id // 4 AS VARCHAR), 64, '0') AS block_hash,
         event_id % 4 AS log_index, event_id
  FROM events
)"""
