"""The store of materialised bins: logs as Parquet partitioned by write and sorted by bin, and a manifest of what is complete.

A write adds its logs under an id of its own and names it in the manifest last, so a reader sees either none
of it or all, and a bin that is fetched anew replaces what was there even if fewer logs came.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.model import LOG_SCHEMA
from logweave.sources.logs import MOST_RANGES

MANIFEST = "bin_start long, fetched_to long, fetched_at long, fetched_at_block long, write string, seq long"


@dataclass(frozen=True)
class BinStore:
    """The bins of one filter, in a folder named by its key."""

    spark: SparkSession
    path: str

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], MANIFEST)

    def manifest(self) -> DataFrame:
        """bin_start, fetched_to, fetched_at, fetched_at_block and write of the last write of each bin."""
        last = self._rows().groupBy("bin_start").agg(F.max_by(F.struct("fetched_to", "fetched_at", "fetched_at_block", "write"), "seq").alias("m"))
        return last.select("bin_start", "m.*")

    def write(self, logs: DataFrame, bins: list[tuple[int, int, int, int]] | DataFrame) -> None:
        """Store the bins (start, end, fetched at, at block) with their logs, which have bin_start beside the log columns."""
        if isinstance(bins, list):
            bins = self.spark.createDataFrame(bins, "bin_start long, fetched_to long, fetched_at long, fetched_at_block long")
        write, before = uuid.uuid4().hex, self._rows().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        # Each file holds whole bins of one range, sorted, so that a read skips files and row groups by their statistics; a file for each bin would make as many as there are bins.
        logs.repartitionByRange("bin_start").sortWithinPartitions("bin_start", "block_number", "log_index").write.mode("append").parquet(f"{self.path}/logs/write={write}")
        rows = bins.select("bin_start", "fetched_to", "fetched_at", "fetched_at_block", F.lit(write).alias("write"), F.lit(before + 1).cast("long").alias("seq"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self, starts: list[int]) -> DataFrame:
        """The logs of stored bins. Writes are partitions and bins are pushed down: the scan leaves others out."""
        columns = LOG_SCHEMA.names
        if not starts:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        held, few = self.manifest().select("bin_start", "write"), len(starts) <= MOST_RANGES
        rows = {r.bin_start: r.write for r in (held.where(F.col("bin_start").isin(starts)) if few else held).collect()}
        by_write: dict[str, list[int]] = {}
        for s in starts:
            by_write.setdefault(rows[s], []).append(s)
        schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in LOG_SCHEMA) + "bin_start long, write string"
        try:
            logs = self.spark.read.schema(schema).parquet(f"{self.path}/logs")
        except AnalysisException:  # bins without any log
            return self.spark.createDataFrame([], LOG_SCHEMA)
        if not few:
            wanted = self.spark.createDataFrame([(w, s) for w, some in by_write.items() for s in some], "write string, bin_start long")
            hull = logs.where(F.col("write").isin(list(by_write)) & F.col("bin_start").between(min(starts), max(starts)))
            return hull.join(F.broadcast(wanted), ["write", "bin_start"], "left_semi").select(*columns)
        kept = F.lit(False)
        for write, some in by_write.items():
            kept = kept | ((F.col("write") == write) & F.col("bin_start").isin(some))
        return logs.where(kept).select(*columns)
