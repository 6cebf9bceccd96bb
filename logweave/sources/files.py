"""File sources and sinks: logs as partitioned Parquet, key-value lines as compressed text."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.model import LOG_SCHEMA
from logweave.operators import kv
from logweave.plans.control import limited


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def write_logs(logs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sorted within files by block, so that a range scan skips files and row groups by their statistics."""
    logs.repartitionByRange("block_number").sortWithinPartitions("block_number", "log_index").write.mode(mode).parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no and line of text files, plain or compressed; \\r\\n and a last line without end are fine."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Entries (line_no, raw, key, value) of a line map."""
    return kv.parse_lines(read_lines(spark, path))


def write_map(entries: DataFrame, path: str, codec: str = "gzip") -> None:
    """One sorted line an entry, by raw key."""
    line = F.concat(F.lit('{"key":'), "raw", F.lit(',"value":'), "value", F.lit("}"))
    entries.orderBy("raw").select(line.alias("value")).write.mode("overwrite").option("compression", codec).text(path)


def upsert_map(spark: SparkSession, path: str, pending: DataFrame, out: str) -> None:
    """The map at ``path`` with pending entries merged in, written to ``out``; readers switch paths when it is whole."""
    write_map(kv.merge_lines(read_map(spark, path), pending), out)


def rewrite_lines(lines: DataFrame, rewrite: Callable[[str], list[str]], out: str, codec: str = "gzip", trailer: list[str] | None = None) -> None:
    """Each line as any number of lines, then the lines of ``trailer``, written to a new path."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            if out := [x for line in frame["line"] for x in rewrite(line)]:
                yield pd.DataFrame({"value": out})

    done = lines.select("line").mapInPandas(run, "value string")
    if trailer:
        done = done.unionByName(lines.sparkSession.createDataFrame([(x,) for x in trailer], "value string"))
    done.write.mode("overwrite").option("compression", codec).text(out)


@dataclass
class Slot:
    """A place for lines that is replaced as a whole: each write goes to a folder of its own, and a pointer names the one that counts.

    Work that fails or is aborted leaves the pointer, and so what readers see, as it was.
    """

    spark: SparkSession
    path: str

    def _pointers(self) -> DataFrame:
        try:
            return self.spark.read.schema("n long, folder string").json(f"{self.path}/pointers")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], "n long, folder string")

    def current(self) -> str | None:
        last = self._pointers().orderBy(F.desc("n")).first()
        return last.folder if last else None

    def lines(self) -> DataFrame:
        folder = self.current()
        return self.spark.createDataFrame([], "line_no long, line string") if folder is None else read_lines(self.spark, folder)

    def put(self, write: Callable[[str], None], timeout_ms: float | None = None, abort: threading.Event | None = None) -> None:
        """Replace the lines by what ``write`` puts into the folder it is given."""
        folder = f"{self.path}/{uuid.uuid4().hex}"
        limited(self.spark, lambda: write(folder), timeout_ms, abort)
        n = self._pointers().agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        self.spark.createDataFrame([(n + 1, folder)], "n long, folder string").coalesce(1).write.mode("append").json(f"{self.path}/pointers")
