"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of the word contracts.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: What bounded() lets a broadcast hold.
BROADCAST_BYTES = 32 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Stands for a null id inside joins; sorts after every real id.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of this application that every executor sees, in spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder and a cluster an error: its machines don't
    share a local one. The folder goes when the driver ends.
    """
    root = getattr(spark.sparkContext, "_logweave_shared", None)
    if root is None:
        sc = spark.sparkContext
        base = sc.getConf().get("spark.checkpoint.dir")
        if base is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="logweave-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            base = f"file://{base}"
        root = sc._logweave_shared = f"{base.rstrip('/')}/logweave-{sc.applicationId}-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, so a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._logweave_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from written() that nothing will read again; what was made of them is written itself."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._logweave_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hand the memory that a worker's task has freed back to the system: workers live on for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, so that extra columns of callers never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def fields_of(struct: str, names: list[str]) -> list[Column]:
    """The fields of a struct as columns of their own, whatever their names hold."""
    return [F.col(struct)[name].alias(name) for name in names]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, to decide ties the same way in every run. Columns that hold maps have no hash and don't count."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def bounded(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows it; beyond that it is joined by a shuffle."""
    size = df.select(F.coalesce(F.sum(row_bytes + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
