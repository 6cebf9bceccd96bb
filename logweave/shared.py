"""The folder that driver and executors share, for what queries write and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of this application that every executor sees, in spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder and a cluster an error: its machines don't
    share a local one. The folder goes when the driver ends.
    """
    sc = spark.sparkContext
    root = getattr(sc, "_logweave_root", None)
    if root is None:
        base = sc.getConf().get("spark.checkpoint.dir")
        if base is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="logweave-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            base = f"file://{base}"
        root = sc._logweave_root = f"{base.rstrip('/')}/logweave-{sc.applicationId}-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
