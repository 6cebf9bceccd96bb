"""Control of running work: time limits and aborts of Spark jobs, and waiting."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Aborted(Exception):
    """The work was given up; what it would have replaced is as it was."""


def sleep(ms: float) -> None:
    time.sleep(ms / 1000)


def limited(spark: SparkSession, work: Callable[[], Any], timeout_ms: float | None = None, abort: threading.Event | None = None) -> Any:
    """The result of ``work``, whose Spark jobs are cancelled when the time is over or ``abort`` is set."""
    tag, done, out = f"logweave-{uuid.uuid4().hex}", threading.Event(), {}

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            out["value"] = work()
        except Exception as error:  # handed on to the caller
            out["error"] = error
        finally:
            spark.sparkContext.removeJobTag(tag)
            done.set()

    InheritableThread(target=run, daemon=True).start()
    end = None if timeout_ms is None else time.monotonic() + timeout_ms / 1000
    while not done.wait(0.02):
        if (end is not None and time.monotonic() > end) or (abort is not None and abort.is_set()):
            spark.sparkContext.cancelJobsWithTag(tag)
            raise Aborted("aborted" if abort is not None and abort.is_set() else f"no result within {timeout_ms} ms")
    if "error" in out:
        raise out["error"]
    return out["value"]
