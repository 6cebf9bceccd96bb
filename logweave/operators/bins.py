"""Materialised bins: assignment, accumulation, completeness, hits and gaps, write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators import ranges as R


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in ``order``; one aggregate with partial minima instead of a sort of every key."""
    rest = [c for c in rows.columns if c not in keys]
    whole = F.struct(*[F.col(c) for c in rest])
    return rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def fan_out(responses: DataFrame, size: int) -> DataFrame:
    """The part of each response (from_block, to_block) that lies in each bin it touches: bin_start, covered_from, covered_to."""
    first, last = R.align_down(F.col("from_block"), size), R.align_down(F.col("to_block"), size)
    keep = [c for c in responses.columns if c not in ("from_block", "to_block")]
    out = responses.where("from_block <= to_block").select(*keep, "from_block", "to_block", F.explode(F.sequence(first, last, F.lit(size).cast("long"))).alias("bin_start"))
    return out.select(*keep, "bin_start", F.greatest("from_block", "bin_start").alias("covered_from"), F.least(F.col("to_block"), F.col("bin_start") + size - 1).alias("covered_to"))


def complete_bins(responses: DataFrame, size: int) -> DataFrame:
    """bin_start, bin_end, fetched_at, fetched_at_block of the bins whose merged coverage is the whole bin. A bin past the tip never completes."""
    parts = fan_out(responses, size)
    merged = R.merge(parts.select("bin_start", F.col("covered_from").alias("from_block"), F.col("covered_to").alias("to_block")), ["bin_start"])
    whole = merged.groupBy("bin_start").agg(F.count(F.lit(1)).alias("n"), F.min("from_block").alias("a"), F.max("to_block").alias("b"))
    whole = whole.where((F.col("n") == 1) & (F.col("a") <= F.col("bin_start")) & (F.col("b") >= F.col("bin_start") + size - 1)).select("bin_start")
    stamps = parts.groupBy("bin_start").agg(F.max("fetched_at").alias("fetched_at"), F.max("fetched_at_block").alias("fetched_at_block"))
    return stamps.join(whole, "bin_start").select("bin_start", (F.col("bin_start") + size - 1).alias("bin_end"), "fetched_at", "fetched_at_block")


def bin_logs(logs: DataFrame, size: int) -> DataFrame:
    return logs.withColumn("bin_start", R.align_down(F.col("block_number"), size))


def hits_and_gaps(wanted: DataFrame, manifest: DataFrame, chance: Column | None = None, draw: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Wanted bins (bin_start, bin_end) that the manifest answers, and the merged ranges of the others.

    A bin misses if nothing is stored, if what is stored ends early, or if ``draw`` falls below its ``chance`` of invalidation.
    """
    looked = wanted.join(manifest.select("bin_start", "fetched_to", *[c for c in manifest.columns if c not in ("bin_start", "fetched_to", "bin_end")]), "bin_start", "left")
    stale = F.lit(False) if chance is None else (draw if draw is not None else F.rand()) < chance
    hit = F.coalesce((F.col("fetched_to") >= F.col("bin_end")) & ~stale, F.lit(False))
    gaps = R.merge(looked.where(~hit).select(F.col("bin_start").alias("from_block"), F.col("bin_end").alias("to_block")))
    return looked.where(hit).select("bin_start", "bin_end"), gaps


def write_bins(logs: DataFrame, manifest: DataFrame, path: str) -> None:
    """Replace the bins of ``manifest`` under ``path``: dynamic partition overwrite, so other bins stay and a repeated write changes nothing."""
    done = logs.join(manifest.select("bin_start"), "bin_start", "left_semi")
    for frame, name in ((done, "logs"), (manifest, "manifest")):
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bin_start").parquet(f"{path}/{name}")


def latest_per_key(changes: DataFrame, key: str, order: str, value: str, op: str | None = None) -> DataFrame:
    """The last value of each key; keys whose last operation is a delete are gone."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(value, *([op] if op else [])), F.col(order)).alias("_last"))
    kept = last.where(F.col(f"_last.{op}") != "delete") if op else last
    return kept.select(key, F.col(f"_last.{value}").alias(value))
