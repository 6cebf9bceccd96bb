"""The algebra of closed integer ranges, on columns and on DataFrames of (from_block, to_block)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.replay import Boundary, replay

LONG = "long"


def chunks_of(low: int, high: int, most: int | None, align: int | None = None) -> list[tuple[int, int]]:
    """divide() of one range, on the driver."""
    if most is not None and most < 1:
        raise ValueError("a chunk has at least one block")
    if low > high:
        return []
    if align:
        low, high = low - low % align, high - high % align + align - 1
    step = most or high - low + 1
    return [(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """merge() of a query's few ranges, on the driver."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with their number, from 1, in the order of ``by`` (no repeats): sorted by ranges, numbered in each, and set off by the sizes of the ranges before."""
    part = rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id())
    bounds = part.groupBy("_part").agg(F.min(by).alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    bounds = F.broadcast(bounds.select("_low", F.coalesce(before, F.lit(0)).alias("_before"), F.coalesce(F.lead("_low").over(Window.orderBy("_low")), F.lit(None)).alias("_next")))
    # The second pass may deal rows to other partitions; their range is found by their value.
    held = rows.join(bounds, (F.col(by) >= F.col("_low")) & (F.col("_next").isNull() | (F.col(by) < F.col("_next"))))
    within = F.row_number().over(Window.partitionBy("_low").orderBy(by))
    return held.withColumn(name, (within + F.col("_before")).cast(LONG)).drop("_low", "_next", "_before")


def in_range(block: Column, low: Column | int, high: Column | int) -> Column:
    """Whether a block lies in the closed range; a missing block never does."""
    return F.coalesce(block.between(low, high), F.lit(False))


def align_down(block: Column, size: int) -> Column:
    return (block - F.pmod(block, F.lit(size))).cast(LONG)


def divide(ranges: DataFrame, most: int | None, align: int | None = None) -> DataFrame:
    """Each range as chunks of ``most`` blocks (None: one chunk), numbered by chunk_index.

    With ``align`` the start moves down and the end up to multiples first; chunks step from the aligned start.
    """
    if most is not None and most < 1:
        raise ValueError("a chunk has at least one block")
    low, high = F.col("from_block"), F.col("to_block")
    start = align_down(low, align) if align else low
    end = align_down(high, align) + (align - 1) if align else high
    step = F.greatest(end - start + 1, F.lit(1)) if most is None else F.lit(most).cast(LONG)
    keep = [c for c in ranges.columns if c not in ("from_block", "to_block")]
    some = ranges.where("from_block <= to_block").select(*keep, end.cast(LONG).alias("_end"), step.cast(LONG).alias("_step"), F.posexplode(F.sequence(start.cast(LONG), end.cast(LONG), step.cast(LONG))).alias("chunk_index", "from_block"))
    return some.select(*keep, F.col("chunk_index").cast(LONG).alias("chunk_index"), "from_block", F.least(F.col("from_block") + F.col("_step") - 1, F.col("_end")).alias("to_block"))


def merge(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overlapping and adjacent ranges as one: islands under a running maximum, for each value of ``by``."""
    by = by or []
    # Without keys the islands of one relation need one order; ranges are control data, a few rows a bin.
    order = Window.partitionBy(*by).orderBy("from_block", "to_block")
    reach = F.max("to_block").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.select(*by, "from_block", "to_block", F.when(F.col("from_block") <= reach + 1, 0).otherwise(1).alias("_new"))
    return marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_island").agg(F.min("from_block").alias("from_block"), F.max("to_block").alias("to_block")).drop("_island")


def halve(ranges: DataFrame) -> DataFrame:
    """Both halves of each range of two or more blocks; of an odd size the second is larger. Single blocks give nothing."""
    low, high = F.col("from_block"), F.col("to_block")
    middle = low + F.expr("(to_block - from_block + 1) div 2") - 1
    keep = [c for c in ranges.columns if c not in ("from_block", "to_block")]
    parts = F.array(F.struct(low.alias("from_block"), middle.alias("to_block")), F.struct((middle + 1).alias("from_block"), high.alias("to_block")))
    return ranges.where("from_block < to_block").select(*keep, F.posexplode(parts).alias("half", "_r")).select(*keep, F.col("half").cast(LONG).alias("half"), "_r.from_block", "_r.to_block")


def _descent(block: Column, low: int, high: int) -> Column:
    """All ranges that halving [low, high] puts ``block`` in, from the whole to the single block: array<struct<from_block, to_block, depth>>."""
    node = lambda a, b, d: F.struct(a.cast(LONG).alias("from_block"), b.cast(LONG).alias("to_block"), d.cast(LONG).alias("depth"))
    root = F.array(node(F.lit(low), F.lit(high), F.lit(0)))

    def step(path: Column, _: Column) -> Column:
        at = F.element_at(path, -1)
        size = at["to_block"] - at["from_block"] + 1
        middle = at["from_block"] + (size - F.pmod(size, F.lit(2))) / 2 - 1
        left = node(at["from_block"], middle, at["depth"] + 1)
        right = node(middle + 1, at["to_block"], at["depth"] + 1)
        return F.when(size < 2, path).otherwise(F.concat(path, F.array(F.when(block <= middle, left).otherwise(right))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((high - low).bit_length() + 1)), root, step)


def bisect(counts: DataFrame, low: int, high: int, cap: int) -> DataFrame:
    """[low, high] halved until each range holds at most ``cap`` rows or is one block: from_block, to_block, depth, n_rows, accepted.

    ``counts`` has block_number and n. A source that refuses wide answers need not be asked: every block is
    added to all ranges that halving would put it in (log2 of the range, reduced before the shuffle), and a
    range is split if it is too wide. A single block over the cap can't be split: it comes back with accepted = false.
    """
    node = ["from_block", "to_block", "depth"]
    inside = counts.where(F.col("block_number").between(low, high))
    sums = inside.select(F.explode(_descent(F.col("block_number"), low, high)).alias("r"), "n").groupBy(*[F.col(f"r.{c}").alias(c) for c in node]).agg(F.sum("n").alias("n_rows"))
    root = counts.sparkSession.createDataFrame([(low, high, 0)], "from_block long, to_block long, depth long")
    wide = sums.where((F.col("n_rows") > cap) & (F.col("from_block") < F.col("to_block")))
    parts = halve(wide.select("from_block", "to_block", (F.col("depth") + 1).alias("depth"))).select(*node)
    sized = root.unionByName(parts).join(sums, node, "left").fillna(0, ["n_rows"])
    leaves = sized.where((F.col("n_rows") <= cap) | (F.col("from_block") == F.col("to_block")))
    return leaves.withColumn("accepted", F.col("n_rows") <= cap)


def boundary(probes: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """The first block in [low, high] with code for each key, null if there is none at ``high``.

    For a monotone predicate the binary search is an aggregate: a block that has code once has it from then
    on, so the first row with code is the answer and the upper bound's state follows from the rows before it.
    """
    inside = F.col("has_code") & F.col("block_number").between(low, high)
    return probes.groupBy(key).agg(F.min(F.when(inside, F.col("block_number"))).alias("_first"), F.max_by("has_code", F.when(F.col("block_number") <= high, F.col("block_number"))).alias("_at_high"))\
        .select(key, F.when(F.col("_at_high"), F.col("_first")).alias("deploy_block"))


def boundary_search(probes: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """What a binary search for the first block with code in [low, high] finds for each key, whether or not code stays once it is there; null if there is none at ``high``."""
    log = probes.where(F.col("block_number") <= high).select(key, "block_number", "has_code")
    return replay(log, key, ["block_number"], lambda: Boundary("block_number", "has_code", low, high), "deploy_block long")
