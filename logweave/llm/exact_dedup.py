"""Exact deduplication in two passes of a Bloom filter.

Pass one hashes every normalised text and sets filter bits; each position remembers whether one row or
at least two rows hit it. Pass two asks the filter: a row whose positions all had two or more hits is
*possibly* repeated. Only those rows are shuffled and grouped by their SHA-256; the rest never leave
their partition. The filter has no false negatives, so no copy is missed; a false positive costs one
small shuffled row and ends up in a group of one.

A filter holds 16 bits a row and at most ``max_bits`` (2**30 bits, 128 MB), which bounds what is sent to
the executors at a time. More rows than that are dealt by their hash to several filters, made and asked one
after the other, so that every filter is as sparse at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import SPACE_CLASS, fields_of, fresh, row_hash, table, written

#: Filter positions in one row of the merge step.
SEGMENT_BITS = 1 << 18
PROBES = 2
#: Rows that a task reduces together.
HELD = 1 << 20


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES filter positions for each 64-bit hash, as one row of positions for each probe."""
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(bits) for i in range(PROBES)])


def _partial_filter(bits: int):
    """Of each task: positions hit once and positions hit more often, by segment, reduced in chunks of HELD rows."""

    def reduced(hashes: np.ndarray) -> pa.RecordBatch:
        # A row counts once at a position, even if two of its probes meet there.
        probes = np.sort(_positions(hashes, bits), axis=0)
        keep = np.ones(probes.shape, bool)
        keep[1:] = probes[1:] != probes[:-1]
        at, n = np.unique(probes[keep], return_counts=True)
        segment = at // np.uint64(SEGMENT_BITS)
        cuts = np.flatnonzero(np.diff(segment)) + 1
        offset = (at % np.uint64(SEGMENT_BITS)).astype("<u4")
        ids, ones, twos = [], [], []
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            ids.append(int(segment[a]))
            ones.append(offset[a:b].tobytes())
            twos.append(offset[a:b][n[a:b] > 1].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["segment", "ones", "twos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(hashes := batch.column(0).to_numpy(zero_copy_only=False)):
                held.append(hashes)
                size += len(hashes)
                if size >= HELD:
                    yield reduced(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield reduced(np.concatenate(held))

    return run


def _merge_segment(group: pd.DataFrame) -> pd.DataFrame:
    """A bitmap of the positions that two or more rows hit. The group holds 4 bytes for each hit of SEGMENT_BITS positions."""
    seen, often = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for ones, twos in zip(group.ones, group.twos, strict=True):
        at = np.frombuffer(ones, "<u4")
        often[at[seen[at]]] = True
        seen[at] = True
        often[np.frombuffer(twos, "<u4")] = True
    return pd.DataFrame({"segment": [group.segment.iloc[0]], "bitmap": [np.packbits(often, bitorder="little").tobytes()]})


def filter_bits(rows: int, max_bits: int) -> int:
    return max(SEGMENT_BITS, min(max_bits, 1 << max(0, 16 * rows - 1).bit_length()))


def repeated_filter(hashes: DataFrame, rows: int, max_bits: int = 1 << 30):
    """A function of a 64-bit hash column: true where the hash may occur more than once in ``hashes``."""
    spark, bits = hashes.sparkSession, filter_bits(rows, max_bits)
    parts = hashes.mapInArrow(_partial_filter(bits), "segment long, ones binary, twos binary")
    merged = parts.groupBy("segment").applyInPandas(_merge_segment, "segment long, bitmap binary")
    words = np.zeros(bits // 8, np.uint8)  # max_bits / 8 bytes at most, whatever the input
    for row in merged.toLocalIterator():
        words[row.segment * SEGMENT_BITS // 8 : (row.segment + 1) * SEGMENT_BITS // 8] = np.frombuffer(row.bitmap, np.uint8)
    sent = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def maybe_repeated(h: pd.Series) -> pd.Series:
        at = _positions(h.to_numpy(), bits)
        hit = (sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=0))

    return maybe_repeated


def possibly_repeated(hashes: DataFrame, max_bits: int) -> DataFrame:
    """``hashes`` (a written table with h, a 64-bit hash) with maybe: whether h may occur more than once."""
    rows = hashes.count()
    filters = max(1, -(-16 * rows // max_bits))
    out = None
    for i in range(filters):  # one a 67 million rows
        part = hashes if filters == 1 else hashes.where(F.pmod(F.shiftrightunsigned("h", 40), F.lit(filters)) == i)
        maybe = repeated_filter(part.select("h"), -(-rows // filters), max_bits)
        part = part.withColumn("maybe", maybe("h"))
        if filters > 1:
            part = written(part, "exact-asked")
        out = part if out is None else out.unionByName(part)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 30) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Nulls: a null text counts as empty; a null id sorts after all others (keep_id is null only in a group without ids).
    Repeated rows (same id, same text): one of them is kept. Empty input: empty result. Other columns are ignored.
    """
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))
    hashed = written(hashed.withColumn("h", F.xxhash64("sha")), "exact-hashes")
    tested = written(possibly_repeated(hashed, max_bits).drop("h"), "exact-tested")
    single = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    # Rows alike in id and text collapse to a count, so a group of copies travels as one row for each id.
    rows = tested.where("maybe").groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = written(tested.where("maybe").groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id")), "exact-groups")
    # Both sides are exchanged for this join alone: adaptive execution splits the partition of a hot group.
    joined = written(rows, "exact-rows").join(groups, "sha")
    # A row stands n times in the result; the first of the smallest id stays.
    many = joined.select("doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"), "sha")
    many = many.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "sha")
    return single.unionByName(many).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 30) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the smallest id; all columns stay.

    A null text counts as empty; null ids sort last. Of several rows with the smallest id, that with the least
    hash of all its columns stays, so the result doesn't depend on the order of rows. Empty input: empty result.
    Rows that the filter clears pass straight through; the others are reduced before they are shuffled.
    """
    sha, h, maybe_col, row, asked = fresh(docs, "sha", "h", "maybe", "row", "asked")
    plain = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumn(sha, F.unhex(F.sha2(normalised(F.col(text_col)), 256))).withColumn(h, F.xxhash64(sha))
    hashes = written(hashed.select(F.col(h).alias("h")), "exact-hashes")
    if hashes.count() * 16 <= max_bits:
        tested = hashed.withColumn(maybe_col, repeated_filter(hashes, hashes.count(), max_bits)(F.col(h)))
    else:  # the filters' answers, of which only possible repeats are kept, join the rows
        repeats = written(possibly_repeated(hashes, max_bits).where("maybe").select("h").distinct(), "exact-repeats")
        tested = hashed.join(repeats.select(F.col("h").alias(h), F.lit(True).alias(asked)), h, "left").withColumn(maybe_col, F.coalesce(asked, F.lit(False)))
    single = tested.where(~F.col(maybe_col)).select(*plain)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), row_hash(docs))
    first = tested.where(maybe_col).groupBy(sha).agg(F.min_by(F.struct(*plain), order).alias(row)).select(*fields_of(row, docs.columns))
    return single.unionByName(first)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
