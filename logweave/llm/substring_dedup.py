"""Substring deduplication by relative Lempel-Ziv parsing against an index of reference blocks with their places.

The reference of a document is the text of all documents with smaller ids. Its blocks are all runs of
``window`` words, found by content-defined anchors: of the grams of ``GRAM`` words inside a window, the
one with the least hash is its anchor, so equal windows have equal anchors wherever they stand.
Consecutive windows with one anchor occurrence form a stretch, hashed as a whole.

1. Every document is scanned once; each distinct (anchor, stretch) of it is one index row, a few per
   cent of its words. The index keeps the first document of each and its place there.
2. A stretch that a smaller document has as well is a match as it stands.
3. Where an anchor has several different stretches, its first document of each sends the hashes of the
   single windows, and the index keeps the first document and place of each window.
4. Every document with matches is parsed from left to right into factors (start, end, source document,
   place in the source): a factor begins at a window that the reference has and grows, word by word,
   while the next window stands at the next place of the same source. What lies between is literal.

So each factor is a substring of one earlier document. It is at least a window long. Where the first
document of the next window is another one, the next factor begins there and overlaps the last by a window
less one word: windows across a boundary belong to one of both, and none is lost. Words in factors are
removed. Hashes of windows are compared together with the hash of their anchor, 128 bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import BROADCAST_BYTES, give_back, table, written

WINDOW, GRAM = 50, 8
#: Odd multiplier of the rolling hashes, and the two of the bit mixer.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
KNOWN_WORDS = 400_000
#: Rows of at most so many values go into one Arrow batch.
BATCH_VALUES = 1 << 18


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space; bytes.split() takes nothing else for white space."""
    return (text or "").encode().split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            self[word] = h
        return h


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """The polynomial hash of every run of ``length`` words, by doubling."""
    power, have, out, done = BASE, h, None, 0
    k = 1
    while True:
        if length & k:
            if out is None:
                out, done = have, k
            else:  # the runs of ``done`` words, then k more
                n = len(h) - done - k + 1
                out = out[:n] * power + have[done : done + n]
                done += k
        if 2 * k > length:
            return out
        have = have[: len(h) - 2 * k + 1] * power + have[k : len(h) - k + 1]
        power = power * power
        k *= 2


def least_positions(v: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` values the position of its least one, the leftmost on ties."""
    at, k = np.arange(len(v)), 1
    while 2 * k <= span:
        left, right = at[: len(v) - 2 * k + 1], at[k : len(v) - k + 1]
        at = np.where(v[right] < v[left], right, left)
        k *= 2
    n = len(v) - span + 1
    left, right = at[:n], at[span - k : span - k + n]
    return np.where(v[right] < v[left], right, left)


class Parse:
    """The windows of one document: their hashes, anchors and stretches."""

    def __init__(self, words: list[bytes], hashes: WordHashes, window: int):
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        self.window = window
        gram = min(GRAM, window)
        with np.errstate(over="ignore"):
            grams = mix(run_hashes(h, gram))
            self.windows = mix(run_hashes(h, window))
            anchor_at = least_positions(grams, window - gram + 1)
            self.first = np.flatnonzero(np.r_[True, anchor_at[1:] != anchor_at[:-1]])
            self.last = np.r_[self.first[1:], len(anchor_at)] - 1
            self.anchors = grams[anchor_at[self.first]]
            # The first and the last window overlap or meet, so they and their distance fix all words between.
            self.stretches = mix(self.windows[self.first] * BASE + self.windows[self.last] + (self.last - self.first).astype(np.uint64) * MIX_A)

    def factors(self, stretches: Matches, blocks: Matches) -> list[tuple[int, int, int, int]]:
        """Factors (start, end, source, place in the source) against the matches of the document."""
        n = len(self.windows)
        have, source, place = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        at, hit = blocks.find(self.windows)
        have[hit], source[hit], place[hit] = True, blocks.source[at[hit]], blocks.place[at[hit]]
        at, hit = stretches.find(self.stretches)
        if hit.any():
            first, size = self.first[hit], (self.last - self.first + 1)[hit]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            w = np.repeat(first, size) + inside
            have[w], source[w], place[w] = True, np.repeat(stretches.source[at[hit]], size), np.repeat(stretches.place[at[hit]], size) + inside
        grows = have[1:] & have[:-1] & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1)
        starts, ends = np.flatnonzero(have & ~np.r_[False, grows]), np.flatnonzero(have & ~np.r_[grows, False])
        return [(int(a), int(b) + self.window, int(source[a]), int(place[a])) for a, b in zip(starts, ends, strict=True)]


class Matches:
    """Hashes that the reference has, ascending, with the source document and place of each."""

    def __init__(self, rows: list[dict] | None):
        rows = rows or []
        table_ = np.array([(r["hash"], r["source"], r["place"]) for r in rows], np.int64).reshape(-1, 3)
        hashes = table_[:, 0].copy().view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.source, self.place = hashes[order], table_[order, 1], table_[order, 2]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def _batches(rows: Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, void, two columns of hashes, places)."""
    parts, size = [], 0

    def batch():
        n = [len(r[2]) for r in parts]
        long = lambda i: pa.array(np.concatenate([r[i] for r in parts]).astype(np.uint64, copy=False).view(np.int64), pa.int64())
        keys, voids = (np.repeat(np.array([r[i] for r in parts], t), n) for i, t in ((0, np.int64), (1, bool)))
        return pa.RecordBatch.from_arrays([long(2), long(3), pa.array(keys), pa.array(voids), long(4)], names)

    for row in rows:
        parts.append(row)
        size += len(row[2])
        if size >= BATCH_VALUES:
            yield batch()
            parts, size = [], 0
    if parts:
        yield batch()


def _distinct(anchors: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row, with the first place, of each pair of hashes."""
    if len(anchors) < 2:
        return anchors, hashes, places
    order = np.lexsort((places, hashes, anchors))
    a, h = anchors[order], hashes[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (h[1:] != h[:-1])]
    return a[new], h[new], places[order][new]


def _index_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows():
            for batch in batches:
                for key, void, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if len(words := split_words(text.as_py())) >= window:
                        p = Parse(words, hashes, window)
                        yield key, void, *_distinct(p.anchors, p.stretches, p.first)

        yield from _batches(rows(), ["anchor", "stretch", "key", "void", "place"])
        give_back()

    return run


def _window_rows(window: int):
    """Of each document the windows of the stretches asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows():
            for batch in batches:
                for key, void, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    p = Parse(split_words(text.as_py()), hashes, window)
                    wanted = np.array(asked.as_py(), np.int64).view(np.uint64)
                    hit = np.flatnonzero(np.isin(p.stretches, wanted))
                    if len(hit):
                        n = p.last[hit] - p.first[hit] + 1
                        at = np.repeat(p.first[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                        yield key, void, *_distinct(np.repeat(p.anchors[hit], n), p.windows[at], at)

        yield from _batches(rows(), ["anchor", "block", "key", "void", "place"])

    return run


ROW = ["key", "void"]


def _known() -> Column:
    """A row's id. Rows without one (void) come after all others, each for itself."""
    return F.expr("CASE WHEN NOT void THEN key END")


def _fits(rows: DataFrame) -> bool:
    """Whether a broadcast may hold the keys of ``rows``."""
    return rows.count() * 64 <= BROADCAST_BYTES


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` joined with ``rows`` (one for each key); if their keys are few, no other text is shuffled."""
    if _fits(rows):
        docs = docs.join(F.broadcast(rows.select(*ROW)), ROW, "left_semi")
    return docs.join(rows, ROW)


def matches(docs: DataFrame, window: int) -> DataFrame:
    """key, void, stretches, blocks: what of each document the reference has, arrays of (hash, source, place). ``docs`` has key, void and text."""
    index = written(docs.mapInArrow(_index_rows(window), "anchor long, stretch long, key long, void boolean, place long"), "rlz-index")

    def first_of(rows: DataFrame, by: str) -> DataFrame:
        found = rows.groupBy("anchor", by).agg(F.min(_known()).alias("source"), F.min_by("place", _known()).alias("source_place"), F.max(_known()).alias("last"), F.max("void").alias("voids"))
        return found.withColumn("again", F.coalesce((F.col("source") < F.col("last")) | F.col("voids"), F.lit(False)) & F.col("source").isNotNull())

    def matched(rows: DataFrame, first: DataFrame, by: str) -> DataFrame:
        again = written(first.where("again").select("anchor", by, "source", "source_place"), "rlz-again")
        hit = rows.select("anchor", by, *ROW).join(again, ["anchor", by]).where("void OR key > source")
        return hit.select(*ROW, F.struct(F.col(by).alias("hash"), "source", F.col("source_place").alias("place")).alias("m"))

    seen = written(first_of(index, "stretch"), "rlz-seen")
    whole = matched(index, seen, "stretch")
    anchors = written(seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "rlz-anchors")
    open_ = seen.join(anchors, "anchor")
    asked = open_.where("source IS NOT NULL").select(F.col("source").alias("key"), F.lit(False).alias("void"), "stretch")
    late = index.where("void").select("anchor", "stretch", *ROW).join(open_.where("source IS NULL").select("anchor", "stretch"), ["anchor", "stretch"])
    asked = asked.unionByName(late.select(*ROW, "stretch")).groupBy(*ROW).agg(F.collect_set("stretch").alias("asked"))  # a document's own stretches
    blocks = _only(docs, written(asked, "rlz-asked")).select(*ROW, "text", "asked").mapInArrow(_window_rows(window), "anchor long, block long, key long, void boolean, place long")
    blocks = written(blocks, "rlz-blocks")
    single = matched(blocks, first_of(blocks, "block"), "block")
    none = F.lit(None).cast(single.schema["m"].dataType)
    rows = whole.select(*ROW, F.col("m").alias("stretch"), none.alias("block")).unionByName(single.select(*ROW, none.alias("stretch"), F.col("m").alias("block")))
    return rows.groupBy(*ROW).agg(F.collect_set("stretch").alias("stretches"), F.collect_set("block").alias("blocks"))


SPANS = "array<struct<start:bigint,end:bigint,source:bigint,source_start:bigint>>"


def _parsed(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            found = [batch.column(i).to_pylist() for i in range(3, batch.num_columns)] or [[None] * batch.num_rows] * 2
            for text, stretches, blocks in zip(batch.column(2), *found, strict=True):
                words, factors = split_words(text.as_py()), []
                n = len(words)
                if (stretches or blocks) and n >= window:
                    factors = Parse(words, hashes, window).factors(Matches(stretches), Matches(blocks))
                    keep = np.ones(n, bool)  # factors may overlap by less than a window: a word goes once
                    for a, b, _, _ in factors:
                        keep[a:b] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                kept = b" ".join(words)
                out[0].append(n)
                out[1].append(n - len(words))
                out[2].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
                out[3].append([dict(zip(("start", "end", "source", "source_start"), f, strict=True)) for f in factors])
            spans = [] if digest else [pa.array(out[3], pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "source", "source_start")])))]
            names = [*ROW, "n_words", "n_removed", "kept", *(["spans"] if spans else [])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), *spans], names)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (the words left, or their SHA-256 if ``digest``), and spans of removed words with their source (not with ``digest``).

    Null texts and short texts have no window and lose nothing. Rows with a null id come after all others:
    they lose what others have and nothing is lost because of them. Rows with equal ids count as one
    document: copies among them stay. Other columns are ignored; empty input gives an empty result.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    doc_id = F.col(id_col).cast("long")
    narrow = docs.select(F.coalesce(doc_id, F.xxhash64(text_col)).alias("key"), doc_id.isNull().alias("void"), F.col(text_col).alias("text"))
    found = written(matches(narrow, window), "rlz-found")
    schema = "key long, void boolean, n_words long, n_removed long, kept string" + ("" if digest else f", spans {SPANS}")
    parse = lambda rows: rows.mapInArrow(_parsed(window, digest), schema)
    if _fits(found):  # texts without matches never leave their partition
        keys = F.broadcast(found.select(*ROW))
        some = narrow.join(keys, ROW, "left_semi").join(found, ROW)
        parsed = parse(narrow.join(keys, ROW, "left_anti")).unionByName(parse(some.select(*ROW, "text", "stretches", "blocks")))
    else:
        parsed = parse(narrow.join(found, ROW, "left").select(*ROW, "text", "stretches", "blocks"))
    return parsed.select(F.when(~F.col("void"), F.col("key")).alias("doc_id"), *parsed.columns[2:])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), h AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS k FROM d WHERE len(w) >= 50
), x AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM h) WHERE first < doc_id
), r AS (
  SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM x) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, j: NOT list_contains(gone, j)), ' ') END) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
