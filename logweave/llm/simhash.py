"""SimHash near-deduplication by a segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two bits. The embedding maps it to the 32 bit counts; the
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so pairs
within ``radius`` of each other lie within ``radius`` in the embedding. The range join is exact: the
segments form eight groups, a distance of at most four leaves at least four groups untouched, so both
points fall into one cell of at least one of the 70 grids that keep four groups of coordinates. Pairs of
a cell are held against the Manhattan bound first and the true Hamming distance last; each pair is
taken from the first grid in which its points meet, so it arises once.

Counts of two-bit segments are stored in unary (00, 01, 11): the Manhattan distance is then the number
of differing bits of two longs.

Cells with more than ``CELL_ROWS`` fingerprints never make pairs. Their fingerprints are linked through
midpoints instead: two fingerprints within four bits share a value within two bits of both, and all that
share one are within four bits of each other, so each is linked to the smallest. That is 2,081 rows for
each such fingerprint, whatever the cell's size, spread evenly over tasks.

Equal fingerprints are one point from the start. Links are followed to components by alternating stars.

A radius of four bits of 64 stands for nearly equal texts, and no radius of fingerprints stands for a
similarity of shingle sets of 0.8: at 64 bits such pairs lie about 10 bits apart and unlike ones from 20 on,
with deviations of 3 and 4, and there segment counts leave hardly any pair out. So texts of that similarity
are found in two rounds. In the first, fingerprints of the shingle sets are linked as above and every link is
verified by the similarity of the two sets. The second, an exact join of the sets, adds what the radius
misses: shingles have one order for all texts, those that a sample of the texts shows as common last; two
sets of that similarity share one of the first fifth of their shingles (and one more), so each of these makes
a cell. Places in the sets bound the overlap of a cell's pair; so do 256 parity bits of each set, of which two
sets differ in no more than the shingles that only one of them has. Every pair left is verified by the
similarity of the two sets. Only components are wanted, so pairs that a round before has put in one component
are not compared again: members of crowded cells are held against one of them first, in rounds, and then those
outside a cell's largest component against all others of the cell, block against block. No pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import NULL_ID, bounded, discard, fields_of, fresh, give_back, row_hash, table, written

#: The hash seed of the fingerprints, and the grid for a radius of four.
SEED, RADIUS, GROUPS = 42, 4, 8
CELL_ROWS = 64
#: Similar texts: the wanted similarity, the largest cell without rounds, the members of a block, the rounds, and the order's sample and length.
SIMILARITY, CELL_PAIRS, BLOCK, ROUNDS = 0.8, 8, 256, 1
SAMPLE_ROWS, SAMPLE_SHARE, COMMON = 50_000, 16, 1 << 19
GRIDS = list(combinations(range(GROUPS), GROUPS - RADIUS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _shingle_places(text: str | None, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words in one line, and the start and end of each shingle in it."""
    lowered = bytes(text or "", "utf-8").translate(_LOWER).split()  # bytes.split() takes ASCII white space only
    line = b" ".join(lowered)
    if len(lowered) <= shingle:
        return line, [0] * bool(lowered), [len(line)] * bool(lowered)
    size = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    end = np.cumsum(size)
    return line, (end - size)[: len(lowered) - shingle + 1].tolist(), (end[shingle - 1 :] - 1).tolist()


def fingerprint(text: str | None, shingle: int, join) -> int:
    """SimHash of the text's word shingles, as a signed integer."""
    line, starts, ends = _shingle_places(text, shingle)
    return _print_of(np.fromiter([join(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64, len(starts)))


def _print_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed integer."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of very long texts
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def shingle_set(text: str | None, shingle: int, join) -> np.ndarray:
    """Hashes of the text's distinct word shingles, ascending."""
    line, starts, ends = _shingle_places(text, shingle)
    return np.unique(np.fromiter([join(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64, len(starts)).view(np.int64))


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (null ids as the largest), text and text_hash of each row."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (null ids as the largest), text_hash and fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, xxhash.xxh64_intdigest) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["doc", "text_hash", "fp"])
        give_back()

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc long, text_hash long, fp long")


def embedding(fp: Column) -> Column:
    """The 32 bit counts of two-bit segments, in unary."""
    low, up = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))


def _cells(e: Column) -> Column:
    """The cell of each grid: its number and the four kept groups of coordinates, as one hash."""
    masks = [_signed(sum(0xFF << 8 * g for g in grid)) for grid in GRIDS]
    return F.array(*[F.xxhash64(F.lit(i), e.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])


def _first_grid(x: Column) -> Column:
    """The number of the first grid whose groups are all zero in x, the difference of two embeddings."""
    for by in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, by))
    left = F.bitwise_not(x).bitwiseAND(F.lit(0x0101010101010101))
    kept = F.lit(0).cast("long")
    for _ in range(GROUPS - RADIUS):
        lowest = left.bitwiseAND(-left)
        kept, left = kept.bitwiseOR(lowest), left.bitwiseXOR(lowest)
    return kept


def links(points: DataFrame) -> DataFrame:
    """a, b: links that give the components of all pairs of distinct fp within RADIUS bits. Pairs of small cells are all there; crowded ones by way of a smallest member."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fp = points.select("fp").distinct().repartition(parts)  # the rows are few, their 70 cells each are not
    cells = fp.withColumn("e", embedding(F.col("fp"))).select("fp", "e", F.posexplode(_cells(F.col("e"))).alias("grid", "cell"))
    sizes = written(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-cells")
    shared = written(cells.join(sizes.hint("merge"), "cell"), "simhash-shared")
    near, hot = shared.where(F.col("n") <= CELL_ROWS), shared.where(F.col("n") > CELL_ROWS).select("fp").distinct()
    bits = F.element_at(F.array(*[F.lit(_signed(sum(1 << 8 * g for g in grid))) for grid in GRIDS]), F.col("grid") + 1)
    left = near.select("cell", F.col("fp").alias("a"), F.col("e").alias("ea"), bits.alias("kept"))
    right = near.select("cell", F.col("fp").alias("b"), F.col("e").alias("eb"))
    apart = F.col("ea").bitwiseXOR(F.col("eb"))
    # The Manhattan bound and the choice of one grid are part of the join; the exact check follows.
    pairs = left.join(right, (left.cell == right.cell) & (F.col("a") < F.col("b")) & (F.bit_count(apart) <= RADIUS) & (_first_grid(apart) == F.col("kept")))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    hot = written(hot, "simhash-hot")
    if not hot.head(1):
        return pairs
    # Bits i and j flip, i < j; bit 64 is none. No flip at all stands as (64, 64).
    bit = lambda i: F.when(i < 64, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0)
    first = hot.repartition(parts, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    both = first.select("fp", "i", F.explode(F.sequence(F.least(F.col("i") + 1, F.lit(64)), F.lit(64))).alias("j"))
    mid = both.select("fp", F.col("fp").bitwiseXOR(bit(F.col("i"))).bitwiseXOR(bit(F.col("j"))).alias("mid"))
    # A window over one shuffle: a join would judge the midpoints by the size of the file that they are made from, and broadcast them.
    # No midpoint has more than 2,081 fingerprints, however large the crowd.
    stars = mid.withColumn("a", F.min("fp").over(Window.partitionBy("mid"))).where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for all nodes of ``edges`` (a, b).

    Large stars and small stars alternate until no edge changes. Each step groups with partial minima and
    joins its written result, so a node with very many neighbours is split over tasks.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if not edges.head(1):
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large-star")
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = written(edges, "large-star-links")
        least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        edges = edges.join(least, "a")
        edges = written(edges.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star-links")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state


def _common_shingles(narrow: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample of the texts, ascending, and their counts. They order the shingles and decide on no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in _pieces(batches):
            yield pa.RecordBatch.from_arrays([_lists([shingle_set(t.as_py(), shingle, xxhash.xxh64_intdigest) for t in batch.column(0)]).flatten()], ["token"])
        give_back()

    share = min(SAMPLE_SHARE, max(1, narrow.count() // SAMPLE_ROWS))
    some = narrow.where(F.pmod("text_hash", F.lit(share)) == 0).select("text")
    counts = some.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    most = counts.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    token, n = most.column(0).to_numpy(), most.column(1).to_numpy()
    order = np.argsort(token)
    return token[order], n[order].astype(np.int32)


#: Texts whose sets are held together in a worker.
TEXTS = 1000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.array([], np.int64), *arrays])))


PARITY = ["b0", "b1", "b2", "b3"]


def _parity(hashes: np.ndarray) -> np.ndarray:
    """256 bits, each whether an odd number of the hashes falls on it. Two sets differ in at most as many bits as in elements."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _prefixes(narrow: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """doc, text_hash, node (a hash of the shingle set), fp (the set's fingerprint), size of the set, its parity bits and its first shingles, of each row."""
    sent = narrow.sparkSession.sparkContext.broadcast(_common_shingles(narrow, shingle))
    num, den = similarity.as_integer_ratio()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common, count = sent.value
        for batch in _pieces(batches):
            nodes, fps, sizes, parity, first = [], [], [], [], []
            for t in batch.column(1):
                h = shingle_set(t.as_py(), shingle, xxhash.xxh64_intdigest)
                nodes.append(_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)))
                fps.append(_print_of(h.view(np.uint64)))
                sizes.append(len(h))
                parity.append(_parity(h.view(np.uint64)))
                if len(common) and len(h):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[at] == h, count[at], 0), kind="stable")]
                first.append(h[: len(h) + (-num * len(h) // den) + 1])
            bits = np.array(parity, np.int64).reshape(-1, 4)
            columns = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), *[pa.array(bits[:, i].copy()) for i in range(4)], _lists(first)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "text_hash", "node", "fp", "size", *PARITY, "prefix"])
        give_back()

    return narrow.mapInArrow(run, "doc long, text_hash long, node long, fp long, size int, b0 long, b1 long, b2 long, b3 long, prefix array<long>")


def _shingle_sets(narrow: DataFrame, shingle: int, rows: DataFrame) -> DataFrame:
    """node and its whole set, for the nodes of ``rows`` (doc, text_hash, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in _pieces(batches):
            sets = [shingle_set(t.as_py(), shingle, xxhash.xxh64_intdigest) for t in batch.column(0)]
            nodes = [_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)) for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(sets)], ["node", "shingles"])
        give_back()

    wanted = narrow.join(bounded(rows, F.lit(16)), ["doc", "text_hash"], "left_semi").select("text")
    return wanted.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: Fraction) -> DataFrame:
    """Those of the pairs of nodes (a, b, a written table) whose sets are similar."""
    if not pairs.head(1):
        return pairs.select("a", "b")
    num, den = similarity.as_integer_ratio()
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    whole = written(sets(nodes), "similar-sets")
    of = lambda side: whole.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    held = pairs.join(of("a"), "a").join(of("b"), "b").where(both * (num + den) >= (F.size("a_set") + F.size("b_set")) * num)
    held = written(held.select("a", "b"), "similar-links")
    discard(whole)
    return held


def print_links(first: DataFrame) -> DataFrame:
    """a, b: nodes (of ``first``, with node and fp) whose fingerprints are linked, by way of the smallest node of each fingerprint."""
    leads = written(first.groupBy("fp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")), "simhash-leads")
    of = lambda x: leads.select(F.col("fp").alias(x), F.col("lead").alias(f"{x}_node"))
    apart = links(leads).join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    equal = first.join(leads.where("n > 1"), "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return written(apart.unionByName(equal), "simhash-pairs")


def similar_links(points: DataFrame, given: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: Fraction) -> DataFrame:
    """a, b: links that give the components of all pairs of nodes whose sets are similar.

    ``points`` has node, size, parity bits and prefix, as of _prefixes(); ``given`` links known before; ``sets`` gives node and shingles of the nodes of a frame.
    """
    num, den = similarity.as_integer_ratio()
    # A pair's first common shingle leaves at most so many after it: the overlap of similar sets must fit in.
    fits = lambda a, b: F.expr(f"{num + den} * least({a}size - {a}pos, {b}size - {b}pos) >= {num} * ({a}size + {b}size)")

    def open_cells(cells: DataFrame, roots: DataFrame) -> DataFrame:
        """The members of cells with more than one component, with root. Cells are summed up before they are joined: a crowded one is split over tasks."""
        rooted = written(cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "similar-rooted")
        several = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
        several = written(several, "similar-several")
        out = written(rooted.join(several, "token", "left_semi"), "similar-cells")
        discard(rooted, several)
        return out

    one = points.select("node", "size", "prefix").dropDuplicates(["node"])  # equal sets have equal prefixes
    parity = points.select("node", *PARITY).dropDuplicates(["node"])
    cells = open_cells(one.select("node", "size", F.posexplode("prefix").alias("pos", "token")), components(given))
    near, held = given, None
    for i in range(ROUNDS):
        crowded = cells.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        crowded = written(crowded.where(F.col("n") > CELL_PAIRS), "similar-crowded")
        if not crowded.head(1):
            break
        # First the member with the most company: the text that the others come from. Then others, in an order of their own each time.
        rank = F.xxhash64("node", F.lit(i))
        members = cells.join(crowded, "token")
        if i == 0:
            company = written(members.groupBy("node").agg(F.sum("n").alias("company")), "similar-company")
            members, rank = members.join(company, "node"), F.struct("company", rank)
        members = written(members.withColumn("rank", rank), "similar-members")
        leads = written(members.groupBy("token").agg(F.max_by(F.struct("node", "size", "pos", "root"), "rank").alias("lead")), "similar-leads")
        stars = members.join(leads, "token").where((F.col("root") != F.col("lead.root")) & fits("", "lead."))
        stars = stars.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
        stars = written(stars if held is None else stars.join(held, ["a", "b"], "left_anti"), "similar-stars")
        discard(members, leads)
        held = stars if held is None else held.unionByName(stars)
        near = written(near.unionByName(_verified(stars, sets, similarity)), "similar-near")
        before, cells = cells, open_cells(cells.drop("root"), components(near))
        discard(before)
    # Of each cell the largest component's members meet only those outside it.
    shares = cells.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    shares = written(shares.groupBy("token").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("most")), "similar-shares")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cells = cells.join(shares, "token").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    cells = written(cells.join(parity, "node"), "similar-open")
    side = lambda x: F.struct("node", "root", "size", "pos", *PARITY).alias(x)
    apart = " + ".join(f"bit_count(x.{b} ^ y.{b})" for b in PARITY)
    near_enough = F.expr(f"{num + den} * ({apart}) <= {den - num} * (x.size + y.size)")
    left = cells.where("root <> most").select("token", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), side("x"))
    right = cells.select("token", "block", side("y"), (F.col("root") == F.col("most")).alias("inner"))
    pairs = left.join(right.hint("merge"), ["token", "block"]).where("x.root <> y.root AND (inner OR x.node < y.node)").where(fits("x.", "y.") & near_enough)
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    pairs = written(pairs if held is None else pairs.join(held, ["a", "b"], "left_anti"), "similar-pairs")
    return near.unionByName(_verified(pairs, sets, similarity))


def _resolved(docs: DataFrame, shingle: int, id_col: str, text_col: str, similarity: float | None = None) -> DataFrame:
    """doc, text_hash, root (of the component, a node) and component (its smallest doc) of each row. Nodes are fingerprints (also as fp), or hashes of shingle sets."""
    if similarity is None:
        points = fingerprints(docs, shingle, id_col, text_col)
        points = written(points.withColumn("node", F.col("fp")), "simhash-points")
        first = written(points.groupBy("node").agg(F.min("doc").alias("first"), F.first("fp").alias("fp")), "simhash-first")
        roots = components(links(first))
    else:
        narrow, wanted = _narrow(docs, id_col, text_col), Fraction(similarity).limit_denominator(1000)
        points = written(_prefixes(narrow, shingle, wanted), "similar-points")
        least = F.min(F.struct("doc", "text_hash")).alias("row")
        first = written(points.groupBy("node").agg(least, F.first("fp").alias("fp")).select("node", "fp", F.col("row.doc").alias("first"), "row.text_hash"), "similar-first")
        rows = lambda nodes: first.join(nodes, "node").select(F.col("first").alias("doc"), "text_hash")
        sets = lambda nodes: _shingle_sets(narrow, shingle, rows(nodes))
        given = _verified(print_links(first), sets, wanted)
        roots = components(similar_links(points, given, sets, wanted))
        points = points.drop("size", "prefix", "fp", *PARITY)
    rooted = first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = written(rooted, "simhash-rooted")
    smallest = written(named.groupBy("root").agg(F.min("first").alias("component")), "simhash-smallest")
    by_node = written(named.join(smallest, "root").select("node", "root", "component"), "simhash-components")
    return points.join(by_node, "node")


def near_duplicate_groups(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id (the smallest doc_id reachable over links).

    Null texts and texts without words have fingerprint zero and are linked like any other. Null ids sort
    last: component_id is null only where all ids of a component are. Repeated rows stay. Other columns are ignored.
    """
    void = F.lit(NULL_ID)
    return _resolved(docs, shingle, id_col, text_col).select(
        F.nullif("doc", void).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("component", void).alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of similar texts, that of the smallest id; all columns stay.

    Null texts and texts without words are one component; null ids sort last. Of several rows with the smallest
    id of one component, that with the least hash of all its columns stays. Empty tables give empty results.
    """
    resolved = _resolved(docs, shingle, id_col, text_col, similarity).where("doc = component")
    doc, text_hash, root, n, row = fresh(docs, "doc", "text_hash", "root", "n", "row")
    chosen = resolved.groupBy("doc", "root").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("text_hash"))
    chosen = written(chosen.select(F.col("doc").alias(doc), F.col("root").alias(root), F.col("text_hash").alias(text_hash), F.col("n").alias(n)), "simhash-kept")
    keyed = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(text_hash, F.xxhash64(text_col))
    stay = keyed.join(chosen, [doc, text_hash])
    plain = [F.col(f"`{c}`") for c in docs.columns]
    one = stay.where(F.col(n) == 1).select(*plain)
    # Ids that occur more than once: only these rows are grouped.
    several = stay.where(F.col(n) > 1).groupBy(doc, root).agg(F.min_by(F.struct(*plain), row_hash(docs)).alias(row)).select(*fields_of(row, docs.columns))
    return one.unionByName(several)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
