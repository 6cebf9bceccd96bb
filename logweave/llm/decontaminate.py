"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

Terms are pairs of adjacent words: their lists stay short where single words would have very long ones.
The index stores a posting (term, document, position) for every occurrence of a test term in the
training texts, beside the documents' own order, so building it needs no shuffle of texts. Queries work
on postings alone:

1. the frequency of each test term is counted from its postings;
2. each window of a test item is led by its rarest term; windows with an absent term end here;
3. the leading terms' lists, with the offset in the item subtracted, give candidate alignments
   (item, document, shift);
4. every candidate is intersected with the lists of all the item's terms on the same shift; unbroken
   runs as long as a window are exact phrase matches.

The proximity query takes an item's two rarest terms and accepts a shift that differs by a few words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import NULL_ID, ascii_lower, bounded, fresh, table, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SLOP = 5
KEY = ["doc", "text_hash"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def _pairs(col: str) -> Column:
    """Adjacent words; the last word has a null partner, which joins with nothing."""
    return F.posexplode(F.arrays_zip(F.col(col).alias("w1"), F.slice(col, 2, F.greatest(F.size(col), F.lit(1))).alias("w2")))


class PositionalIndex:
    """The test items, their terms, and the postings of these terms in ``docs``."""

    def __init__(self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW):
        if window < 2:
            raise ValueError("a window has at least two words")
        self.window = window
        # Equal texts of several items are one query.
        texts = items.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
        self.items = written(texts.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("item", F.monotonically_increasing_id()), "index-items")
        pairs = self.items.select("item", F.size("words").alias("n"), _pairs("words")).select("item", "n", F.col("pos").alias("j"), "col.w1", "col.w2").where("w2 IS NOT NULL")
        terms = written(pairs.select("w1", "w2").distinct().withColumn("term", F.monotonically_increasing_id()), "index-terms")
        self.item_terms = written(pairs.join(terms, ["w1", "w2"]).select("item", "n", "j", "term"), "index-item-terms")
        source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("words"))
        found = source.select(*KEY, _pairs("words")).select(*KEY, "pos", "col.w1", "col.w2")
        terms = bounded(terms, F.octet_length("w1") + F.octet_length("w2"))
        self.postings = written(found.join(terms, ["w1", "w2"]).select("term", *KEY, "pos"), "index-postings")
        self.frequency = written(self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("freq")), "index-frequency")
        single = self.items.where(F.size("words") == 1).select("item", F.col("words")[0].alias("word"))
        self.single = None
        if single.head(1):  # items of one word have no pair: their list is that of the word
            at = source.select(*KEY, F.posexplode("words").alias("pos", "word"))
            self.single = at.join(bounded(single, F.octet_length("word")), "word").select(*KEY, "item", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
        self.item_terms = self.item_terms.join(self.frequency, "term", "left").fillna(0, ["freq"])
        self.item_terms = bounded(written(self.item_terms, "index-item-terms"), F.lit(40))

    def phrases(self) -> DataFrame:
        """doc, text_hash, item, start, end (exclusive): maximal runs of words that exact windows cover."""
        ahead = Window.partitionBy("item").orderBy("j").rowsBetween(0, self.window - 2)
        led = self.item_terms.withColumn("lead", F.min(F.struct("freq", "j", "term")).over(ahead))
        led = led.where((F.col("j") <= F.greatest(F.col("n") - self.window, F.lit(0))) & (F.col("lead.freq") > 0))
        leads = led.select("item", F.col("lead.j").alias("j"), F.col("lead.term").alias("term")).distinct()
        leads = bounded(written(leads, "index-leads"), F.lit(24))
        shifts = self.postings.join(leads, "term").select(*KEY, "item", (F.col("pos") - F.col("j")).alias("shift")).distinct()
        wanted = shifts.join(self.item_terms, "item").select(*KEY, "item", "n", "shift", "j", "term", (F.col("shift") + F.col("j")).alias("pos"))
        # Rows alike in id and text have the same postings: each place counts once.
        met = wanted.join(self.postings, ["term", *KEY, "pos"]).select(*KEY, "item", "n", "shift", "j").distinct()
        line = Window.partitionBy(*KEY, "item", "shift").orderBy("j")
        runs = met.withColumn("run", F.col("j") - F.row_number().over(line)).groupBy(*KEY, "item", "shift", "n", "run").agg(F.min("j").alias("a"), F.max("j").alias("b"))
        runs = runs.where(F.col("b") - F.col("a") + 2 >= F.least(F.col("n"), F.lit(self.window)))
        out = runs.select(*KEY, "item", (F.col("shift") + F.col("a")).alias("start"), (F.col("shift") + F.col("b") + 2).alias("end"))
        return out if self.single is None else out.unionByName(self.single)

    def near(self, slop: int = SLOP) -> DataFrame:
        """doc, text_hash, item: documents that hold an item's two rarest occurring terms at their distance in the item, give or take ``slop`` words."""
        by = Window.partitionBy("item").orderBy("freq", "j")
        two = self.item_terms.where("freq > 0").withColumn("r", F.row_number().over(by)).where("r <= 2")
        two = written(two.select("item", "term", "j", "r"), "index-rarest")
        at = self.postings.join(bounded(two, F.lit(24)), "term").select(*KEY, "item", "r", (F.col("pos") - F.col("j")).alias("shift"))
        # A grid over shifts: places within slop of each other are in the same cell or in neighbours.
        cell = F.floor(F.col("shift") / (slop + 1))
        first = at.where("r = 1").select(*KEY, "item", F.col("shift").alias("s1"), cell.alias("cell")).distinct()
        second = at.where("r = 2").select(*KEY, "item", F.col("shift").alias("s2"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
        return first.join(second, [*KEY, "item", "cell"]).where(F.abs(F.col("s1") - F.col("s2")) <= slop).select(*KEY, "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_near counts items that a proximity match finds. Null texts have no words. Rows with the same id and
    text get the same values; rows with a null id are judged by their text. Items without words match
    nothing; an item with a null id marks words but is not listed. Empty tables give an empty result or
    rows without hits. Other columns are ignored.
    """
    index = PositionalIndex(docs, items, id_col, text_col, window=window)
    found = written(index.phrases(), "phrases")
    before = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select(*KEY, "start", "end").distinct().withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = spans.groupBy(*KEY).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "covered"))).cast("long").alias("n_hit"))
    names = index.items.select("item", F.explode("item_ids").alias("item_id"))
    listed = found.select(*KEY, "item").distinct().join(names, "item").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    near = index.near(slop).join(names, "item").groupBy(*KEY).agg(F.countDistinct("item_id").alias("n_near"))
    marks = written(hits.join(listed, KEY, "full").join(near, KEY, "full"), "marks")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    base = base.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    zero = F.lit(0).cast("long")
    return base.join(marks, KEY, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.size("ids").cast("long"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; all columns stay. Rows alike in id and text share their fate."""
    index = PositionalIndex(docs, items, id_col, text_col, window=window)
    bad = written(index.phrases().select(*KEY).distinct(), "contaminated")
    doc, text_hash = fresh(docs, "doc", "text_hash")
    keyed = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(text_hash, F.xxhash64(text_col))
    bad = bounded(bad.withColumnsRenamed({"doc": doc, "text_hash": text_hash}), F.lit(16))
    return keyed.join(bad, [doc, text_hash], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda s: array_to_string(w[s:s + least(10, len(w)) - 1], ' '))) AS k FROM i WHERE len(w) > 0
), dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda s: array_to_string(w[s:s + n - 1], ' '))) AS k
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n
), m AS (
  SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS j FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id
), who AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
), dp AS (
  SELECT doc_id, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda s: w[s] || ' ' || w[s + 1])) AS pair FROM d WHERE len(w) > 1
), ip AS (
  SELECT item_id, unnest(range(1, len(w))) AS j, unnest(list_transform(range(1, len(w)), lambda s: w[s] || ' ' || w[s + 1])) AS pair FROM i WHERE len(w) > 1
), f AS (
  SELECT pair, count(*) AS c FROM dp WHERE pair IN (SELECT pair FROM ip) GROUP BY pair
), two AS (
  SELECT item_id, j, pair, row_number() OVER (PARTITION BY item_id ORDER BY c, j) AS r FROM ip JOIN f USING (pair) QUALIFY r <= 2
), near AS (
  SELECT a.doc_id, count(DISTINCT t.item_id) AS n_near
  FROM two t JOIN two u ON t.item_id = u.item_id AND t.r = 1 AND u.r = 2 JOIN dp a ON a.pair = t.pair JOIN dp b ON b.pair = u.pair AND a.doc_id = b.doc_id
  WHERE abs((a.pos - t.j) - (b.pos - u.j)) <= 5 GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN who ON d.doc_id = who.doc_id LEFT JOIN near ON d.doc_id = near.doc_id
"""
