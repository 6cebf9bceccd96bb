"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

One model a language. Training counts n-grams over all trusted texts, task by task and then sharded by
(language, n-gram); lower orders count distinct left neighbours. Discounts come from the counts of
counts of each order, as do the weights of each context.

Scoring resolves every distinct n-gram of the corpus, not every occurrence: the corpus' n-grams are
reduced in each task, then joined, sharded by n-gram, with the counts of each order from the unigrams
upwards. The resolved scores go back to the texts in a table of 12 bytes an n-gram, broadcast while it
is within ``max_score_bytes``. Beyond it only the common n-grams' scores are broadcast (those with at least
1 / COMMON of all occurrences, so COMMON of them at most) and each text's other n-grams join the sharded
scores; both ways give the same perplexities.

The trusted documents are dealt into two halves by a hash of their ids. The model is trained on all texts
of one half; the limit of each language comes from the other half's perplexities, which the model hasn't
seen: in logarithms, the median plus SPREADS robust standard deviations (of the median absolute deviation),
so that no odd trusted text sets it. A text is kept if its perplexity does not exceed its language's limit.

Symbols have 12 bits: a code point below PLAIN is one symbol, any other a lead and a trail, so that every
script keeps all its characters. n-grams of up to five symbols fit a long, so prefixes and suffixes are
shifts and masks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import bounded, fields_of, fresh, give_back, table, written

ORDER, SYMBOL_BITS = 5, 12
#: Code points that are one symbol; PAIR leads and as many trails cover all others.
PLAIN, PAIR = 1984, 1056
#: Robust standard deviations from the median to the limit, and the least factor between them (a few equal texts have no deviation).
SPREADS, SLACK = 6.0, 1.1
#: Symbols that are reduced together in a task.
CHUNK = 1 << 20
#: Most common n-grams whose scores are always broadcast, 12 bytes each.
COMMON = 1 << 16
PAD = "\n"


def symbols(text: str) -> np.ndarray:
    """The text's symbols."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    if not len(codes) or codes.max() < PLAIN:
        return codes
    codes = codes.astype(np.int64)
    wide = codes >= PLAIN
    at = np.cumsum(wide) + np.arange(len(codes))  # the place of each character's last symbol
    out = np.empty(len(codes) + int(wide.sum()), np.int64)
    lead, trail = np.divmod(codes - PLAIN, PAIR)
    out[at] = np.where(wide, PLAIN + PAIR + trail, codes)
    out[at[wide] - 1] = PLAIN + lead[wide]
    return out


def grams(text: str, order: int) -> np.ndarray:
    """The n-gram that ends at each symbol, after line ends as padding; runs of twice the length are made of two."""
    codes = symbols(text)
    have = np.empty(len(codes) + order - 1, np.int64)
    have[: order - 1], have[order - 1 :] = ord(PAD), codes
    total, out, done, k = len(have), None, 0, 1
    while True:
        if order & k:
            if out is None:
                out, done = have, k
            else:
                done += k
                n = total - done + 1
                out = (out[:n] << k * SYMBOL_BITS) | have[done - k : done - k + n]
        if 2 * k > order:
            return out
        n = total - 2 * k + 1
        have = (have[:n] << k * SYMBOL_BITS) | have[k : k + n]
        k *= 2


def _gram_counts(order: int):
    """Distinct n-grams and their counts, by language, reduced in chunks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(gram)), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "c"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text := text.as_py():
                    held.setdefault(lang, []).append(grams(text, order))
                    size += len(text)
                    if size >= CHUNK:
                        yield from flush()
                        size = 0
        yield from flush()
        give_back()

    return run


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """lang, gram, c over all rows of ``texts`` (lang, text)."""
    return texts.select("lang", "text").mapInArrow(_gram_counts(order), "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _suffix(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << n * SYMBOL_BITS) - 1))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, SYMBOL_BITS)


class KneserNey:
    """The model as tables: of each order the probability of every seen n-gram and the back-off weight of every context."""

    def __init__(self, texts: DataFrame, order: int = ORDER):
        if not 1 <= order <= 5:
            raise ValueError("orders from 1 to 5 fit a long")
        self.order = order
        counts = {order: written(gram_counts(texts, order), "kn-counts")}
        for n in range(order - 1, 0, -1):
            counts[n] = written(counts[n + 1].groupBy("lang", _suffix(F.col("gram"), n).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "kn-counts")
        # The base of the recursion: one probability for all symbols and an unseen one.
        self.base = written(counts[1].groupBy("lang").agg((F.lit(1.0) / (F.count(F.lit(1)) + 1)).alias("p0")), "kn-base")
        self.probability: dict[int, DataFrame] = {}
        self.weight: dict[int, DataFrame] = {}
        for n in range(1, order + 1):
            t = counts[n]
            of = t.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
            n1, n2, n3, n4 = (F.greatest(F.col(f"n{k}"), F.lit(0.5)) for k in (1, 2, 3, 4))
            y = n1 / (n1 + n2 * 2)
            keep = lambda d, k: F.greatest(F.lit(0.05), F.least(d, F.lit(k - 0.05)))  # noqa: E731  few counts of counts must not give a discount outside (0, k)
            of = of.select("lang", keep(1 - y * 2 * n2 / n1, 1).alias("d1"), keep(2 - y * 3 * n3 / n2, 2).alias("d2"), keep(3 - y * 4 * n4 / n3, 3).alias("d3"))
            context = t.groupBy("lang", _context(F.col("gram")).alias("context")).agg(F.sum("c").alias("total"), *[F.sum((F.col("c") == k).cast("long")).alias(f"t{k}") for k in (1, 2)], F.sum((F.col("c") > 2).cast("long")).alias("t3"))
            context = context.join(of, "lang").withColumn("gamma", (F.col("d1") * F.col("t1") + F.col("d2") * F.col("t2") + F.col("d3") * F.col("t3")) / F.col("total"))
            self.weight[n] = context = written(context.select("lang", "context", "total", "gamma", "d1", "d2", "d3"), "kn-weights")
            cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
            p = t.withColumn("context", _context(F.col("gram"))).join(context, ["lang", "context"])
            p = p.select("lang", "gram", ((F.col("c") - cut) / F.col("total")).alias("own"), "gamma")
            lower = self.base.withColumnRenamed("p0", "below") if n == 1 else self.probability[n - 1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            p = p.join(lower, "lang") if n == 1 else p.withColumn("suffix", _suffix(F.col("gram"), n - 1)).join(lower, ["lang", "suffix"])
            self.probability[n] = written(p.select("lang", "gram", (F.col("own") + F.col("gamma") * F.col("below")).alias("p")), "kn-probabilities")

    def scores(self, wanted: DataFrame) -> DataFrame:
        """lang, gram, log_p for the distinct n-grams ``wanted`` (lang, gram) in languages with a model."""
        below = None
        for n in range(1, self.order + 1):
            keys = wanted.select("lang", _suffix(F.col("gram"), n).alias("gram")).distinct() if n < self.order else wanted.select("lang", "gram")
            keys = keys.withColumn("context", _context(F.col("gram"))).join(self.probability[n], ["lang", "gram"], "left").join(self.weight[n].select("lang", "context", "gamma"), ["lang", "context"], "left")
            if n == 1:
                keys = keys.join(self.base.withColumnRenamed("p0", "below"), "lang")
            else:
                keys = keys.withColumn("suffix", _suffix(F.col("gram"), n - 1)).join(below, ["lang", "suffix"])
            s = keys.select("lang", "gram", F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("below")).alias("s"))
            below = written(s.select("lang", F.col("gram").alias("suffix"), F.col("s").alias("below")), "kn-scores")
        return below.select("lang", F.col("suffix").alias("gram"), F.log("below").alias("log_p"))


def _score_tables(scores: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """n-grams, ascending, and their scores by language. The caller bounds the rows."""
    tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    arrow = scores.select("lang", "gram", F.col("log_p").cast("float")).orderBy("lang", "gram").toArrow()
    lang, gram, log_p = arrow.column(0).to_numpy(), arrow.column(1).to_numpy(), arrow.column(2).to_numpy()
    edges = np.flatnonzero(lang[1:] != lang[:-1]) + 1 if len(lang) else np.array([], int)
    for a, b in zip(np.r_[0, edges].astype(int), np.r_[edges, len(lang)].astype(int), strict=True):
        if b > a:
            tables[str(lang[a])] = (gram[a:b].copy(), log_p[a:b].copy())
    return tables


def _by_table(scores: DataFrame, order: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds score (n, total of log_p) to frames with lang and text, from a broadcast table."""
    sent = scores.sparkSession.sparkContext.broadcast(_score_tables(scores))

    @F.pandas_udf("struct<n long, total double>")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tables = sent.value
        for langs, texts in pairs:
            n, total = [], []
            for lang, text in zip(langs, texts, strict=True):
                t = tables.get(lang)
                gram = np.sort(grams(text, order)) if t is not None and text else None  # sorted ones are found faster
                n.append(0 if gram is None else len(gram))
                total.append(0.0 if gram is None else float(t[1][np.searchsorted(t[0], gram)].sum(dtype=np.float64)))
            yield pd.DataFrame({"n": n, "total": total})
        give_back()

    return lambda frame: frame.withColumn("score", score("lang", "text"))


def _by_join(scores: DataFrame, order: int) -> Callable[[DataFrame], DataFrame]:
    """As _by_table(), but only common n-grams' scores are broadcast: a text's other n-grams join the sharded scores.

    ``scores`` has c, the occurrences of each n-gram.
    """
    every = scores.agg(F.sum("c")).first()[0] or 0
    often = scores.where(F.col("c") * COMMON >= every)  # COMMON rows at most
    sent = scores.sparkSession.sparkContext.broadcast(_score_tables(often))
    rest = scores.where(F.col("c") * COMMON < every).select("lang", "gram", F.col("log_p").cast("float").alias("log_p"))

    @F.pandas_udf("struct<n long, total double, rest array<struct<gram long, n long>>>")
    def split(langs: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for lang, text in zip(langs, texts, strict=True):
            gram, n = np.unique(grams(text, order), return_counts=True) if text else (np.array([], np.int64), np.array([], np.int64))
            have, log_p = sent.value.get(lang, (np.array([], np.int64), np.array([], np.float32)))
            at = np.minimum(np.searchsorted(have, gram), max(0, len(have) - 1))
            known = have[at] == gram if len(have) else np.zeros(len(gram), bool)
            total = float((log_p[at[known]].astype(np.float64) * n[known]).sum()) if known.any() else 0.0
            out.append((int(n[known].sum()), total, [{"gram": int(g), "n": int(k)} for g, k in zip(gram[~known], n[~known], strict=True)]))
        return pd.DataFrame(out, columns=["n", "total", "rest"])

    def add(frame: DataFrame) -> DataFrame:
        # Row numbers are written before they are used twice: a task that runs again can't deal them anew.
        keyed = written(frame.withColumn("row_no", F.monotonically_increasing_id()), "kn-rows")
        parts = written(keyed.select("row_no", "lang", split("lang", "text").alias("s")), "kn-parts")
        each = parts.select("row_no", "lang", F.explode("s.rest").alias("g")).select("row_no", "lang", "g.gram", "g.n")
        sums = each.join(rest, ["lang", "gram"]).groupBy("row_no").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("log_p").cast("double")).alias("total"))
        sums = parts.select("row_no", F.col("s.n").alias("n"), F.col("s.total").alias("total")).unionByName(sums).groupBy("row_no").agg(F.struct(F.sum("n").alias("n"), F.sum("total").alias("total")).alias("score"))
        return keyed.join(sums, "row_no", "left").drop("row_no")

    return add


def perplexities(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, spreads: float = SPREADS, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_score_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with perplexity, threshold and accepted as the last three columns, under names that ``docs`` doesn't have (underscores go before them).

    ``trusted_ids`` has one column of ids. A null language is one language of its own. Texts that are null
    or empty have no perplexity and are not accepted. Texts of a language without trusted text have no
    threshold and are accepted. Rows and columns of ``docs`` stay as they are, repeated rows too.
    """
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.col(text_col)
    ids = written(trusted_ids.toDF("trusted_id").where("trusted_id IS NOT NULL").distinct(), "kn-trusted")
    half = F.pmod(F.xxhash64("trusted_id"), F.lit(2))
    train, held = (bounded(ids.where(half == i), F.lit(8)) for i in (0, 1))
    narrow = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), text.alias("text"))
    model = KneserNey(narrow.join(train, narrow.id == train.trusted_id, "left_semi"), order)
    wanted = written(gram_counts(narrow, order), "kn-wanted")
    scores = model.scores(wanted.select("lang", "gram"))
    p_col, t_col, a_col = fresh(docs, "perplexity", "threshold", "accepted")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), lang.alias("lang"), text.alias("text"))
    if scores.count() * 12 <= max_score_bytes:
        add_score = _by_table(scores, order)
    else:
        add_score = _by_join(written(scores.join(wanted, ["lang", "gram"]), "kn-counted-scores"), order)
    perplexity = F.when(F.col("score.n") > 0, F.exp(-F.col("score.total") / F.col("score.n")))
    # The filter comes after the scores are written: before, it would have them computed twice.
    unseen = written(add_score(narrow.join(held, narrow.id == held.trusted_id, "left_semi")).select("lang", F.log(perplexity).alias("log_p")), "kn-held")
    unseen = unseen.where("log_p IS NOT NULL")
    middle = unseen.groupBy("lang").agg(F.percentile_approx("log_p", 0.5, 20_000).alias("middle"))
    apart = unseen.join(middle, "lang").groupBy("lang", "middle").agg((F.percentile_approx(F.abs(F.col("log_p") - F.col("middle")), 0.5, 20_000) * 1.4826).alias("spread"))
    limits = apart.select("lang", F.exp(F.col("middle") + F.greatest(F.col("spread") * spreads, F.lit(log(slack)))).alias("limit"))
    limits = bounded(written(limits, "kn-limits"), F.octet_length("lang"))
    out = add_score(whole).join(limits.withColumnRenamed("lang", "limit_lang"), F.col("lang") == F.col("limit_lang"), "left")
    out = out.select("row", perplexity.alias("p"), F.col("limit"), F.col("text"))
    accepted = F.coalesce(F.octet_length("text") > 0, F.lit(False)) & F.coalesce(F.col("p") <= F.col("limit"), F.lit(True))
    return out.select(*fields_of("row", docs.columns), F.col("p").alias(p_col), F.col("limit").alias(t_col), accepted.alias(a_col))


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def drop_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay.

    Rows with null or empty texts go; rows of a language without trusted text stay. Repeated rows share their
    fate; null ids are never trusted. Empty tables give empty results.
    """
    scored = perplexities(docs, trusted(labels), **options)
    return scored.where(F.col(f"`{scored.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexities(docs, trusted(table(spark, sf_dir, "labels"))).select("doc_id", "lang", "perplexity", "threshold", F.col("accepted").alias("kept"))
