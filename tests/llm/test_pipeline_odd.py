"""The pipeline's stages over tables with nulls, empties, repeats, clashing columns, and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

CLEAN = "The river rises in the hills above the town and for most of the year it is low enough to be crossed on foot near the old mill."
LEAK = "one two three four five six seven eight nine ten eleven twelve"


def tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def texts():
    w = CLEAN.split()
    return [(i, " ".join(w[i % 9 :] + w[: i % 9]) + f" It was day number {i} of the year, and {w[i % 20]} was the word of the day.", "en") for i in range(40)]


def test_odd_rows(spark, tmp_path):
    rows = texts() + [(None, CLEAN, "en"), (None, CLEAN, "en"), (7, texts()[7][1], "en"), (50, None, "en"), (51, "", "en"), (None, None, None), (52, CLEAN + " " + LEAK, None), (53, CLEAN, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = {"node": 1, "sha": "s", "maybe": True, "score": 0.5, "perplexity": 1, "row": "r", "doc": 3, "term": "t", "token_ids": "x", "Decoded": "y", "a.b": 2, "text_hash": 5}
    for name, value in clash.items():
        df = df.withColumn(name, F.lit(value))
    df = df.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    path = tables(spark, tmp_path, df)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    kept = docs.collect()
    assert not any(r.text in (None, "") or LEAK in r.text for r in kept)
    assert sum(r.text == CLEAN for r in kept) == 1 and sum(r.doc_id == 7 for r in kept) == 1
    last = P.STAGES[-1][1](spark, docs, path)
    assert last.columns == [*docs.columns, "_token_ids", "_decoded"]
    assert [r["_decoded"] for r in last.collect()] == [r.text for r in kept]


@pytest.mark.parametrize("stage", [name for name, _ in P.STAGES])
def test_no_rows(spark, tmp_path, stage):
    path = tables(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert dict(P.STAGES)[stage](spark, spark.read.parquet(f"{path}/documents.parquet"), path).count() == 0


def test_one_very_long_text(spark, tmp_path):
    long = " ".join(f"{w} {i}" for i in range(20_000) for w in CLEAN.split()[:5])
    path = tables(spark, tmp_path, spark.createDataFrame([*texts(), (60, long, "xx"), (61, long + " end", "xx")], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.decoded == r.text for r in P.run(spark, path).collect()}
    assert got[60] and 61 not in got and all(got.values())
