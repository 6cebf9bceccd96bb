"""Each stage of the pipeline on its own input, against brute force."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from logweave.llm.token_counts import tokenizer_path


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean texts, junk, exact and near copies, and passages of a benchmark."""
    rng = random.Random(21)
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(stems) for _ in range(n)) + "."
    docs = [(text(rng.randint(80, 160)), "clean") for _ in range(120)]
    docs += [("".join(rng.choice("#$%&*XQZ19@") for _ in range(400)), "junk") for _ in range(8)]
    docs += [(docs[i][0].replace(" ", "\n", 3), "exact") for i in range(10)]
    for i in range(10, 20):
        w = docs[i][0].split()
        w[len(w) // 2] = "edited"
        docs.append((" ".join(w), "near"))
    items = [text(30) for _ in range(5)]
    docs += [(text(60) + " " + " ".join(items[k % 5].split()[5:18]) + " " + text(40), "leak") for k in range(6)]
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", kind, len(t)) for i, (t, kind) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(120, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert [n for n, _ in P.STAGES] == ["quality", "exact", "near", "benchmark", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds = ["junk", "exact", "near", "leak"]
    for (_, stage), gone in zip(P.STAGES, kinds):
        before, after = docs.collect(), stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        rows = after.collect()
        assert sorted(rows) == sorted(r for r in before if r.source != gone)
        docs = spark.createDataFrame(rows, docs.schema)
    last = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect())
    for r in last:
        assert list(r.token_ids) == library.encode(r.text, add_special_tokens=False).ids and r.decoded == r.text


def test_run(spark, sf_dir):
    got = P.run(spark, sf_dir)
    assert {r.source for r in got.collect()} == {"clean"} and got.count() == 120
