"""Substring, exact and near deduplication against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import exact_dedup, simhash, substring_dedup

DOC = "doc_id long, text string, sha string, row string, doc string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "s", "r", "d") for i, t in zip(ids, texts)], DOC)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- substring dedup -------------------------------------------------------------


def brute_substring(docs, window):
    docs = sorted(docs)
    first = {}
    for i, t in docs:
        w = space_words(t)
        for o in range(len(w) - window + 1):
            first.setdefault(tuple(w[o : o + window]), i)
    out = {}
    for i, t in docs:
        w = space_words(t)
        keep = [True] * len(w)
        for o in range(len(w) - window + 1):
            if first[tuple(w[o : o + window])] < i:
                keep[o : o + window] = [False] * window
        out[i] = (len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k))
    return out


def corpus(seed, window, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 30))
    passages = [[word() for _ in range(rng.choice([window - 1, window, window + 1, 2 * window + 3]))] for _ in range(6)]
    docs = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        docs.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    docs += [(n, docs[3][1]), (n + 1, docs[3][1] + " end"), (n + 2, "x " * 150), (n + 3, "x " * 70), (n + 4, " ".join("ab"))]
    return docs


@pytest.mark.parametrize("window", [50, 12, 9, 3])
def test_substring(spark, window):
    docs = corpus(window, window)
    df = frame(spark, [t for _, t in docs]).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(df, window).collect()}
    assert got == brute_substring(docs, window)


def test_substring_digest_and_spans(spark):
    docs = corpus(1, 12)
    df = frame(spark, [t for _, t in docs])
    plain = {r.doc_id: r for r in substring_dedup.substring_dedup(df, 12).collect()}
    for r in substring_dedup.substring_dedup(df, 12, digest=True).collect():
        assert r.kept == hashlib.sha256(plain[r.doc_id].kept.encode()).hexdigest()
        covered = {i for s in plain[r.doc_id].spans for i in range(s.start, s.end)}
        assert len(covered) == r.n_removed


@pytest.mark.parametrize("window", [50, 12, 3])
def test_factors_are_substrings_of_earlier_documents(spark, window):
    docs = dict(corpus(window + 5, window))
    words = {i: space_words(t) for i, t in docs.items()}
    n = 0
    for r in substring_dedup.substring_dedup(frame(spark, list(docs.values())).repartition(3), window).collect():
        for s in r.spans:
            assert s.source < r.doc_id and s.end - s.start >= window
            assert words[r.doc_id][s.start : s.end] == words[s.source][s.source_start : s.source_start + s.end - s.start]
            n += 1
    assert n > 5


def test_substring_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", -1)
    docs = corpus(4, 12)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(frame(spark, [t for _, t in docs]), 12).collect()}
    assert got == brute_substring(docs, 12)


def test_substring_rows_without_ids(spark):
    """Null ids come last, each row for itself; where windows differ within a stretch too."""
    rng = random.Random(8)
    docs = corpus(3, 12)
    void = [docs[rng.randint(0, 30)][1] + " tail " + " ".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(12)]
    got = substring_dedup.substring_dedup(frame(spark, [t for _, t in docs] + void, [i for i, _ in docs] + [None] * len(void)), 12).collect()
    first = {tuple(w[o : o + 12]) for _, t in docs for w in [space_words(t)] for o in range(len(w) - 11)}
    want = []
    for t in void:
        w = space_words(t)
        gone = {j for o in range(len(w) - 11) if tuple(w[o : o + 12]) in first for j in range(o, o + 12)}
        want.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert sorted((r.n_words, r.n_removed, r.kept) for r in got if r.doc_id is None) == sorted(want)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got if r.doc_id is not None} == brute_substring(docs, 12)


def test_substring_long_text(spark):
    text = " ".join(f"w{i % 5000}x{i // 7}" for i in range(200_000))
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame(spark, [text, text]), digest=True).collect()}
    assert got == {0: 0, 1: 200_000}


def test_substring_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = frame(spark, [None, "", long, long, long, "short"], [1, 2, None, 3, 3, 4])
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()), key=repr)
    # Rows of one id are one document; a null id comes after all.
    assert got == sorted([(1, 0, 0), (2, 0, 0), (3, 60, 0), (3, 60, 0), (4, 1, 0), (None, 60, 60)], key=repr)
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


# --- exact dedup -------------------------------------------------------------------


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def test_exact(spark):
    rng = random.Random(2)
    texts = [rng.choice(["a b", "a  b", "a\tb", "a b ", "ä b", "", None, f"u{i}", "hot " * 3, "hot " * 3]) for i in range(300)]
    rows = list(enumerate(texts))
    got = exact_dedup.exact_duplicates(frame(spark, texts).repartition(4)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_with_a_crowded_filter(spark, monkeypatch):
    """A filter far too small lets all rows through to the exact step."""
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows, most: exact_dedup.SEGMENT_BITS)
    texts = [f"t{i % 700}" for i in range(1000)]
    got = exact_dedup.exact_duplicates(frame(spark, texts)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(list(enumerate(texts)))


def test_filter_has_no_false_negatives(spark):
    rng = random.Random(1)
    once, twice = ([rng.randrange(-(2**63), 2**63) for _ in range(n)] for n in (500, 3000))
    df = spark.createDataFrame([(x,) for x in once + twice * 2], "h long").repartition(5)
    maybe = exact_dedup.repeated_filter(df, len(once) + 2 * len(twice))
    hit = {r.h for r in df.select("h", maybe("h").alias("m")).where("m").collect()}
    assert hit.issuperset(twice) and len(hit.intersection(once)) < 50


def test_exact_with_several_filters(spark):
    rng = random.Random(4)
    texts = [rng.choice(["a b", "a  b", f"u{i}", f"v{i % 40}", None]) for i in range(400)]
    got = exact_dedup.exact_duplicates(frame(spark, texts), max_bits=1600).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(list(enumerate(texts)))
    left = [sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(frame(spark, texts), max_bits=m).collect()) for m in (1600, 1 << 30)]
    assert left[0] == left[1] == sorted({r.keep_id for r in got})


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    texts, ids = ["same text of several words here"] * 6 + ["other"], [1, 1, 1, 2, None, None, 3]
    df = frame(spark, texts, ids).withColumn("x.y", F.monotonically_increasing_id() % 5)
    first = [sorted(map(tuple, drop(df).collect())) for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates)]
    for parts in (1, 5):
        mixed = df.repartition(parts, "`x.y`").orderBy(F.desc("`x.y`"))
        assert [sorted(map(tuple, drop(mixed).collect())) for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates)] == first
    assert [r[0] for r in first[0]] == [1, 3] and len(first[1]) == 2


def test_exact_long_text(spark):
    long = "word \t" * 300_000
    got = exact_dedup.exact_duplicates(frame(spark, [long, long.replace("\t", "\n"), "x"])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(0, 0, 2), (1, 0, 2), (2, 2, 1)]


def test_exact_odd_rows(spark):
    df = frame(spark, ["x", "x", "x", None, ""], [5, 5, None, None, 7])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 5, 3, True), (5, 5, 3, False), (None, 5, 3, False), (None, 7, 2, False), (7, 7, 2, True)], key=repr)
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns and sorted((r.doc_id, r.text) for r in left.collect()) == [(5, "x"), (7, "")]
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0 and exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0


# --- near dedup ----------------------------------------------------------------------


def brute_print(text, shingle):
    w = space_words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points):
    """(id, fingerprint) to smallest id reachable."""
    root = {i: i for i, _ in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in points:
        for j, b in points:
            if i < j and (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in points}


def test_fingerprints(spark):
    texts = ["", None, "One", "A b C", "a B c d", "Ä é ö ü ß " * 9, "x y z " * 5, "the quick brown fox jumps over the lazy dog " * 3]
    for shingle in (4, 5):
        got = {r.doc: r.fp for r in simhash.fingerprints(frame(spark, texts), shingle).collect()}
        assert {i: got[i] & (2**64 - 1) for i in got} == {i: brute_print(t, shingle) for i, t in enumerate(texts)}


@pytest.mark.parametrize("cell_rows", [64, 2])
def test_links_reach_all_near_points(spark, monkeypatch, cell_rows):
    """Chains and crowds of fingerprints; with small cells by way of midpoints."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    rng = random.Random(cell_rows)
    points = []
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 9])):
            points.append(at)
            for bit in rng.sample(range(64), rng.choice([1, 4, 4, 5])):
                at ^= 1 << bit
    points = list(dict.fromkeys(points))
    rows = [(i, simhash._signed(p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "first long, fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for i, fp in rows:
        groups.setdefault(roots.get(fp, fp), set()).add(i)
    expected = {}
    for i, c in brute_components(list(enumerate(points))).items():
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def broadcast_midpoints(df):
    """Whether the plan broadcasts rows that it makes from others."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                if "Generate" in below:
                    return True
    return False


def test_midpoints_of_a_crowd_are_not_broadcast(spark, monkeypatch):
    # 2,081 rows each, from a file of few bytes: a broadcast of them takes the driver's memory.
    monkeypatch.setattr(simhash, "CELL_ROWS", 2)
    df = spark.createDataFrame([(simhash._signed(1 << i),) for i in range(64)], "fp long")
    crowd = simhash.links(df)
    assert "Generate" in crowd._jdf.queryExecution().executedPlan().toString()
    assert not broadcast_midpoints(crowd)
    assert len({r.root for r in simhash.components(crowd).collect()}) == 1


def test_near_stage_broadcasts_no_midpoints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 2)
    plans, write = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, label: plans.append((label, broadcast_midpoints(df))) or write(df, label))
    first = spark.createDataFrame([(i, simhash._signed(1 << i)) for i in range(64)], "node long, fp long")
    pairs = simhash.print_links(first)
    assert "simhash-pairs" in dict(plans) and not any(bad for _, bad in plans)
    assert {r.root for r in simhash.components(pairs).collect()} == {0}


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(8)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(50)]
    df = spark.createDataFrame([(simhash._signed(a), simhash._signed(b)) for a, b in pairs], "a long, b long")
    got = df.select(F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("m")).collect()
    counts = lambda x: [(x >> 2 * i & 3).bit_count() for i in range(32)]
    for r, (a, b) in zip(got, pairs):
        assert r.m == sum(abs(x - y) for x, y in zip(counts(a), counts(b))) <= (a ^ b).bit_count()


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(400)) for _ in range(6)]
    texts = [None, "", *base]
    for b in base:
        w = b.split()
        for _ in range(5):
            v = list(w)
            v[rng.randrange(len(v))] = "edit"
            texts.append(" ".join(v))
    ids = [3 * i + 1 for i in range(len(texts))]
    df = frame(spark, texts, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicate_groups(df).collect()}
    points = [(i, brute_print(t, 4)) for i, t in zip(ids, texts)]
    expected = brute_components(points)
    assert got == {i: (f"{p:016x}", expected[i]) for i, p in points}


def test_similar_texts(spark, monkeypatch):
    """Copies with edits down to a similarity of 0.8 meet, in small and in crowded cells; other texts don't."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    texts, source = [], []
    for k, copies in enumerate([1] * 30 + [3] * 8 + [40]):
        base = [word() for _ in range(300)]
        for c in range(copies):
            w = list(base)
            for at in rng.sample(range(0, 300, 6), 5 if c else 0):  # about 25 of 296 shingles change
                w[at] = word()
            texts.append(" ".join(w))
            source.append(k)
    left = sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, texts)).collect())
    first = [source.index(k) for k in range(max(source) + 1)]
    assert set(first) <= set(left) and len(left) <= len(first) + 2
    groups = simhash._resolved(frame(spark, texts), 5, "doc_id", "text", 0.8).collect()
    assert all(source[r.component] == source[r.doc] for r in groups)


def brute_similar(texts, shingle=5):
    """The smallest index reachable over pairs of similarity 0.8, of each text."""
    sets = []
    for t in texts:
        w = space_words((t or "").lower())
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    root = list(range(len(texts)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if root[i] != root[j] and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def similar_components(spark, texts):
    return {r.doc: r.component for r in simhash._resolved(frame(spark, texts).repartition(3), 5, "doc_id", "text", 0.8).collect()}


def test_unlike_texts_stay(spark):
    """Texts of a similarity below 0.8, and unlike ones with a much-repeated line, are kept; other repeat counts of one text are not."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    base, line = [word() for _ in range(300)], [word() for _ in range(8)]
    texts = []
    for _ in range(30):
        w = list(base)
        for at in rng.sample(range(0, 300, 6), 8):
            w[at] = word()
        texts.append(" ".join(w))
    texts += [" ".join(line * 60 + [word() for _ in range(60)]) for _ in range(5)]
    texts += [" ".join(line * 3), " ".join(line * 30), " ".join(line * 7)]
    got = similar_components(spark, texts)
    assert got == brute_similar(texts) == {i: min(i, 35) for i in range(38)}


@pytest.mark.parametrize("cell,block", [(8, 256), (1, 2)])
def test_similar_pairs_in_crowded_cells(spark, monkeypatch, cell, block):
    """Texts that share half of their shingles, with planted pairs just above 0.8 and chains of them: as brute force has it."""
    monkeypatch.setattr(simhash, "CELL_PAIRS", cell)
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    shared, texts = [word() for _ in range(120)], []
    for k in range(60):
        w = shared + [word() for _ in range(60)]
        texts.append(" ".join(w))
        for _ in range((0, 1, 3)[k % 3]):
            w = list(w)
            for at in rng.sample(range(2, 178, 7), 3):
                w[at] = word()
            texts.append(" ".join(w))
    rng.shuffle(texts)
    got = similar_components(spark, texts)
    assert got == brute_similar(texts) and len(set(got.values())) < len(texts)


def test_similar_pairs_are_found_whatever_else_there_is(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    texts = []
    for _ in range(100):
        w = [word() for _ in range(101)]
        texts.append(" ".join(w))
        texts.append(" ".join(w[:92] + [word() for _ in range(9)]))  # 88 of 97 shingles each: 0.83
    want = brute_similar(texts)
    assert similar_components(spark, texts) == want == {i: i - i % 2 for i in range(200)}
    more = similar_components(spark, texts + [" ".join(word() for _ in range(60)) for _ in range(1500)])
    assert {i: more[i] for i in want} == want


def test_near_odd_rows(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "q r s t u v w"], [2, 2, None, None, 9])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(df).collect()), key=repr)
    assert got == sorted([(2, 2), (2, 2), (None, 2), (None, None), (9, 9)], key=repr)
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(2, "a b c d e f"), (9, "q r s t u v w"), (None, None)], key=repr)
    assert simhash.near_duplicate_groups(df.limit(0)).count() == 0 and simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_recall_of_near_pairs_in_crowded_cells(spark):
    """Over a thousand pairs from 0.8 on, many among texts that share a template: every one is found, and only they."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    template = [word() for _ in range(60)]
    texts = []
    for _ in range(60):
        base = template + [word() for _ in range(60)]
        for _ in range(rng.choice([1, 2, 20])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    got = similar_components(spark, texts)
    assert len(pairs) >= 1000 and got == {i: find(i) for i in range(len(texts))}


def test_near_odd_tables(spark):
    df = frame(spark, [None, "", "one two", "one two", "a b c d e f g h"], [4, None, 2, 2, 1]).withColumn("a.b", F.lit(1))
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "a b c d e f g h"), (2, "one two"), (4, None)]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(150_000))
    assert [r.doc_id for r in simhash.drop_near_duplicates(frame(spark, [long, long + " end"])).collect()] == [0]
