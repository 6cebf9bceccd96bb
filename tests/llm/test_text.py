"""Tokens, decontamination, secrets, quality, extraction and licences."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweave.llm import bpe, decontaminate, html_extract, licenses, quality, secrets, token_counts

DOC = "doc_id long, text string, lang string, token string, score string"


def frame(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "t", "s") for i, t in zip(ids, texts)], DOC)


# --- tokens ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "b", "'s", "'ll", "1", "é", "😀", "!", "<|endoftext|>", "\x1c", "\x85", "word", "THE", "֘", "ߊ", "aaaaaaaa", "\x00", " ", "　"]
    return ["", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(500)], "ab" * 5000, " " * 3000, "x y " * 4000]


def test_encoder_and_counts(library):
    texts = odd_texts()
    encoder, counter = bpe.PrefixEncoder("byte_bpe_50k.json"), token_counts.LengthEncoder("byte_bpe_50k.json")
    n = counter.lengths(texts)
    for text, want, k in zip(texts, library.encode_batch(texts, add_special_tokens=False), n):
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids and k == len(want.ids)
        assert encoder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_tables_may_be_cleared(library, monkeypatch):
    for module in (bpe, token_counts):
        monkeypatch.setattr(module, "KNOWN_ENTRIES", 5)
    texts = odd_texts()[:200]
    encoder, counter = bpe.PrefixEncoder("byte_bpe_50k.json"), token_counts.LengthEncoder("byte_bpe_50k.json")
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == want
    assert counter.lengths(texts) == [len(w) for w in want]


def test_token_queries(spark, library):
    texts = [None, "", "hello <|endoftext|> world " * 300, "hello", "hello"]
    df = frame(spark, texts, [1, None, 3, 4, 4])
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = token_counts.token_counts(df).collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(i, len((t or "").encode()), len(w), len(w) > 1024) for i, t, w in zip([1, None, 3, 4, 4], texts, want)]
    digests = bpe.encode_digests(df).collect()
    assert [r.ids_sha256 for r in digests] == [hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest() for w in want]
    assert [r.decoded_sha256 for r in digests] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    both = bpe.encode_decode(df)
    assert both.columns == [*df.columns, "token_ids", "decoded"] and [list(r.token_ids) for r in both.collect()] == want
    clash = bpe.encode_decode(df.withColumnRenamed("score", "Decoded"), ids_col="Token")
    assert clash.columns[-2:] == ["_Token", "_decoded"] and [r["_decoded"] for r in clash.collect()] == [t or "" for t in texts]
    assert token_counts.token_counts(df.limit(0)).count() == bpe.encode_digests(df.limit(0)).count() == 0


# --- decontamination ---------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, window):
    wins = {}
    for i, t in items:
        w = low_words(t)
        for o in range(len(w) - min(window, len(w)) + 1 if w else 0):
            wins.setdefault(tuple(w[o : o + window]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = low_words(t), set(), set()
        for n in {len(k) for k in wins}:
            for o in range(len(w) - n + 1):
                if tuple(w[o : o + n]) in wins:
                    hit.update(range(o, o + n))
                    found |= wins[tuple(w[o : o + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def brute_near(docs, items, slop):
    pairs = lambda w: list(zip(w, w[1:]))
    count = {}
    for _, t in docs:
        for p in pairs(low_words(t)):
            count[p] = count.get(p, 0) + 1
    out = {}
    for i, t in docs:
        at = {}
        for k, p in enumerate(pairs(low_words(t))):
            at.setdefault(p, []).append(k)
        n = 0
        for _, item in items:
            two = sorted((count[p], j, p) for j, p in enumerate(pairs(low_words(item))) if p in count)[:2]
            if len(two) == 2:
                (_, a, p), (_, b, q) = two
                n += any(abs((x - a) - (y - b)) <= slop for x in at.get(p, ()) for y in at.get(q, ()))
        out[i] = n
    return out


@pytest.mark.parametrize("window", [10, 4])
def test_contamination(spark, window):
    rng = random.Random(window)
    word = lambda: rng.choice("abcdefghij") + rng.choice(["", "x", "é", "Y"])
    items = [(k, " ".join(word() for _ in range(rng.choice([2, 5, 10, 11, 25])))) for k in range(12)] + [(50, "the, THE the"), (51, ""), (52, None), (53, "solo")]
    items.append((60, items[3][1]))
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 2)):
            piece = rng.choice(items)[1] or ""
            cut = piece.split()[rng.randint(0, 3) :]
            at = rng.randint(0, len(w))
            w[at:at] = cut + ["solo"] * rng.randint(0, 1)
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(60, None), (61, ""), (62, "the the the the the"), (63, "solo")]
    df, it = frame(spark, [t for _, t in docs]).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, it, window=window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(brute_contamination(docs, items, window))
    near = brute_near(docs, [x for x in items if x[0] != 60], decontaminate.SLOP)
    assert all((r.n_near > 0) == (near[r.doc_id] > 0) for r in got)
    left = decontaminate.drop_contaminated(df, it, window=window)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in got if not r.contaminated)


def test_contamination_odd_tables(spark):
    df = frame(spark, ["a b c d e f g h i j k", "a b c d e f g h i j k", None], [None, 4, 4])
    it = spark.createDataFrame([(None, "A b c d e f g h i j"), (7, None)], "item_id long, text string")
    assert sorted((r.n_hit, r.n_items) for r in decontaminate.contamination(df, it).collect()) == [(0, 0), (10, 0), (10, 0)]
    assert decontaminate.contamination(df.limit(0), it).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(df, it.limit(0)).collect()] == [0, 0, 0]


def test_contamination_of_repeated_rows(spark):
    """Rows alike in id and text, and rows without ids, are hit as often as one."""
    leak = "x y a b c d e f g h i j k z"
    df = frame(spark, [leak, leak, leak, leak, leak, "x y z"], [1, 2, 2, None, None, 3])
    it = spark.createDataFrame([(7, "a b c d e f g h i j k")], "item_id long, text string")
    got = decontaminate.contamination(df, it).collect()
    assert sorted(((r.doc_id, r.n_hit, r.contaminated) for r in got), key=repr) == sorted([(1, 11, True), *[(2, 11, True)] * 2, *[(None, 11, True)] * 2, (3, 0, False)], key=repr)
    assert [r.doc_id for r in decontaminate.drop_contaminated(df, it).collect()] == [3]


# --- secrets -------------------------------------------------------------------------


def brute_spans(text):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_base_spans(spark):
    rng = random.Random(6)
    parts = ["token", "TOKEN=", "secret", ": ", "=", '"', "password", "api_key", "apikey ", "AKIA", "ABCDEFGHIJ0123", "0123456789abcdef", "deadbeef", " ", "\n", "😀", "é", "x.y-z", "abcdefghijkl", "token=secret=abc", "password: token:abcdefghijklmnop"]
    texts = ["", None, *["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]]
    got = {r.doc_id: sorted((s.start, s.kind, s.end) for s in r.base) for r in secrets.secret_spans(frame(spark, texts)).collect()}
    assert got == {i: brute_spans(t or "") for i, t in enumerate(texts)}


def brute_battery(v):
    """encoding and the four p-values of a string, from the definitions."""
    upper = lambda z: max(1e-40, 0.5 * math.erfc(z / math.sqrt(2)))
    encoding = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", v) else "word" if v.isalnum() else "base64"
    alphabet = {"hex": secrets.HEX_ALPHABET, "word": secrets.WORD_ALPHABET, "base64": secrets.BASE64_ALPHABET}[encoding]
    v = v.lower() if encoding == "hex" else v.replace("-", "+").replace("_", "/")
    n, k = len(v), len(alphabet)

    def chi_tail(counts, shares):
        chi = sum((c - n * p) ** 2 / (n * p) for c, p in zip(counts, shares))
        free = len(shares) - 1
        return upper(((max(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))

    groups = ["0123456789", "abcdef"] if encoding == "hex" else ["0123456789", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "aeiou", "bcdfghjklmnpqrstvwxyz", "+/"][: 5 + (encoding == "base64")]
    x = [alphabet.index(c) for c in v]
    turns = sum((a >= k / 2) != (b >= k / 2) for a, b in zip(x, x[1:]))
    mean = sum(x) / n
    power = sum((a - mean) ** 2 for a in x)
    serial = abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / power + 1 / n) * math.sqrt(n) if power else math.sqrt(n)
    both = lambda z: min(1.0, 2 * upper(z))
    vowel = [c in "AEIOUaeiou" for c in v]
    p = 10 / k
    variance = (n - 1) * 2 * p * (1 - p) * (1 - 2 * p * (1 - p)) + 2 * (n - 2) * (p * (1 - p) - 4 * (p * (1 - p)) ** 2)
    vowels = 1.0 if encoding == "hex" else upper((sum(a != b for a, b in zip(vowel, vowel[1:])) - (n - 1) * 2 * p * (1 - p)) / math.sqrt(variance))
    return encoding, vowels, chi_tail([v.count(c) for c in alphabet], [1 / k] * k), chi_tail([sum(v.count(c) for c in g) for g in groups], [len(g) / k for g in groups]), both(abs(turns - (n - 1) / 2) * 2 / math.sqrt(n - 1)), both(serial)


def test_battery_matches_definitions(spark):
    rng = random.Random(9)
    values = ["".join(rng.choice(a) for _ in range(rng.randint(20, 90))) for a in ("0123456789abcdef", "0123456789ABCDEF", secrets.WORD_ALPHABET, secrets.BASE64_ALPHABET + "-_", "ab", "getUserName2") for _ in range(40)] + ["a" * 30, "A1" * 40]
    rows = secrets.battery(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    for r in rows:
        encoding, *p = brute_battery(r.value)
        assert r.encoding == encoding
        for got, want in zip((r.p_vowels, r.p_uniform, r.p_classes, r.p_runs, r.p_serial), p):
            assert got == pytest.approx(want, rel=2e-2, abs=3e-7)


def test_false_discovery_control(spark):
    """The rule over cells against its definition over single tokens."""
    rng = random.Random(2)
    schema = "value string, encoding string, score double"
    rows = [("x" * rng.choice([20, 30, 50, 90]), rng.choice(["word", "base64"]), rng.choice([rng.uniform(0, 30), rng.uniform(20, 150)])) for _ in range(600)]
    names = [(e, c, s, rng.randint(0, 40)) for e in ("word", "base64") for c in range(3) for s in range(20, 401)]
    ordinary, table = [], {}
    for e in ("word", "base64"):
        for c in range(3):
            total, upto = sum(n for x, y, _, n in names if (x, y) == (e, c)), 0
            for cell in range(401):
                upto += sum(n for x, y, s, n in names if (x, y, s) == (e, c, cell))
                table[e, c, cell] = (upto + 1) / (total + 1)
                ordinary.append((e, c, cell, table[e, c, cell]))
    tested = spark.createDataFrame(rows, schema)
    got = sorted((r.value, r.encoding, r.score) for r in secrets.random_tokens(tested, spark.createDataFrame(ordinary, "encoding string, class int, cell int, p double"), 0.05).collect())
    level = lambda v: min(7, int(math.log2(len(v) / 20)))
    want = []
    for c in range(3):
        mine = [(table[e, c, min(400, int(s * 2))], v, e, s) for v, e, s in rows if level(v) == c]
        ps = sorted(p for p, *_ in mine)
        cut = max((p for i, p in enumerate(ps, 1) if p <= sum(q <= p for q in ps) / len(ps) * 0.05), default=-1)
        want += [x[1:] for x in mine if x[0] <= cut]
    assert got == sorted(want) and got


def test_random_tokens_and_ordinary_names(spark):
    """At most one name in twenty of each style is reported, and nineteen random tokens in twenty."""
    rng = random.Random(5)
    words = "customer invoice payment address country thread socket kernel buffer stream packet router gateway metric alert get user name file path handler of the on main java src utils test index".split()
    several = lambda: [rng.choice(words) for _ in range(rng.randint(4, 8))]
    camel = lambda: "".join(w.capitalize() for w in several())
    sets = {
        "camel": [camel() for _ in range(300)],
        "digit": [camel() + str(rng.randint(0, 9)) for _ in range(300)],
        "snake": ["_".join(several()) for _ in range(300)],
        "kebab": ["-".join(several()) for _ in range(300)],
        "path": ["/".join(several()) for _ in range(300)],
        "stamp": [f"20{rng.randint(10, 30)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}" + f"{rng.randint(0, 9999):012}" for _ in range(300)],
    }
    sets = {k: [x for x in v if len(x) >= secrets.LEAST] for k, v in sets.items()}
    for n in (20, 32, 64):
        sets[f"random {n}"] = ["".join(rng.choice(secrets.BASE64_ALPHABET[: 62 + 2 * (i % 2)]) for _ in range(n)) for i in range(100)]
    sets["random HEX"] = ["".join(rng.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(100)]
    kinds = [(k, x) for k, v in sets.items() for x in v] + [("repeated", "abc123" * 9)] * 20
    got = {r.doc_id: r.n_random for r in secrets.secret_spans(frame(spark, [f"a {x} b" for _, x in kinds])).collect()}
    found = {k: sum(got[i] for i, (kind, _) in enumerate(kinds) if kind == k) / max(1, len(v)) for k, v in sets.items()}
    assert {k: share for k, share in found.items() if not (share >= 0.95 if k.startswith("random") else share <= 0.05)} == {}


def test_many_matches_take_linear_time(spark):
    text = "0123456789abcdef x " * 100_000
    row = frame(spark, [text]).select(secrets.matches(F.col("text"), secrets.HEX).alias("m")).selectExpr("size(m) AS n", "m[99999].start AS a", "m[99999].end AS b").first()
    assert tuple(row) == (100_000, 19 * 99_999, 19 * 99_999 + 16)


def test_secret_odd_rows(spark):
    key = "q7Zp2LmX9sVb4Tn8Rk3Wd6Yh"
    df = frame(spark, [f"k {key}", f"k {key}", None], [None, 5, 5])
    assert sorted(r.n_random for r in secrets.secret_spans(df).collect()) == [0, 1, 1]
    assert secrets.secret_spans(df.limit(0)).count() == 0


# --- quality --------------------------------------------------------------------------


def brute_kneser_ney(texts, order):
    """Probability of each n-gram by the textbook definition."""
    counts = {order: {}}
    for t in texts:
        s = quality.PAD * (order - 1) + t
        for i in range(len(s) - order + 1):
            counts[order][s[i : i + order]] = counts[order].get(s[i : i + order], 0) + 1
    for n in range(order - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    cuts = {}
    for n, t in counts.items():
        n1, n2, n3, n4 = (max(0.5, sum(c == k for c in t.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        cuts[n] = [max(0.05, min(x, k - 0.05)) for k, x in enumerate(d, 1)]

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(counts[1]) + 1)
        below = p(g[1:])
        row = {h: c for h, c in counts[n].items() if h[:-1] == g[:-1]}
        if not row:
            return below
        total = sum(row.values())
        gamma = sum(cuts[n][min(c, 3) - 1] for c in row.values()) / total
        c = row.get(g, 0)
        return (c - cuts[n][min(c, 3) - 1] if c else 0) / total + gamma * below

    return p


def test_model_matches_definition(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aab c") for _ in range(rng.randint(1, 40))) for _ in range(15)]
    df = frame(spark, texts)
    model = quality.KneserNey(df, 3)
    wanted = quality.gram_counts(frame(spark, [*texts, "abcd zz"]), 3).select("lang", "gram")
    p = brute_kneser_ney(texts, 3)
    for r in model.scores(wanted).collect():
        g = "".join(chr(r.gram >> 12 * k & 0xFFF) for k in (2, 1, 0))
        assert math.exp(r.log_p) == pytest.approx(p(g), rel=1e-9)


@pytest.mark.parametrize("room", [1 << 28, 0])
def test_quality(spark, room):
    """Both ways of scoring; junk goes and clean texts stay, also those without a label."""
    rng = random.Random(7)
    clean = lambda: " ".join(rng.choice(["the", "river", "stone", "walks", "over", "green", "hills"]) for _ in range(60)) + "."
    junk = lambda: "".join(rng.choice("#$%&*XQZ19") for _ in range(200))
    texts = [clean() for _ in range(80)] + [junk() for _ in range(10)] + [None, ""]
    df = frame(spark, texts)
    ids = spark.createDataFrame([(i,) for i in range(60)] + [(3,), (None,)], "doc_id long")
    scored = quality.perplexities(df, ids, max_score_bytes=room)
    kept = {r.doc_id for r in scored.where(scored.columns[-1]).collect()}
    assert kept == set(range(80))
    assert scored.count() == len(texts) and scored.columns[: len(df.columns)] == df.columns
    labels = ids.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    left = quality.drop_low_quality(df, labels, max_score_bytes=room)
    assert left.columns == df.columns and left.count() == 80


def test_odd_trusted_texts_do_not_set_the_limit(spark):
    rng = random.Random(17)
    clean = lambda: " ".join(rng.choice(["the", "river", "stone", "walks", "over", "green", "hills"]) for _ in range(60)) + "."
    junk = lambda: "".join(rng.choice("#$%&*XQZ19") for _ in range(200))
    texts = [clean() for _ in range(60)] + [junk() for _ in range(8)] + ["stone the " * 40 + junk()[:60] for _ in range(6)]
    ids = spark.createDataFrame([(i,) for i in range(64)], "doc_id long")  # four trusted texts are junk
    scored = quality.perplexities(frame(spark, texts), ids)
    kept = {r.doc_id for r in scored.where(scored.columns[-1]).collect()}
    assert set(range(60)) <= kept and not kept & set(range(64, 74))


def test_symbols_keep_every_character():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(chr(rng.choice([rng.randint(1, 300), rng.randint(0x370, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 20)))
        s, out = quality.symbols(text).tolist(), ""
        while s:
            x = s.pop(0)
            out += chr(x) if x < quality.PLAIN else chr(quality.PLAIN + (x - quality.PLAIN) * quality.PAIR + s.pop(0) - quality.PLAIN - quality.PAIR)
        assert out == text
    assert len(set(quality.grams("\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed", 5).tolist())) == 22


def test_quality_of_other_scripts(spark):
    """Chinese and Korean texts are told from shuffled characters of the same script."""
    rng = random.Random(11)
    words = {"zh": "\u4eca\u5929 \u5929\u6c14 \u5f88\u597d \u6211\u4eec \u4e00\u8d77 \u53bb\u516c\u56ed \u6563\u6b65 \u7136\u540e \u56de\u5bb6 \u5403\u996d".split(), "ko": "\uc624\ub298\uc740 \ub0a0\uc528\uac00 \uc88b\uc544\uc11c \uc6b0\ub9ac\ub294 \uacf5\uc6d0\uc5d0\uc11c \uc0b0\ucc45\uc744 \ud588\ub2e4".split()}
    rows = []
    for lang, ws in words.items():
        for i in range(90):
            text = "".join(rng.choice(ws) + " " * (lang == "ko") for _ in range(80))
            rows.append((len(rows), "".join(rng.sample(text, len(text))) if i >= 80 else text, lang, i))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, i int")
    ids = df.where("i < 60").select("doc_id")
    scored = quality.perplexities(df, ids)
    kept = {r.doc_id for r in scored.where(scored.columns[-1]).collect()}
    assert kept == {r[0] for r in rows if r[3] < 80}


def test_both_ways_of_scoring_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = quality.trusted(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    ways = [{r.doc_id: (r.perplexity, r.threshold, r.accepted) for r in quality.perplexities(docs, ids, max_score_bytes=room).collect()} for room in (1 << 28, 0)]
    assert ways[0].keys() == ways[1].keys()
    for i, (p, t, a) in ways[0].items():
        q, u, b = ways[1][i]
        assert a == b and (p, t) == pytest.approx((q, u), rel=1e-9)


def test_quality_odd_tables(spark):
    df = frame(spark, ["abc", None, "abc"], [1, 2, None], lang=None)
    none = spark.createDataFrame([], "doc_id long")
    scored = quality.perplexities(df, none)
    assert sorted((r[scored.columns[-1]] for r in scored.collect())) == [False, True, True]
    assert quality.perplexities(df.limit(0), none).count() == 0
    clash = df.selectExpr("*", "1 AS Perplexity", "2 AS `a.b`")
    assert quality.perplexities(clash, none).columns[-3:] == ["_perplexity", "threshold", "accepted"]
    long = frame(spark, ["the river " * 100_000, "the river " * 3])
    assert quality.perplexities(long, spark.createDataFrame([(0,), (1,)], "doc_id long")).count() == 2


# --- extraction -----------------------------------------------------------------------


def brute_cut(content, boiler, edges):
    n, best = len(content), None
    for mask in range(1 << n):
        cost = sum(boiler[i] if mask >> i & 1 else content[i] for i in range(n)) + sum(c for i, j, c in edges if (mask >> i ^ mask >> j) & 1)
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 8)
        content, boiler = ([rng.randint(0, 20) for _ in range(n)] for _ in range(2))
        edges = [(i, j, rng.randint(0, 9)) for i in range(n) for j in range(i) if rng.random() < 0.6]
        side = html_extract.minimum_cut(content, boiler, edges)
        cost = sum(boiler[i] if side[i] else content[i] for i in range(n)) + sum(c for i, j, c in edges if side[i] != side[j])
        assert cost == brute_cut(content, boiler, edges)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><a href=x>Home</a></header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div id="cookie-notice"><p>We use cookies on this site to do things, ok?</p></div>
<main><h1>Real &amp; title</h1><script>var t = "</p><p>no";</script><p>First <b>paragraph</b>
 of&nbsp;text.<br><p>Short.</p><div class="ad">Buy this great product now and save money today.</div><!-- <p>gone</p> --><table><tr><td>a</td><td>b</td></tr></table>
<section class="comments"><p>I like this article very much indeed, thanks for it.</p></section></main>
<aside><p>Related texts stand here, with enough words to look real.</p></aside><form><p>Sign up</p><input></form><footer>&copy; c</footer>"""


def test_page(spark):
    want = "Real & title\nFirst paragraph of text.\nShort.\na\nb"
    assert html_extract.main_text(PAGE) == want
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, None, ""), (None, "w", "<p"), (4, "x", "plain text without any tags at all, but long enough.")], "page_id long, url string, html string")
    got = {r.url: (r.text, r.n_chars) for r in html_extract.page_texts(pages).collect()}
    assert got["u"] == (want, len(want)) and got["v"] == got[None] == ("", 0) and got["x"][0].startswith("plain text")
    assert html_extract.extract(pages).columns == ["page_id", "url", "html", "text"]
    assert html_extract.page_texts(pages.limit(0)).count() == 0


def test_deep_and_long_pages():
    assert html_extract.main_text("<article>" + "<div>" * 2000 + "<p>deep text that stays here.</p>").endswith("deep text that stays here.")
    many = html_extract.main_text("<article>" + "<p>one more paragraph of the article.</p>" * 3000 + "</article>")
    assert many.count("\n") == 2999


# --- licences --------------------------------------------------------------------------

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""


def test_every_known_sentence_passes_the_stem_test():
    book = licenses.SentenceBook()
    known = set()
    for name, forms in licenses._all_sentences().items():
        known.add(name)
        for form in forms:
            text = form.replace("{}", "some name")
            assert licenses._STEMS.search(text)
            assert book.identify(licenses.normalise(text)) == (name,)
    rng = random.Random(1)
    for licence, forms in licenses._all_names().items():
        known |= {f"name:{licence}", f"spdx:{licence}"}
        for form in rng.sample(forms, min(4, len(forms))):
            text = " ".join((rng.choice(licenses.SUBJECTS), rng.choice(licenses.VERBS), rng.choice(licenses.LINKS), form))
            assert licenses._STEMS.search(text) and book.identify(licenses.normalise(text)) == (f"name:{licence}",), text
    known |= {f"{kind}:{x}" for kind in ("name", "spdx") for x in licenses.MORE_IDS}
    assert all(set(rule) <= known for rules in licenses._all_rules().values() for rule in rules)


def test_identifier_lines():
    book, rules = licenses.SentenceBook(), licenses._all_rules()
    found = lambda text: sorted({h[2] for h in licenses.rule_matches(licenses.known_sentences(text, book), rules)})
    assert found("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nimport x") == ["GPL-2.0-only"]
    assert found("# SPDX-License-Identifier: (MIT OR Apache-2.0)") == ["Apache-2.0", "MIT"]
    assert found("SPDX-License-Identifier: GPL-2.0+") == found("SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0-or-later"]
    assert found("SPDX-License-Identifier: NoSuchLicence") == found("SPDX-License-Identifier:") == []
    for licence in (*licenses._all_names(), *licenses.MORE_IDS):
        assert found(f"/* SPDX-License-Identifier: {licence} */ code") == [licence]
    assert found("Licensed under GPL-3.0.") == ["GPL-3.0-only"] and found("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007") == ["GPL-3.0-only"]


def brute_known(text, book):
    """Every run of pieces is looked up, without the question whether a sentence may go on."""
    lines = [x for x in licenses._cut(text) if licenses.normalise(text[slice(*x)])]
    words = [licenses.normalise(text[a:b]) for a, b in lines]
    runs = []
    for i in range(len(words)):
        ends = {}
        for j in range(i, len(words)):
            sentence = " ".join(words[i : j + 1])
            if names := book.identify(sentence):
                ends[j] = names
                if sentence not in book.whole and not sentence.startswith("spdx") and not any(True for _ in book._led(sentence)):
                    break
        runs.append(ends)
    out = []
    for i, ends in enumerate(runs):
        single = [e for e in ends if not any(m < e and e in runs[m + 1] for m in ends)]
        if single:
            a, b = lines[i][0], lines[max(single)][1]
            out += [(a + len(text[a:b]) - len(text[a:b].lstrip()), b, n) for n in ends[max(single)]]
    return sorted(out)


def brute_rules(sequence, rules, gap):
    hits = []
    for licence, variants in rules.items():
        for rule in variants:
            for i in range(len(sequence)):
                if sequence[i][4] != rule[0]:
                    continue
                used = [i]
                while len(used) < len(rule):
                    last = sequence[used[-1]]
                    later = [j for j in range(used[-1] + 1, len(sequence)) if sequence[j][4] == rule[len(used)] and all(sequence[k][2] - last[3] <= gap + 1 for k in range(used[-1] + 1, j + 1))]
                    if not later:
                        break
                    used.append(later[0])
                if len(used) == len(rule):
                    hits.append((sequence[i][0], sequence[used[-1]][1], licence, set(used)))
    return sorted({(s, e, x, len(u)) for s, e, x, u in hits if not any(u < v for *_, v in hits)})


def test_licences_against_brute_force():
    book, rules, rng = licenses.SentenceBook(), licenses._all_rules(), random.Random(8)
    forms = [f.replace("{}", "a b c") for fs in licenses.SENTENCES.values() for f in fs] + ["Licensed under the MIT License", "SPDX-License-Identifier: MIT OR Zlib", "Some words", "GNU General Public License", "version 2"]
    for _ in range(150):
        text = "".join(rng.choice(forms) + rng.choice([".", ". ", "\n", "\n\n", "; ", ":\n# "]) for _ in range(rng.randint(0, 12)))
        if rng.random() < 0.5:
            text = text.replace(" ", rng.choice(["\n", " "]), rng.randint(0, 30))
        got = licenses.known_sentences(text, book)
        assert sorted((a, b, n) for a, b, _, _, n in got) == (brute_known(text, book) if licenses._STEMS.search(text) else [])
        assert licenses.rule_matches(got, rules) == brute_rules(got, rules, licenses.GAP)


def test_many_notices_take_linear_time():
    book, rules = licenses.SentenceBook(), licenses._all_rules()
    text = "Licensed under the MIT License.\n" * 20_000
    started = time.process_time()
    assert len(licenses.rule_matches(licenses.known_sentences(text, book), rules)) == 20_000
    assert time.process_time() - started < 5


def test_licences_odd_rows(spark):
    df = frame(spark, [MIT, MIT, None, "", MIT * 50], [1, 1, None, None, None])
    got = sorted(((r.doc_id, r.n_sentences, r.licenses) for r in licenses.license_scan(df).collect()), key=repr)
    assert got == sorted([(1, 3, "MIT"), (1, 3, "MIT"), (None, 0, ""), (None, 0, ""), (None, 150, "MIT")], key=repr)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_license_rules(spark):
    texts = ["words.\nLicensed under the Apache License, Version 2.0.\nmore", "x " * 50 + "x. Released under the MIT License. y", BSD, BSD + ENDORSE, ENDORSE + BSD, "Licensed under CC BY-NC 4.0.", "a licence of no kind", None, ""]
    got = {r.doc_id: r.licenses for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert got == {0: "Apache-2.0", 1: "MIT", 2: "BSD-2-Clause", 3: "BSD-3-Clause", 4: "BSD-2-Clause", 5: "CC-BY-NC-4.0", 6: "", 7: "", 8: ""}


def test_rules_need_order_and_nearness():
    rules = {"L": [["a", "b"]]}
    seq = lambda *p: [(k, k + 1, k, k, n) for k, n in p]
    assert licenses.rule_matches(seq((0, "a"), (4, "b")), rules) == [(0, 5, "L", 2)]
    assert licenses.rule_matches(seq((0, "a"), (5, "b")), rules) == []
    assert licenses.rule_matches(seq((0, "b"), (1, "a")), rules) == []


HOLDER = "Copyright (c) 2020 Some Holder\n"
GPL = """    This program is free software%s you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation%s either version %d of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
WRAPPED = {
    "GPL-3.0-or-later": (GPL % (":", ",", 3), 2),
    "GPL-2.0-or-later": (GPL % (";", ";", 2), 2),
    "Apache-2.0": (APACHE, 4),
    "MPL-2.0": (MPL, 1),
    "MIT": (MIT, 3),
    "ISC": (ISC, 1),
    "BSD-2-Clause": (BSD, 3),
    "BSD-3-Clause": (BSD + ENDORSE, 4),
}


def test_wrapped_licences(spark):
    """Canonical texts, alone, after a notice line with and without a blank line, and as comments."""
    forms = [lambda t: t, lambda t: HOLDER + t, lambda t: HOLDER + "\n" + t, lambda t: "".join(f" * {line}\n" for line in (HOLDER + "\n" + t).splitlines())]
    cases = [(form(text), name, n) for name, (text, n) in WRAPPED.items() for form in forms]
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in licenses.license_scan(frame(spark, [t for t, _, _ in cases])).collect()}
    assert got == {i: (name, n) for i, (_, name, n) in enumerate(cases)}


def test_every_known_form_is_found_in_a_text():
    """As one line within a text, and with a line for each word."""
    book = licenses.SentenceBook()
    for name, forms in licenses._all_sentences().items():
        for form in forms:
            text = form.replace("{}", "some name")
            for inside in (text, text.replace(" ", "\n")):
                names = [x[4] for x in licenses.known_sentences(f"Some words. {inside}.\nMore words.", book)]
                assert name in names, inside


def test_padded_licences(spark):
    """Indents and comment signs don't count as length."""
    text = "".join(" " * 400 + "#" * 40 + line + " " * 100 + "\n" for line in MIT.splitlines())
    assert [(r.licenses, r.n_sentences) for r in licenses.license_scan(frame(spark, [text])).collect()] == [("MIT", 3)]


def test_words_of_other_scripts_are_encoded_once(monkeypatch):
    encoder = bpe.PrefixEncoder("byte_bpe_50k.json")
    piece = "слово-слово" * 20  # too long to be known as a piece
    first = encoder.encode(piece)
    assert encoder.decode(first) == piece
    monkeypatch.setattr(encoder, "encode_word", lambda word: pytest.fail("encoded again"))
    assert encoder.encode(piece) == first
