"""Secret scans in DataFrame operations only: patterns, and a battery of randomness tests for tokens.

Base findings are pattern matches. Their places come from one split and one extraction with the same
pattern: what lies before a match is the sum of the pieces and matches before it.

The battery finds further spans: long tokens whose characters look drawn at random. Each candidate's
encoding (hex, digits and letters, or base64) is inferred from its characters. Five tests hold it against
a random string of that encoding: chi-squared tests of uniformity over the alphabet and over its classes
(vowels and consonants of either case, digits, marks), a runs test above and below the middle of the
alphabet, one of vowels (which words alternate more than chance does; not for hex), and the serial
correlation of neighbours. Fisher's sum of their logarithms is the token's score: low for random strings,
high for words.

False discoveries are secrets reported that are ordinary names. So the hypothesis to be rejected is
"ordinary": its distribution of scores, by encoding and length class, comes from names made of words, in
camel case with a digit, snake case, kebab case and paths. The words are those of every document of the
corpus, besides names made of a fixed list of programmers' words, which stand in where a corpus has few
words. A candidate's p-value is the share of names in its class that score as low; Benjamini-Hochberg over
all candidates of a length class decides which are secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import table, written

#: The base patterns and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ["assign", "access", "hex", "random"]

#: Candidates of the battery: runs of at least so many characters of the widest alphabet.
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}" % LEAST
LEVEL = 0.02
#: Scores are held in cells of half a unit, up to the last one; length classes double up to the last one.
CELLS, CLASSES = 400, 8
#: Names from the fixed words in the first class; half as many in the next one, and so on.
FIXED_NAMES = 32_768
#: Words that names are made of.
NAME_WORDS = "get set user name file path handler data list item index value key map node tree build make load save read write open close start stop run task job queue event message request response client server session config option param result error status count total size length max min first last next prev parent child root leaf test case main util helper base model view controller service factory manager provider cache store table row column field record query update insert delete select order group filter sort merge split parse format encode decode string number integer array object type class method function module package import export version release source target".split()
HEX_ALPHABET = "0123456789abcdef"
WORD_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points, end exclusive.

    Running sums are taken in blocks of about the square root of their number, so that many matches cost no copies of the whole array each.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Pieces between the matches: one more than there are matches.
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda piece, value: F.struct(F.length(piece).alias("gap"), F.length(value).alias("size"), value.alias("value")))

    def placed(pairs: Column) -> Column:
        size = F.size(pairs)
        block = F.ceil(F.sqrt(size)).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), size, block), lambda at: F.slice(pairs, at, block))
        total = lambda rows: F.aggregate(rows, F.lit(0), lambda a, r: a + r["gap"] + r["size"])
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(blocks, zero, lambda a, rows: F.struct((a["at"] + total(rows)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        def run(rows: Column, start: Column) -> Column:
            def step(acc: Column, r: Column) -> Column:
                first = acc["at"] + r["gap"]
                last = first + r["size"]
                return F.struct(last.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), last.alias("end"), r["value"].alias("value")))).alias("out"))

            return F.aggregate(rows, F.struct(start.alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])

        return F.flatten(F.zip_with(blocks, starts, run))

    some = F.transform(F.array(F.filter(pairs, lambda r: r["size"].isNotNull())), placed)[0]
    return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(some)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind: array<struct<start, kind, end>>."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], "^" + ASSIGN + "$", 1)) >= ASSIGN_LEAST)
    return {"assign": _spans(assign, "assign"), "access": _spans(matches(text, ACCESS), "access"), "hex": _spans(matches(text, HEX), "hex")}


def _upper_tail(z: Column) -> Column:
    """P(N > z) for z >= 0: the usual rational approximation (absolute error below 1e-7) and its tail."""
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.2316419)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def battery(candidates: DataFrame, value: str = "value") -> DataFrame:
    """``candidates`` with encoding, p_uniform, p_classes, p_runs, p_vowels, p_serial and score of each string in ``value`` (at least two characters of the candidates' alphabet)."""
    v = F.col(value)
    n = F.length(v).cast("double")
    encoding = F.when(v.rlike("^[0-9a-f]+$") | v.rlike("^[0-9A-F]+$"), "hex").when(v.rlike("^[A-Za-z0-9]+$"), "word").otherwise("base64")
    df = candidates.withColumn("encoding", encoding)
    hexed, word = F.col("encoding") == "hex", F.col("encoding") == "word"
    canon = F.when(hexed, F.lower(v)).otherwise(F.translate(v, "-_", "+/"))
    alphabet = F.when(hexed, F.lit(HEX_ALPHABET)).when(word, F.lit(WORD_ALPHABET)).otherwise(F.lit(BASE64_ALPHABET))
    df = df.withColumn("canon", canon).withColumn("alphabet", alphabet)
    k = F.length("alphabet").cast("double")
    # The alphabets hold no character that is special within a class of a pattern but these.
    count = lambda chars: (n - F.length(F.translate("canon", chars, ""))).cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    letters = F.transform(F.sequence(F.lit(1), F.length("alphabet")), lambda i: n - F.length(F.replace(F.col("canon"), F.substring(F.col("alphabet"), i, F.lit(1)), F.lit(""))))
    df = df.withColumn("squares", F.aggregate(letters, zero, lambda a, c: a + c * c))

    def tail(chi: Column, freedom: Column) -> Column:
        """Wilson-Hilferty: the cube root of a chi-squared is about normal."""
        spread = F.lit(2.0) / (freedom * 9)
        return (F.pow(F.greatest(chi, zero) / freedom, F.lit(1.0 / 3)) - (one - spread)) / F.sqrt(spread)

    z_uniform = tail(F.col("squares") * k / n - n, k - 1)
    parts = [("0123456789", 10), ("AEIOU", 5), ("BCDFGHJKLMNPQRSTVWXYZ", 21), ("aeiou", 5), ("bcdfghjklmnpqrstvwxyz", 21), ("+/", 2)]
    by_class = lambda groups, total: sum((count(c) - n * (m / total)) * (count(c) - n * (m / total)) / (n * (m / total)) for c, m in groups)
    chi_class = F.when(hexed, by_class([("0123456789", 10), ("abcdef", 6)], 16)).when(word, by_class(parts[:5], 62)).otherwise(by_class(parts, 64))
    z_class = tail(chi_class, F.when(hexed, 1.0).when(word, 4.0).otherwise(5.0))
    df = df.withColumn("z_uniform", z_uniform).withColumn("z_class", z_class)
    df = df.withColumn("codes", F.transform(F.array_remove(F.split("canon", ""), ""), lambda c: F.position(c, F.col("alphabet")).cast("double") - 1))
    codes = F.col("codes")
    df = df.withColumn("next", F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))))
    df = df.withColumn("former", F.slice(codes, F.lit(1), F.size("next")))
    # In a random string each neighbour lies across the middle of the alphabet with probability one half.
    turns = F.aggregate(F.zip_with("former", "next", lambda x, y: F.when((x >= k / 2) != (y >= k / 2), 1.0).otherwise(0.0)), zero, lambda a, t: a + t)
    z_runs = F.abs(turns - (n - 1) / 2) * 2 / F.sqrt(n - 1)
    # Turns between vowels and others; neighbouring turns share a letter, so they covary.
    df = df.withColumn("vowels", F.transform(F.array_remove(F.split("canon", ""), ""), lambda c: F.position(c, F.lit("AEIOUaeiou")) > 0))
    rest = F.slice("vowels", F.lit(2), F.greatest(F.size("vowels") - 1, F.lit(0)))
    df = df.withColumn("turns", F.aggregate(F.zip_with(F.slice("vowels", F.lit(1), F.size(rest)), rest, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)), zero, lambda a, t: a + t))
    both = (F.lit(10.0) / k) * (one - F.lit(10.0) / k)
    spread = (n - 1) * 2 * both * (one - both * 2) + (n - 2) * 2 * (both - both * both * 4)
    z_vowels = (F.col("turns") - (n - 1) * 2 * both) / F.sqrt(F.greatest(spread, F.lit(1e-9)))
    df = df.withColumn("z_vowels", z_vowels)
    df = df.withColumn("mean", F.aggregate(codes, zero, lambda a, c: a + c) / n).withColumn("z_runs", z_runs)
    m = F.col("mean")
    power = F.aggregate(codes, zero, lambda a, c: a + (c - m) * (c - m))
    serial = F.aggregate(F.zip_with("former", "next", lambda x, y: (x - m) * (y - m)), zero, lambda a, t: a + t)
    z_serial = F.when(power > 0, F.abs(serial / F.greatest(power, F.lit(1e-9)) + one / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    p = lambda z, sides: F.greatest(F.lit(1e-40), F.least(one, z * sides))
    upper = lambda z: F.when(z >= 0, _upper_tail(F.least(z, F.lit(13.0)))).otherwise(one - _upper_tail(F.least(-z, F.lit(13.0))))
    df = df.withColumn("p_uniform", p(upper(F.col("z_uniform")), 1)).withColumn("p_classes", p(upper(F.col("z_class")), 1))
    df = df.withColumn("p_runs", p(upper(F.col("z_runs")), 2)).withColumn("p_serial", p(upper(z_serial), 2))
    df = df.withColumn("p_vowels", F.when(F.col("encoding") == "hex", 1.0).otherwise(p(upper(F.col("z_vowels")), 1)))
    score = sum((F.log(x) * -2 for x in ("p_uniform", "p_classes", "p_runs", "p_vowels", "p_serial")), F.lit(0.0))
    return df.withColumn("score", score).drop("canon", "alphabet", "squares", "codes", "next", "former", "mean", "vowels", "turns", "z_uniform", "z_class", "z_runs", "z_vowels")


def length_class(length: Column) -> Column:
    """Lengths from LEAST on in classes that double; the last one is open."""
    return F.least(F.lit(CLASSES - 1), F.floor(F.log2(length / LEAST))).cast("int")


def score_cell(score: Column) -> Column:
    return F.least(F.lit(CELLS), F.floor(score * 2)).cast("int")


def ordinary_names(texts: DataFrame, text: str = "text") -> DataFrame:
    """class, value: a name made of words of each text, and names of the fixed words.

    A hash of the text deals the length class (half of the texts to the first, a quarter to the next, ...), the
    length within it, the place of the words and the style. Texts without room for the class give no name.
    """
    spark = texts.sparkSession
    low = F.lit(LEAST) * F.pow(F.lit(2), "class").cast("int")
    dealt = lambda i, n: F.pmod(F.xxhash64("seed", F.lit(i)), n).cast("int")
    size = (low + dealt(0, low)).alias("size")
    fixed = F.array(*map(F.lit, NAME_WORDS))
    rows = spark.range(2 * FIXED_NAMES).select(F.xxhash64("id").alias("seed"), _dealt_class("id").alias("class")).select("seed", "class", size)
    drawn = F.transform(F.sequence(F.lit(1), (F.col("size") / 2).cast("int")), lambda i: F.get(fixed, F.pmod(F.xxhash64("seed", i), F.lit(len(NAME_WORDS))).cast("int")))
    rows = rows.select("seed", "class", "size", drawn.alias("words"))
    own = texts.select(F.xxhash64(text).alias("seed"), F.col(text).alias("text"), F.length(text).alias("room"))
    own = own.withColumn("class", _dealt_class("seed")).select("seed", "class", "text", "room", size).where("room >= 3 * size")
    piece = F.substring(F.col("text"), dealt(1, F.col("room") - 3 * F.col("size") + 1) + 1, 3 * F.col("size"))
    words = F.array_remove(F.transform(F.split(piece, r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, "[^A-Za-z]+", "")), "")
    rows = rows.unionByName(own.select("seed", "class", "size", words.alias("words")))
    digit = dealt(2, F.lit(10)).cast("string")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    camel = F.substring(F.array_join(F.transform("words", capital), ""), F.lit(1), F.col("size") - 1)
    # Times and padded numbers, the ordinary strings of digits.
    number = lambda w: F.concat(F.lit("20"), F.lpad(F.pmod(F.xxhash64(w), F.lit(30)).cast("string"), 2, "0"), F.lpad((F.pmod(F.xxhash64(w), F.lit(12)) + 1).cast("string"), 2, "0"), F.lpad(F.pmod(F.xxhash64(w), F.lit(100_000)).cast("string"), 8, "0"))
    styles = [F.concat(camel, digit), F.concat(digit, camel), F.array_join("words", ""), F.array_join("words", "_"), F.array_join("words", "-"), F.array_join("words", "/"), F.array_join(F.transform("words", number), "")]
    style = dealt(3, F.lit(len(styles)))
    name = F.when(style == 0, styles[0])
    for i, x in enumerate(styles[1:], 1):
        name = name.when(style == i, x)
    return rows.select("class", F.substring(name, F.lit(1), F.col("size")).alias("value")).where(F.length("value") >= low)


def _dealt_class(seed: str) -> Column:
    """A class with probability one half, the next with half of that, and so on, by the lowest bits of a hash."""
    h = F.xxhash64(F.col(seed), F.lit("class"))
    return F.least(F.lit(CLASSES - 1), F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")


def ordinary_cells(names: DataFrame) -> DataFrame:
    """encoding, class, cell and p: the share of ordinary names of the class with a score of that cell or a lower one. At most 3 * CLASSES * (CELLS + 1) rows."""
    counts = battery(names).groupBy("encoding", "class", score_cell(F.col("score")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    of = ["encoding", "class"]
    grid = counts.select(*of).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(CELLS))).alias("cell"))
    upto = Window.partitionBy(*of).orderBy("cell")
    full = grid.join(counts, [*of, "cell"], "left").fillna(0, ["n"])
    return full.select(*of, "cell", ((F.sum("n").over(upto) + 1) / (F.sum("n").over(Window.partitionBy(*of)) + 1)).alias("p"))


def random_tokens(tested: DataFrame, ordinary: DataFrame, level: float = LEVEL) -> DataFrame:
    """The rows of ``tested`` (from battery()) that are secrets at false-discovery rate ``level`` in their length class.

    A token of an encoding and class without ordinary names is no secret.
    """
    df = tested.withColumn("class", length_class(F.length("value"))).withColumn("cell", score_cell(F.col("score")))
    counts = df.groupBy("encoding", "class", "cell").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(ordinary), ["encoding", "class", "cell"])  # a table of fixed size
    # Step-up over a table of fixed size: the greatest p with p <= (tokens up to it) / (all tokens) * level.
    every, upto = Window.partitionBy("class"), Window.partitionBy("class").orderBy("p")
    steps = counts.withColumn("total", F.sum("m").over(every)).withColumn("so_far", F.sum("m").over(upto))
    cuts = steps.where(F.col("p") <= F.col("so_far") / F.col("total") * level).groupBy("class").agg(F.max("p").alias("cut"))
    found = counts.join(cuts, "class").where("p <= cut").select("encoding", "class", "cell")
    found = written(found, "secret-cells")
    return df.join(F.broadcast(found), ["encoding", "class", "cell"], "left_semi").drop("class", "cell")


def secret_spans(docs: DataFrame, level: float = LEVEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base (array of start, kind, end), spans (base and random, in order), n_random.

    A null text counts as empty. Rows alike in id and text get the same spans; rows with a null id are
    handled by their text. Other columns are ignored; empty input gives an empty result. Base spans always
    stay; a random token that overlaps a base span is not added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = base_spans(F.col("text"))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    found = narrow.select("doc_id", "text_hash", *[c.alias(k) for k, c in kinds.items()], matches(F.col("text"), CANDIDATE).alias("tokens"))
    found = found.withColumn("base", F.array_sort(F.concat(*kinds)))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    found = written(found.select("doc_id", "text_hash", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], "base", free.alias("tokens")), "secret-found")
    single = found.select("doc_id", "text_hash", F.explode("tokens").alias("token")).distinct()
    tested = written(battery(single.select("doc_id", "text_hash", "token.start", "token.end", "token.value")), "secret-tested")
    span = F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")
    ordinary = written(ordinary_cells(written(ordinary_names(narrow), "secret-names")), "secret-ordinary")
    random = random_tokens(tested, ordinary, level).groupBy("doc_id", "text_hash").agg(F.collect_list(span).alias("random"))
    random = written(random, "secret-random").withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    joined = found.join(random, found.doc_id.eqNullSafe(F.col("id")) & (found.text_hash == F.col("hash")), "left")
    added = F.coalesce("random", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", added)).alias("spans"), F.size(added).cast("long").alias("n_random"))


def _written_out(spans: Column) -> Column:
    """kind:start:end, comma-joined. Spans sort by start, then kind as listed."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written_out(F.col("spans")).alias("spans"), "n_random")
