import random

import pytest
from pyspark.sql import functions as F

from logweave.functions import requests as Q
from logweave.functions import scalars as S
from tests import simulations as sim


def one(spark, column, *values, schema="s string"):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], schema).select(column.alias("x")).collect()]


def test_hash_goldens(spark):
    assert one(spark, S.cyrb64_hash(F.col("s")), "", "abc", "*:*") == ["1tbwg8k0g56dvy", "0ergvjp0rgnqhv", "06nhifj0bernno"]


def test_hash_over_utf16_units(spark):
    texts = ["", "a", "é", "中文", "x😀y", "".join(random.Random(1).choices("ab😀é", k=60))]
    for seed in (0, 777777):
        got = one(spark, S.cyrb64(F.col("s"), seed), *texts)
        assert [(r.h2, r.h1) for r in got] == [sim.cyrb(t, seed) for t in texts]


def test_padding():
    assert S.padding(32, 36) == 7 and S.padding(1, 2) == 1
    for bad in ((0, 36), (53, 36), (32, 1), (32, 37)):
        with pytest.raises(ValueError):
            S.padding(*bad)


@pytest.mark.parametrize(
    "address, topics, low, high, key",
    [
        (None, None, 0, 9999, "1:ethGetLogs:06nhifj0bernno+0:9999"),
        (["0x1234567890123456789012345678901234567890"], [["0xabc"]], 0, 9999, "1:ethGetLogs:1gwy25d12dtgf6+0:9999"),
        (["0x1234567890123456789012345678901234567890"], [["0xabc"], None, ["0xdef", "0x123"]], 10000, 19999, "1:ethGetLogs:0zizyb31yraxqp+10000:19999"),
    ],
)
def test_cache_key_goldens(spark, address, topics, low, high, key):
    df = spark.createDataFrame([(address, topics)], "a array<string>, t array<array<string>>")
    assert df.select(S.cache_key(F.lit(1), S.filter_text(F.col("a"), F.col("t")), F.lit(low), F.lit(high)).alias("k")).first().k == key


def test_split_key(spark):
    assert one(spark, S.split_key(F.col("s")), "a+b")[0] == ("a", "b")
    with pytest.raises(Exception, match="no separator"):
        one(spark, S.split_key(F.col("s")), "ab")


@pytest.mark.parametrize("text, most, expected", [("hello world", 5, ["hello", " worl", "d"]), ("", 4, [""]), ("a😀b", 4, ["a", "😀", "b"]), ("a中b", 3, ["a", "中", "b"])])
def test_shards(spark, text, most, expected):
    assert one(spark, S.shard_text(F.col("s"), most), text)[0] == expected


def test_shard_too_small(spark):
    with pytest.raises(Exception, match="wider"):
        one(spark, S.shard_text(F.col("s"), 2), "中")


@pytest.mark.parametrize("data, size", [("0x", 333), ("0x" + "0" * 1000, 1333)])
def test_log_size_goldens(spark, data, size):
    log = ("0x1234567890123456789012345678901234567890", ["0xabc"], data, 1, "0x" + "a" * 64, 0, "0x" + "b" * 64, 0, False)
    from logweave.model import LOG_SCHEMA

    assert spark.createDataFrame([log], LOG_SCHEMA).select(S.estimate_bytes(S.node_log(), S.NODE_LOG_TYPE).alias("x")).first().x == size


@pytest.mark.parametrize("conf, age, chunks, p", [(0, 4999, 1, 0), (127, 5000, 1, 1), (128, 5000, 1, 0.0010000128953849647), (1000, S.DAY_MS, 10, 0.00013459603241553647), (1000, 40 * S.DAY_MS, 10, 1)])
def test_simple_invalidation(spark, conf, age, chunks, p):
    assert spark.range(1).select(S.simple_invalidation(F.lit(conf), F.lit(age), F.lit(chunks)).alias("x")).first().x == pytest.approx(p, rel=1e-12)


@pytest.mark.parametrize("conf, days, p", [(0, 0, 0.875), (64, 0, 0.32189451102501204), (1000, 1, 0.0028221195009669755), (1000, 15.5, 0.12592290810563125), (1000, 31, 1)])
def test_exponential_invalidation(spark, conf, days, p):
    assert spark.range(1).select(S.exponential_invalidation(F.lit(conf), F.lit(int(days * S.DAY_MS))).alias("x")).first().x == pytest.approx(p, rel=1e-9)


def test_range_errors(spark):
    rows = [(-32602, "x"), (-32005, ""), (1, "block range is too large"), (1, "query returned more than 5"), (1, "nonce too low"), (None, "max 5 blocks"), (3, None)]
    got = spark.createDataFrame(rows, "c int, m string").select(S.is_range_error(F.col("c"), F.col("m")).alias("x")).collect()
    assert [r.x for r in got] == [True, True, True, True, False, True, False]


def test_write_id(spark):
    got = one(spark, S.write_id(F.col("s")), "0123456789abcdef|abc", "legacy")
    assert [tuple(r) for r in got] == [("0123456789abcdef", "abc"), ("0" * 16, "legacy")]


def test_requests():
    assert Q.canonical_filter({"topics": [["0xA"], [], None], "address": ["0xB"]}) == {"address": "0xb", "topics": ["0xa", None, None]}
    assert Q.canonical_filter({"topics": [None, []], "address": []}) == {}
    assert Q.drop_absent({"a": Q.ABSENT, "b": {"c": Q.ABSENT}, "d": None, "e": 0, "f": [Q.ABSENT]}) == {"d": None, "e": 0, "f": [Q.ABSENT]}
    assert Q.loads(Q.dumps({"n": 1 << 70, "m": 3})) == {"n": 1 << 70, "m": 3}
    assert Q.loads("{") is Q.ABSENT
    with pytest.raises(ValueError):
        Q.loads("{", strict=True)


def test_strip_options():
    from logweave.functions.requests import is_plain_object, strip_options

    assert strip_options([1, {"__rateLimiter": True, "priority": 2}]) == ([1], {"__rateLimiter": True, "priority": 2})
    assert strip_options([{"__rateLimiter": True}]) == ([], {"__rateLimiter": True})
    for params in ([], [1], [{"__rateLimiter": False}], [{"__rateLimiter": True, "x": 1}], [{"__rateLimiter": True, "priority": "a"}], [{"priority": 1}]):
        assert strip_options(params) == (params, None)
    assert is_plain_object({}) and not is_plain_object([]) and not is_plain_object(None)
