import math

import pytest
from pyspark.sql import functions as F

from harrow.functions.keys import byte_at, key_bytes, prefix_key, trie_bucket
from harrow.operators.multiset import consolidate, weighted_groups, weighted_sums
from harrow.plans.strategies import STRATEGIES, aggregate, bucket_sizes, by_partition, group_count
from harrow.queries import pairs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_keys(spark):
    texts = ["", "1.2.3.4", "1.2.3.4 ", "10.20.30.40", "1234567é", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(F.hex(prefix_key(F.col("t"), 8))).collect()
    assert [r[0] for r in found] == ["20" * 8, "312E322E332E3420", "312E322E332E3420", "31302E32302E3330", "31323334353637C3", None]
    for k in (7, 13):
        with pytest.raises(ValueError):
            prefix_key(F.col("t"), k)
    row = spark.range(1).select(key_bytes(F.lit(b"a ")), byte_at(F.lit(b"ab"), 1), byte_at(F.lit(b"ab"), 5), trie_bucket(F.lit(b"ab"), 1000)).first()
    assert list(row) == [[97, 32], 98, 0, (97 * 256 + 98) % 1000]


def test_all_strategies_agree(spark, data):
    rows = pairs(spark, data)
    found = {s: {(bytes(r["key"]), round(r["total"], 6)) for r in aggregate(rows, s, buckets=8).collect()} for s in STRATEGIES}
    assert len(set(map(frozenset, found.values()))) == 1 and len(found["hash"]) == 685
    empty = rows.limit(0)
    assert all(aggregate(empty, s, buckets=4).count() == 0 for s in STRATEGIES)
    with pytest.raises(ValueError, match="hashes"):
        aggregate(rows, "no such")


def test_plans(spark, data):
    rows = pairs(spark, data)
    combined, raw = plan(aggregate(rows, "hashes", True)), plan(aggregate(rows, "hashes", False, buckets=8))
    assert combined.index("partial_sum") > combined.index("Exchange") and "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in combined
    assert raw.index("partial_sum") < raw.index("Exchange hashpartitioning(key")
    assert plan(group_count(aggregate(rows, partial=True))).count("partial_sum") >= 2  # the sums are not optimised away
    sorted_ = plan(aggregate(rows, "sort", buckets=8))
    assert "Sort [key" in sorted_ and "SortAggregate" in sorted_ and "HashAggregate" not in sorted_
    assert plan(aggregate(rows, "tries", buckets=8)).count("Exchange") == 1


VALUES = {
    b"small": [0.004] * 1000,
    b"thirds": [1 / 3] * 7,
    b"large": [1e17, 1e17, 0.5],
    b"nan": [float("nan"), 1.0],
    b"inf": [float("inf"), 1.0, None],
    b"both": [float("inf"), float("-inf")],
}


@pytest.mark.parametrize("kind", ["double", "float"])
@pytest.mark.parametrize("strategy", STRATEGIES)
def test_sums_beyond_cents(spark, strategy, kind):
    rows = spark.createDataFrame([(k, v) for k, vs in VALUES.items() for v in vs], "key binary, value double").withColumn("value", F.col("value").cast(kind))
    found = {bytes(r["key"]): r["total"] for r in aggregate(rows, strategy, buckets=3).collect()}
    exact = 1e-9 if kind == "double" else 1e-6
    assert found[b"small"] == pytest.approx(4.0, rel=exact) and found[b"thirds"] == pytest.approx(7 / 3, rel=exact) and found[b"large"] == pytest.approx(2e17, rel=exact)
    assert math.isnan(found[b"nan"]) and found[b"inf"] == math.inf and math.isnan(found[b"both"])


def test_buckets_of_a_result(spark):
    sums = spark.createDataFrame([(b"ab", 1.0), (b"ab ", 2.0), (b"b", 3.0)], "key binary, total double")
    assert tuple(bucket_sizes(sums, 1000, trie_bucket).first()) == (2, 1, 2, 1.5)
    placed = {bytes(r["key"]): r["partition"] for r in by_partition(sums, 8, trie_bucket).collect()}
    assert placed == {b"ab": 98 % 8, b"ab ": 98 % 8, b"b": 0}
    assert bucket_sizes(sums.limit(0)).first()["buckets"] == 0


def test_weights(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 2.0, -1), ("b", 1.0, 1), ("b", 1.0, -1)], "key string, value double, weight long")
    assert [tuple(r) for r in weighted_sums(rows).collect()] == [("a", 1.0, 1)]
    assert [tuple(r) for r in consolidate(rows).collect()] == [("a", 1.0, 1)]
    assert tuple(weighted_groups(rows).first()) == (1, 1.0)


def test_nulls(spark):
    rows = spark.createDataFrame([(None, 1.0), (b"a", None), (b"a", 2.0)], "key binary, value double")
    for s in STRATEGIES:
        assert {(r["key"] and bytes(r["key"]), r["total"]) for r in aggregate(rows, s, buckets=2).collect()} == {(b"a", 2.0), (None, 1.0)}
