"""As-of join against a plain search."""

import random

from veilscan.operators.asof import as_of


def test_equals_brute_force_before_between_after_and_ties(spark):
    r = random.Random(4)
    keys = ["a", "b", None]
    cache = [(r.choice(keys), r.choice([None, *range(0, 5000, 50)]), f"v{i:03d}") for i in range(120)]
    asked = [(r.choice([*keys, "none"]), r.choice([None, *range(-100, 6000, 25)]), i) for i in range(200)]
    left, right = spark.createDataFrame(asked, "k string, at long, n int"), spark.createDataFrame(cache, "k string, t long, v string")
    for width in (1, 700, 10**6):
        got = {x["n"]: x["found"] and x["found"]["v"] for x in as_of(left, right, ["k"], "at", "t", "v", width=width).collect()}
        for k, at, n in asked:
            fits = [(t, v) for key, t, v in cache if key == k and t is not None and at is not None and t <= at]
            assert got[n] == (max(fits)[1] if fits else None)


def test_repeated_rows_and_empty_tables(spark):
    left, right = spark.createDataFrame([("a", 5)] * 3, "k string, at long"), spark.createDataFrame([("a", 5, "x"), ("a", 5, "y")], "k string, t long, v string")
    assert [x["found"]["v"] for x in as_of(left, right, ["k"], "at", "t", "v").collect()] == ["y"] * 3
    assert [x["found"] for x in as_of(left, right.limit(0), ["k"], "at", "t", "v").collect()] == [None] * 3
    assert as_of(left.limit(0), right, ["k"], "at", "t", "v").count() == 0


def test_a_hot_key_is_spread_over_its_buckets(spark):
    left = spark.range(1000).selectExpr("'hot' AS k", "id * 10 AS at")
    right = spark.range(1000).selectExpr("'hot' AS k", "id * 10 + 1 AS t", "id AS v")
    out = as_of(left, right, ["k"], "at", "t", "v", width=100)
    assert "hashpartitioning(k" in (plan := out._jdf.queryExecution().toString()) and "_bucket" in plan
    assert out.where("found.v = at / 10 - 1").count() == 999
