"""Spans that come as rows."""

import random

from veilscan.operators import intervals
from veilscan.operators.intervals import interval_join, resolve_span_rows

from .plain import RANKS, greedy


def rows_of(seed, n, reach, longest):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randint(-1, reach)
        out.append((r.choice(["x", "y", None]), a, a + r.randint(-1, longest), r.choice("pq"), r.choice(list(RANKS)), f"s{i:05d}"))
    return out


def test_rows_equal_brute_force(spark):
    for seed, (n, reach, longest) in enumerate([(200, 60, 12), (150, 3000, 900), (60, 5, 5)]):
        rows = rows_of(seed, n, reach, longest)
        df = spark.createDataFrame(rows, "key string, start int, end int, rule_id string, risk_level string, span_id string")
        got = {}
        for k in resolve_span_rows(df, ["key"]).collect():
            got.setdefault(k["key"], []).append((k["start"], k["end"], k["rule_id"], k["risk_level"]))
        for key in ("x", "y", None):
            want = greedy([(a, b, rule, risk) for k, a, b, rule, risk, _ in rows if k == key and a >= 0 and b > a])
            assert sorted(got.get(key, [])) == want


def test_interval_join_reports_each_pair_once(spark):
    rows = [r for r in rows_of(9, 80, 300, 90) if r[1] >= 0 and r[2] > r[1]]
    df = spark.createDataFrame(rows, "key string, start int, end int, rule_id string, risk_level string, span_id string").select("key", "start", "end", "span_id")
    pairs = interval_join(df, df, ["key"], width=16)
    got = sorted((p["span_id"], p["other_span_id"]) for p in pairs.collect())
    assert got == sorted((a[5], b[5]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    assert "CartesianProduct" not in (plan := df.sparkSession._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "simple")) and "NestedLoop" not in plan


def test_one_crowded_text_and_no_rows(spark):
    df = spark.range(20_000).selectExpr("'k' AS key", "CAST(id % 50 AS int) AS start", "CAST(id % 50 + 60 + id % 7 AS int) AS end", "'p' AS rule_id", "'low' AS risk_level", "CAST(id AS string) AS span_id")
    assert resolve_span_rows(df, ["key"]).count() == 1
    assert resolve_span_rows(df.limit(0), ["key"]).count() == 0


def test_texts_of_few_spans_need_no_rounds(spark, monkeypatch):
    ddl = "key string, start int, end int, rule_id string, risk_level string, span_id string"
    df = spark.createDataFrame(rows_of(3, 90, 40, 12), ddl)
    written, write = [], intervals.stored
    monkeypatch.setattr(intervals, "stored", lambda df, name: written.append(name) or write(df, name))
    few = sorted(map(tuple, resolve_span_rows(df, ["key"]).collect()), key=str)
    assert "marked-spans" not in written
    for limit in (0, 25):  # none, or only some of the texts, are settled in one step
        assert sorted(map(tuple, resolve_span_rows(df, ["key"], few=limit).collect()), key=str) == few
    assert "marked-spans" in written


def test_rows_of_one_span_id_stay_or_go_together(spark):
    rows = [("x", 0, 5, "p", "high", "a"), ("x", 3, 9, "p", "low", "b"), ("y", 1, 4, "q", "low", "c"), ("y", 2, 6, "q", "high", None)]
    ddl = "key string, start int, end int, rule_id string, risk_level string, span_id string"
    twice = [rows[0], rows[0], rows[1], rows[1], rows[2]]
    assert sorted(r["span_id"] for r in resolve_span_rows(spark.createDataFrame(twice, ddl), ["key"]).collect()) == ["a", "a", "c"]
    assert sorted(r["start"] for r in resolve_span_rows(spark.createDataFrame(rows, ddl), ["key"]).collect()) == [0, 2]
