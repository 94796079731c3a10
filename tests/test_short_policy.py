"""Membership of few keys needs no sort and no fold; a risk level does not compute its score again."""

from pyspark.sql import functions as F

from veilscan.functions import scoring
from veilscan.functions.fixed import CATEGORY_WEIGHT, SCORE_CAP
from veilscan.functions.lists import _FEW, is_in


def test_membership_on_both_sides_of_few(spark):
    rows = []
    for n in (0, 1, 3, _FEW, _FEW + 1, 3 * _FEW):
        for m in (0, 1, _FEW, _FEW + 1):
            keys, wanted = [f"k{i * 7 % 50}" for i in range(n)], [f"k{i * 3 % 40}" for i in range(m)]
            rows += [(keys, wanted), ([*keys, None], wanted), (keys, [*wanted, None])]
    df = spark.createDataFrame(rows + [(None, ["a"]), (["a"], None)], "k array<string>, w array<string>")
    got = df.select("k", "w", is_in(F.col("k"), F.col("w")).alias("hit")).collect()
    for r in got[:-2]:
        assert r["hit"] == [k is not None and k in r["w"] for k in r["k"]], r
    assert [r["hit"] for r in got[-2:]] == [None, None]


def test_score_is_computed_once(spark):
    category = lambda: F.array(F.lit("a"))
    assert str(scoring.risk_score(F.col("f"), category())).count("aggregate") == 1
    names = list(CATEGORY_WEIGHT)[:6]
    rows = [([], []), ([("x", "l")], ["other"]), *[([(c, "l")] * k, [c] * k) for c in names for k in (1, 2, 9)]]
    df = spark.createDataFrame(rows, "f array<struct<rule_id:string,label:string>>, c array<string>")
    df = df.withColumn("f", F.transform("f", lambda f: f.withField("category", F.lit(None).cast("string"))))
    for r in df.select("c", scoring.risk_score(F.col("f"), F.col("c")).alias("r")).collect():
        score = min(SCORE_CAP, sum(CATEGORY_WEIGHT[c] for c in r["c"]))
        level = next(name for top, name in [(0, "safe"), (19, "low"), (49, "medium"), (79, "high"), (SCORE_CAP, "critical")] if score <= top)
        assert (r["r"]["score"], r["r"]["level"], r["r"]["secret_guard"], r["r"]["blocked"]) == (score, level, False, level in ("high", "critical"))
        assert r["r"]["category_counts"] == {c: r["c"].count(c) for c in r["c"]}
