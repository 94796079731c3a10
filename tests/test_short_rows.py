"""Short arrays go the short way, and give what the long way gives; a placeholder's regex runs once per finding."""

import re

from pyspark.sql import functions as F

from veilscan.functions.lists import BLOCK, folded
from veilscan.functions.spans import FINDINGS_TYPE, find_spans, number_placeholders, resolve_overlaps


def test_placeholder_regex_stands_once_and_folds_have_a_short_way(spark):
    assert str(number_placeholders(F.col("f"))).count("regexp_extract") == 1
    fold = folded(F.col("v"), F.lit(0), lambda s, x: s + x, lambda s, x: F.array(s), "array<int>")
    assert str(fold).split("THEN")[0].count("aggregate") == 0 and "CASE WHEN" in str(fold)


def test_spans_on_both_sides_of_a_block(spark):
    texts = ["é " + "ab あ" * n + "x" for n in (0, 1, 2, BLOCK - 2, BLOCK - 1, BLOCK, BLOCK + 1, BLOCK**2 + 1)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", find_spans(F.col("t"), "ab").alias("s")).collect():
        assert [(s["start"], s["end"], s["text"]) for s in r["s"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("ab", r["t"])]


def test_empty_hits_and_null_texts(spark):
    rows = spark.createDataFrame([("xay",), ("",), (None,)], "t string").select(find_spans(F.col("t"), "a*").alias("s")).collect()
    assert [r["s"] and [(s["start"], s["end"]) for s in r["s"]] for r in rows] == [[(1, 2)], [], None]


def spans_of(n):
    return [((i * 37) % (3 * n), (i * 37) % (3 * n) + 1 + i % 7, f"r{i % 5}", ("low", "high", "medium")[i % 3]) for i in range(n)]


def settled(spans):
    taken = []
    for start, end, rule, _ in sorted(spans, key=lambda s: (-{"low": 1, "medium": 2, "high": 3}[s[3]], s[0] - s[1], s[0], s[2])):
        if all(end <= a or b <= start for a, b, _ in taken):
            taken.append((start, end, rule))
    out, numbers = [], {}
    for start, end, rule in sorted(taken):
        numbers[rule] = numbers.get(rule, 0) + 1
        out.append((start, end, f"[{rule.upper()}_{numbers[rule]}]", f"rule:{rule}:{start}:{end}"))
    return out


def test_overlaps_on_both_sides_of_a_block(spark):
    fields = "start:int,end:int,rule_id:string,risk_level:string"
    df = spark.createDataFrame([(n, spans_of(n)) for n in (0, 1, 2, 3, 255, 256, 257, 600)], f"n int, s array<struct<{fields}>>")
    finding = lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["rule_id"].alias("rule_id"), F.lit("rule").alias("source"), F.lit("l").alias("label"),
        s["risk_level"].alias("risk_level"), F.lit(None).cast("string").alias("category"), F.lit("").alias("text"),
        F.concat(F.lit("["), F.upper(s["rule_id"]), F.lit("_1]")).alias("placeholder"), F.lit("").alias("message"), F.lit(1.0).alias("confidence"), F.lit("").alias("id"),
    )
    kept = df.withColumn("k", resolve_overlaps(F.transform("s", finding).cast(FINDINGS_TYPE)))
    for r in kept.select("n", number_placeholders(F.col("k")).alias("k")).collect():
        assert [(f["start"], f["end"], f["placeholder"], f["id"]) for f in r["k"]] == settled(spans_of(r["n"]))
