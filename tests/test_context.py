"""Context hints, candidates, entity spans, prototypes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan import with_findings
from veilscan.operators import candidates as C
from veilscan.operators import context as X
from veilscan.operators import models as M


def texts(spark, values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "key string, text string")


def hinted(spark, value):
    found = with_findings(texts(spark, [value]), "text")
    return X.with_hint(X.with_signals(found, "text", "findings"), "text", "signals", "findings")


def test_hint(spark):
    some = hinted(spark, "B社向けの提案メモです。NDA締結前なので関係者限りです。候補者の鈴木一郎さんの評価メモも含みます。").first().hint
    assert some.offer and {"near_confidential_hint", "near_person_like"} <= set(some.reasons)
    none = hinted(spark, "明日は雨になりそうなので傘を持ちます。").first().hint
    assert (none.offer, none.score, none.reasons) == (False, 0, [])


def test_windows_stay_in_budget_and_fall_back(spark):
    filler = "これは前置きの説明です。" * 40
    found = hinted(spark, filler + "\nA社向け。NDA締結前なので関係者限り。\n" + filler)
    windows = X.with_windows(found, "text", max_input_chars=220, window_chars=120).first().windows
    assert any("NDA締結前" in w.text for w in windows) and sum(len(w.text) for w in windows) <= 220
    plain = X.with_windows(hinted(spark, "一般の説明文です。" * 100), "text", max_input_chars=500, window_chars=160).first().windows
    assert len(plain) == 1 and len(plain[0].text) <= 160


def test_residual_terms(spark):
    value = (
        "担当: 佐藤一郎\nProject Blue Bridge と Phoenix案件。A社向け、株式会社サンプル向け、サンプル株式会社との契約更新。"
        "\n田中太郎です。山田花子さんの年収条件。"
    )
    terms = texts(spark, [value]).select(C.residual_terms(F.col("text")).alias("t")).first().t
    assert {
        "佐藤一郎", "Project Blue Bridge", "Phoenix案件", "A社", "株式会社サンプル", "サンプル株式会社", "契約更新", "田中太郎",
        "山田花子さん", "年収条件",
    } <= {t.surface for t in terms}
    assert [len(t.surface) for t in terms] == sorted((len(t.surface) for t in terms), reverse=True)


def analysis(spark, value, entity, semantic):
    df = texts(spark, [value]).withColumn("e", F.lit(entity)).withColumn("s", F.lit(semantic))
    return C.with_context_analysis(df, "text", "e", "s")


def test_partial_failures(spark):
    a = analysis(spark, "担当: 佐藤一郎", None, None).first().analysis
    assert a.error and a.warnings == [] and a.candidates[0].surface == "佐藤一郎"
    df = texts(spark, ["x"]).withColumn("e", F.array().cast(C.CANDIDATE_TYPE)).withColumn("s", F.lit(None))
    b = C.with_context_analysis(df, "text", "e", "s").first().analysis
    assert b.error is None and len(b.warnings) == 1


def test_candidate_findings_trust_a_span_that_fits(spark):
    value = "山田花子と山田花子"
    row = ("m", "person_name", "山田花子", "l", "r", "medium", "[PERSON_1]", 0.9)
    schema = "struct<id:string,category:string,surface:string,label:string,reason:string,risk_level:string,suggested_placeholder:string,confidence:double,start:int,end:int>"
    df = spark.createDataFrame(
        [(value, [row + (5, 9)]), (value, [row + (None, None)]), (value, [row[:7] + (0.5, None, None)]),
         ("提案と契約", [("m", "company_name", "提案", "l", "r", "medium", "x", 0.9, None, None)])],
        f"text string, c array<{schema}>",
    )
    got = [[f.start for f in r.candidate_findings] for r in C.with_candidate_findings(df, "text", "c").collect()]
    assert got == [[5], [0, 5], [], []]


def test_entity_spans(spark):
    rows = [
        ("a", 1, "PER", 0.94, 3, 5), ("a", 2, "I-PER", 0.92, 6, 8), ("a", 3, "O", 0.99, 8, 10), ("a", 4, "PER", 0.5, 0, 2),
        ("a", 5, "LOC", 0.9, 0, 99), ("b", 1, "ORG-P", 0.9, 0, 2), ("b", 2, "ORG-O", 0.9, 3, 6),
    ]
    tokens = spark.createDataFrame(rows, "key string, index int, entity string, score double, start int, end int")
    docs = spark.createDataFrame([("a", "担当は山田 花子さんです。"), ("b", "政党 研究所")], "key string, text string")
    got = {(r.key, r.surface, r.start, r.end, r.suggested_placeholder) for r in M.entity_candidates(tokens, docs, "key").collect()}
    assert got == {
        ("a", "山田 花子", 3, 8, "[PERSON_1]"), ("b", "政党", 0, 2, "[COMPANY_1]"), ("b", "研究所", 3, 6, "[COMPANY_2]"),
    }


def test_nearest_prototype_needs_similarity_and_margin(spark):
    protos = M.prototype_texts(spark).select(
        "position", "category",
        F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i == F.col("position"), 1.0).otherwise(0.0)).alias("embedding"),
    )
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.1, 0.0, 0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (3, [0.0] * 6), (4, [1.0])],
        "id int, embedding array<double>",
    )
    got = {r.id: (r.category, r.accepted) for r in M.nearest_prototype(vectors, protos).collect()}
    assert got[1] == ("contract_info", True) and not any(got[i][1] for i in (2, 3, 4))


def test_segments(spark):
    value = "最初の文です。短い。\n終わりの印がない行\n最初の文です。最後の行です"
    got = texts(spark, [value]).select(M.segments(F.col("text"), 1200, 8, 240, 6).alias("s")).first().s
    assert got == ["最初の文です。", "最後の行です"]
    whole = "".join(f"これは{i}番目の文です。" for i in range(300))
    assert len(whole) > 1200 and texts(spark, [whole]).select(F.size(M.segments(F.col("text")))).first()[0] == 300


def test_no_candidate_is_dropped(spark):
    tokens = [("a", i, "PER", 0.9, 10 * i, 10 * i + 3) for i in range(200)]
    df = spark.createDataFrame(tokens, "key string, index int, entity string, score double, start int, end int")
    docs = spark.createDataFrame([("a", "abcdefghi " * 200)], "key string, text string")
    found = M.entity_candidates(df, docs, "key")
    assert found.count() == 200 and M.entity_candidates(df, docs, "key", limit=12, max_input_chars=1200).count() == 12
    packed = M.gather_candidates(found, ["key"])
    assert packed.select(F.size(C.distinct_candidates(F.concat("candidates", "candidates")))).first()[0] == 200


def test_prototypes_of_any_category_and_number(spark):
    protos = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "x", [0.9, 0.1]), (2, "y", [0.0, 1.0])], "position int, category string, embedding array<double>")
    row = M.nearest_prototype(spark.createDataFrame([([1.0, 0.05],)], "embedding array<double>"), protos).first()
    assert row.category == "x" and row.accepted and row.margin > 0.5


def _nearest(vector, prototypes):
    """Every prototype compared, sorted."""
    unit = lambda v: v / n if (n := np.sqrt((v * v).sum())) > 0 else v * 0
    ranked = sorted((-float(unit(vector) @ unit(v)) if len(v) == len(vector) else 1.0, p, c) for p, c, v in prototypes)
    other = [r for r in ranked if r[2] != ranked[0][2]]
    return ranked[0][2], -ranked[0][0], -ranked[0][0] - (-other[0][0] if other else -1.0)


def test_prototypes_in_blocks_equal_a_full_comparison(spark):
    r = np.random.default_rng(3)
    for n, block in ((1, 2), (7, 3), (60, 7), (50_000, 8_000)):
        prototypes = [(i, f"c{r.integers(0, 5)}", np.round(r.standard_normal(4 if i % 9 else 3), 1)) for i in range(n)]
        vectors = [np.round(r.standard_normal(4), 1) for _ in range(3)] + [np.zeros(4)]
        protos = spark.createDataFrame([(p, c, v.tolist()) for p, c, v in prototypes], "position int, category string, embedding array<double>")
        rows = M.nearest_prototype(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, embedding array<double>"), protos, block=block).collect()
        for row in rows:
            category, similarity, margin = _nearest(vectors[row.id], prototypes)
            assert row.category == category and abs(row.similarity - similarity) < 1e-12 and abs(row.margin - margin) < 1e-12


def test_vectors_and_prototypes_that_are_missing(spark):
    protos = spark.createDataFrame([(0, "a", [1.0]), (1, None, [-1.0])], "position int, category string, embedding array<double>")
    vectors = spark.createDataFrame([(0, None), (1, []), (2, [2.0])], "id int, embedding array<double>")
    got = {x.id: (x.category, x.similarity, x.accepted) for x in M.nearest_prototype(vectors, protos).collect()}
    assert got == {0: (None, -1.0, False), 1: (None, -1.0, False), 2: ("a", 1.0, True)}
    assert {x.category for x in M.nearest_prototype(vectors, protos.limit(0)).collect()} == {None}


def test_white_space_at_the_ends_does_not_make_a_text_long_enough(spark):
    body = "社外秘" + "x" * 36
    texts = [body, body + "y", body + " ", "\u3000" + body, "\n " + body + "\ufeff\t", " " + body + "y ", "", " ", None]
    df = X.with_hint(X.with_signals(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text"), "text")
    got = {r["id"]: r["hint"]["offer"] for r in df.collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: False, 8: False}
