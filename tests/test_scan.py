"""Golden examples of the scan, and a brute-force check of spans and rewriting."""

import re
import time

import pytest
from pyspark.sql import functions as F

from veilscan import scan, select_rules, with_findings, with_policy
from veilscan.functions.fixed import RULE_IDS
from veilscan.functions.rules import TextRule
from veilscan.functions.spans import cut, text_chunks
from veilscan.operators.scan import resolve_column, transform_text

FIRST_RULE = {
    "連絡先は hanako@example.com まで": "email",
    "電話は 090-1111-2222": "phone",
    "abcdefghij.klmnopqrst.uvwxyz0123": "jwt",
    "key AKIA" + "ABCDEFGHIJKLMNOP": "aws_access_key",
    "gh" + "p_" + "a" * 24: "github_token",
    "xo" + "xb-" + "b" * 12: "slack_token",
    "sk" + "_test_" + "c" * 18: "stripe_secret_key",
    "sk" + "-" + "d" * 22: "openai_api_key",
    "np" + "m_" + "e" * 18: "npm_token",
    "client_secret='abcdefgh12345'": "oauth_client_secret",
    "通知 https://hooks.slack.com/services/T1/B2/xyz": "webhook_url",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----": "private_key",
    "MY_API_KEY=abc123": "env_secret",
    "https://u:p@example.com/x": "basic_auth_url",
    "mysql://u:p@db.example.com/x": "database_url",
    "4111 1111 1111 1111": "credit_card",
    "マイナンバー 1234 5678 9012": "my_number",
    "http://example.com": "url",
    "10.0.0.1": "ip_address",
    "￥1,200": "amount",
    "これは取扱注意です": "confidential_text",
    "db.corp.example": "internal_url",
    "2024-05-06": "date",
    "郵便番号123-4567です": "postal_code",
    "abcdefgh12345678": "long_id",
}


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def test_every_rule_has_an_example(spark):
    assert sorted(FIRST_RULE.values()) == sorted(RULE_IDS)
    rows = with_findings(texts(spark, FIRST_RULE), "text").select("text", "findings").collect()
    assert {r.text: r.findings[0].rule_id for r in rows} == FIRST_RULE


def test_near_misses_give_nothing(spark):
    values = ["注文番号 1234-5678-9012", "4111 1111 1111 1112", "0000 0000 0000 0000", "AKIA-SAMPLE", "taro at example", ""]
    assert all(r.findings == [] for r in with_findings(texts(spark, values), "text").collect())


def test_numbering_overlap_and_masking(spark):
    values = ["a@example.com と b@example.com", "SECRET_TOKEN=AKIA" + "0" * 16, "x a@example.com y 090-1234-5678"]
    rows = scan(texts(spark, values), "text", keep_placeholder_map=True).orderBy("id").collect()
    assert [r.rewritten for r in rows] == ["[EMAIL_1] と [EMAIL_2]", "[ENV_SECRET_1]", "x [EMAIL_1] y [PHONE_1]"]
    assert [m.original_text for m in rows[0].placeholder_map] == ["a@example.com", "b@example.com"]
    assert rows[2].summary.asDict()["by_rule"] == {"email": 1, "phone": 1} and rows[2].highest_risk == "high"


@pytest.mark.parametrize(
    ("mode", "expected"),
    [("mask", "[EMAIL_1] から [URL_1]"), ("generalize", "[メールアドレス] から [URL]"), ("redact", "[削除済み] から [削除済み]")],
)
def test_modes(spark, mode, expected):
    df = texts(spark, ["a@example.com から https://example.com/x"])
    assert scan(df, "text", mode=mode).first().rewritten == expected


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        scan(texts(spark, ["x"]), "text", mode="minimize")


def test_marks_and_astral_characters_in_the_text(spark):
    value = "﷐ 😀 a@example.com ﷑ b@example.com"
    row = scan(texts(spark, [value]), "text").first()
    assert row.rewritten == "﷐ 😀 [EMAIL_1] ﷑ [EMAIL_2]"
    assert [value[f.start : f.end] for f in row.findings] == ["a@example.com", "b@example.com"]


def test_long_text_is_cut_by_chunks(spark):
    value = "".join(chr(0x3042 + i % 80) for i in range(9001)) + " a@example.com " + "z" * 5000
    df = texts(spark, [value])
    assert scan(df, "text").first().rewritten == value.replace("a@example.com", "[EMAIL_1]")
    for start, end in ((0, 4096), (4095, 4097), (4096, 8192), (10, 9016), (5, 5)):
        got = df.select(text_chunks(F.col("text")).alias("c")).select(cut(F.col("c"), F.lit(start), F.lit(end))).first()[0]
        assert got == value[start:end]


def test_rule_selection_and_order_of_risk():
    ids = [r.id for r in select_rules(enabled_ids=["email", "date"], disabled_ids=["date"])]
    assert ids == ["email"]
    assert all(r.risk_level != "low" for r in select_rules(include_low=False))
    assert {r.risk_level for r in select_rules(min_risk="high")} == {"high"}


def test_empty_hits_of_a_delivered_rule_do_not_count(spark):
    rule = TextRule("remote:x", "x", "low", "X", "m", 0.9, pattern="(?=a)|b", id_source="remote")
    found = with_findings(texts(spark, ["abcb"]), "text", [rule]).first().findings
    assert [(f.start, f.id) for f in found] == [(1, "remote:x:1:2"), (3, "remote:x:3:4")]


def greedy(spans):
    rank = {"low": 1, "medium": 2, "high": 3, "critical": 4}
    kept = []
    for s in sorted((s for s in spans if s[0] >= 0 and s[1] > s[0]), key=lambda s: (-rank[s[3]], s[0] - s[1], s[0], s[2])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def test_overlaps_against_brute_force(spark):
    from veilscan.plans.derived import spans_of_orders

    settled = resolve_column(spans_of_orders(spark, "/root/testdata/sf0.001"), "hits")
    for row in settled.select("hits", "findings").limit(400).collect():
        spans = [(h.start, h.end, h.rule_id, h.risk_level) for h in row.hits]
        assert [(f.start, f.end, f.rule_id, f.risk_level) for f in row.findings] == greedy(spans)


def test_invariants_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for row in scan(docs, "text").collect():
        at, out = 0, []
        for f in row.findings:
            assert f.start >= at and row.text[f.start : f.end] == f.text
            out += [row.text[at : f.start], f.placeholder]
            at = f.end
        assert row.rewritten == "".join(out) + row.text[at:]
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", row.rewritten)


def test_policy(spark):
    values = ["今日は晴れ", "2024-05-06", "初期費用は300万円", "a@example.com 2024-05-06", "https://example.com"]
    rows = with_policy(with_findings(texts(spark, values), "text")).orderBy("id").collect()
    got = [(r.policy.action, r.policy.severity, r.policy.risk.score) for r in rows]
    assert got == [
        ("allow", "none", 0), ("allow", "low", 5), ("confirm", "medium", 20), ("sanitize_required", "high", 15),
        ("allow", "medium", 0),
    ]
    assert rows[3].policy.required_ids == ["rule:email:0:13"] and rows[3].policy.optional_ids == ["rule:date:14:24"]


def test_score_alone_can_require_sanitizing(spark):
    df = texts(spark, ["¥100 ¥200 ¥300"])
    policy = with_policy(with_findings(df, "text")).first().policy
    assert policy.action == "sanitize_required" and policy.severity == "high" and len(policy.required_ids) == 3


def test_rewrite_with_no_findings_is_identity(spark):
    df = texts(spark, ["plain"]).withColumn("none", F.array().cast(with_findings(texts(spark, ["x"]), "text").schema["findings"].dataType))
    assert transform_text(df, "text", "none", "generalize").first().rewritten == "plain"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_filters_on_the_input_pass_a_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (with_findings(docs, "text"), scan(docs, "text")):
        assert "EqualTo(source,src1), LessThan(doc_id,10)" in plan_of(df.where("source = 'src1' AND doc_id < 10"))


def test_a_filter_on_findings_does_not_copy_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = plan_of(with_findings(docs, "text").where(F.size("findings") > 0).select("doc_id", F.explode("findings")))
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("(?:AKIA|ASIA)") == 1


HOSTILE = {
    "email": "a." * 500_000, "jwt": "a-" * 500_000 + ".b", "internal_url": "dev " + "a-" * 500_000, "database_url": "mysql://a:" * 100_000 + " @",
    "private_key": "-----BEGIN " + "ABC " * 250_000, "env_secret": "SECRET" * 160_000 + " =",
}


@pytest.mark.parametrize("rule", HOSTILE)
def test_hostile_megabytes_are_scanned_in_seconds(spark, rule):
    df = spark.createDataFrame([(HOSTILE[rule],)], "text string").cache()
    df.count()
    begin = time.time()
    with_findings(df, "text", select_rules(enabled_ids=[rule])).select(F.size("findings")).collect()
    assert time.time() - begin < 20


def test_many_key_openings_without_end(spark):
    df = spark.createDataFrame([("-----BEGIN PRIVATE KEY-----" * 30_000,), ("x -----BEGIN RSA PRIVATE KEY-----\na\n-----END RSA PRIVATE KEY----- y",)], "text string")
    rows = with_findings(df, "text", select_rules(enabled_ids=["private_key"])).select(F.transform("findings", lambda f: f["start"])).collect()
    assert [r[0] for r in rows] == [[], [2]]
