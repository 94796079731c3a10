"""Results and growth on hostile input: patterns, folds, merges and memberships stay near-linear and equal to plain forms."""

import random
import re
import time
from functools import reduce

import pytest
from pyspark.sql import functions as F

from veilscan.functions import patterns as P
from veilscan.functions.lists import first_of_each, is_in
from veilscan.functions.rules import BUNDLED_RULES
from veilscan.functions.spans import find_literal, resolve_overlaps
from veilscan.operators import candidates as C
from veilscan.operators import logs as L
from veilscan.operators.scan import raw_findings

from .plain import RANKS, greedy

FINDING = "start int, end int, rule_id string, source string, label string, risk_level string, category string, text string, placeholder string, message string, confidence double, id string"


def one(spark, value):
    df = spark.createDataFrame([(value,)], "text string").cache()
    df.count()
    return df


def seconds(df):
    begin = time.time()
    rows = df.collect()
    return time.time() - begin, rows


def doubles(run, sizes, factor=3.2, floor=1.0):
    """Twice the input takes at most ``factor`` times as long; shorter times than ``floor`` seconds count as that."""
    run(sizes[0] // 10)  # compiled
    for _ in range(3):  # the machine may be busy
        small, large = (max(floor, run(n)) for n in sizes)
        if large <= factor * small:
            return
    raise AssertionError((small, large))


# --- patterns ----------------------------------------------------------------

#: Per rule, a text that passes its guard and leads its pattern on and on.
HOSTILE = {
    "email": ("a.", "@"), "phone": ("01-", ""), "jwt": ("a-", ".aaaaaaaaaa."), "aws_access_key": ("AKIA", ""), "github_token": ("ghp_ ", "gh"),
    "slack_token": ("xoxb-1 ", ""), "stripe_secret_key": ("sk_live_ ", ""), "openai_api_key": ("sk-a ", ""), "npm_token": ("npm_a ", ""),
    "oauth_client_secret": ("client_secret \t", "clientsecret"), "webhook_url": ("https://hooks.slack.com/", "/webhooks/"),
    "private_key": ("-----BEGIN A ", ""), "env_secret": ("SECRET_ ", " ="), "basic_auth_url": ("https://a:b", "@ "),
    "database_url": ("redis://a:", "@ "), "credit_card": ("1 ", ""), "my_number": ("1234-", "マイナンバー"), "url": ("http://", ""),
    "ip_address": ("1.2.", ""), "amount": ("1", "円x"), "confidential_text": ("ND", "\nNDA"), "internal_url": ("a-", " dev"),
    "date": ("2024-1-", ""), "postal_code": ("123-", "1-1"), "long_id": ("a", "-1"),
}
MORE = [("amount", "1,111", "円x"), ("amount", "11,", "円"), ("amount", "1.1", "¥"), ("amount", "月額 ", "円"), ("database_url", "redis://", "@ "), ("database_url", "mysql://ab", " x@ y")]


def test_every_rule_has_a_hostile_text():
    assert set(HOSTILE) == {r.id for r in BUNDLED_RULES}


def test_detectors_grow_in_proportion(spark):
    """Every rule on its own hostile texts, all in one job: one that grew with the square would take minutes."""
    cases = [*((k, *v) for k, v in HOSTILE.items()), *MORE]

    def run(n):
        rows = [(rule, unit * (n // len(unit)) + tail) for rule, unit, tail in cases]
        df = spark.createDataFrame(rows, "rule string, text string").repartition(16).cache()
        df.count()
        own = [raw_findings(df.where(F.col("rule") == r.id), "text", [r]).select(F.size("hits").alias("n")) for r in BUNDLED_RULES]
        return seconds(reduce(lambda x, y: x.unionAll(y), own).agg(F.sum("n")))[0]

    doubles(run, (60_000, 120_000), floor=3.0)


@pytest.mark.parametrize("unit,tail", [("prompt: a" + " " * 50, ""), (" ", "prompt: a"), ("a", ""), ("a.", "@"), ("0123-", "")])
def test_log_scrub_grows_in_proportion(spark, unit, tail):
    def run(n):
        head = "prompt: a" if unit == " " else ""
        return seconds(one(spark, head + unit * (n // len(unit)) + tail).select(L.scrub_detail(F.col("text"))))[0]

    doubles(run, (15_000, 30_000), floor=1.0)


@pytest.mark.parametrize("unit,tail", [("A-", " 計画"), ("A ", "案件"), ("a-B", "PJ"), ("担当" + " " * 40, "x"), ("A-b-", " 案件"), ("社", "です")])
def test_entity_terms_grow_in_proportion(spark, unit, tail):
    def run(n):
        return seconds(one(spark, unit * (n // len(unit)) + tail).select(F.size(C.residual_entity_terms(F.col("text")))))[0]

    doubles(run, (15_000, 30_000), floor=1.0)


PLAIN = {
    "amount": (P.AMOUNT, 0, rf"(?:月額{P.SP}*)?(?:¥|￥){P.SP}?[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\.[0-9]+)?|(?:月額{P.SP}*)?[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:万円|円)|(?:月額{P.SP}*)?[0-9]+(?:\.[0-9]+)?万円", "1234,,..円円万¥月額 ", "月額|万円|¥"),
    "project": (C._PROJECT_SPACED, 1, rf"{P.NOT_AFTER_WORD}[A-Z][A-Za-z0-9-]*(?:{P.SP}+[A-Z][A-Za-z0-9-]*){{0,5}}(?:{C.C.PROJECT_SUFFIXES})", "AAPab0-- _計", "PJ|計画|案件"),
    "email": (L._EMAIL, 0, r"(?i)[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}", "aB1.@@-_ ", "@a.co"),
}


@pytest.mark.parametrize("name", PLAIN)
def test_patterns_hit_what_their_plain_forms_hit(spark, name):
    pattern, group, plain, letters, words = PLAIN[name]
    r = random.Random(5)
    parts = [*letters, *words.split("|")]
    texts = [("".join(r.choice(parts) for _ in range(r.randint(1, 24))),) for _ in range(6000)]
    df = spark.createDataFrame(texts, "text string")
    found = df.select("text", F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("a"), F.regexp_extract_all("text", F.lit(plain), F.lit(0)).alias("b"))
    bad = found.where("a <> b").limit(3).collect()
    assert bad == []
    assert found.where("size(a) > 0").count() > 300


def test_field_scrub_hits_what_its_plain_form_hits(spark):
    plain = (
        rf"(?i){P.NOT_AFTER_WORD}(prompt|input|content|body|user(?:{P.SP}+(?:text|message))?){P.SP}*[:=]{P.SP}*"
        rf"(\"[^\"]*\"|'[^']*'|`[^`]*`|[^\n\r  ]+?)(?=(?:{P.SP}+{P.WORD}+{P.SP}*[:=])|\z)"
    )
    r = random.Random(6)
    parts = ["prompt", "user", " text", "x", "1", " ", "  ", "\n", ":", "=", ":", "\"", "'", "next", "あ"]
    df = spark.createDataFrame([("".join(r.choice(parts) for _ in range(r.randint(1, 16))),) for _ in range(20_000)], "text string")
    tidy = lambda pattern: F.trim(F.regexp_replace(F.regexp_replace("text", pattern, "$1: [redacted]"), f"{P.SP}+", " "))
    assert df.select("text", tidy(L._FIELD).alias("a"), tidy(plain).alias("b")).where("a <> b").limit(3).collect() == []


# --- folds -------------------------------------------------------------------


def findings(spark, spans):
    rows = [(a, b, rule, "rule", "l", risk, None, "", "[X_1]", "m", 1.0, f"{rule}:{a}:{b}") for a, b, rule, risk in spans]
    packed = spark.createDataFrame(rows, FINDING).agg(F.collect_list(F.struct(*[c.split()[0] for c in FINDING.split(", ")])).alias("hits"))
    return packed.cache()


@pytest.mark.parametrize("seed", range(6))
def test_overlaps_equal_brute_force(spark, seed):
    r = random.Random(seed)
    reach, longest = [(40, 9), (5000, 40), (5000, 3000), (200_000, 50), (9, 9), (1 << 20, 1 << 19)][seed]
    spans = []
    for _ in range(400):
        a = r.randint(-1, reach)
        spans.append((a, a + r.randint(-1, longest), r.choice("pqrs"), r.choice(list(RANKS))))
    got = findings(spark, spans).select(resolve_overlaps(F.col("hits")).alias("f")).first()["f"]
    want = greedy([s for s in spans if s[0] >= 0 and s[1] > s[0]])
    assert [(f["start"], f["end"], f["rule_id"], f["risk_level"]) for f in got] == want


@pytest.mark.parametrize("form", ["apart", "one line", "staircase"])
def test_hundred_thousand_findings_of_one_text(spark, form):
    def run(n):
        rows = spark.range(n).select(
            (F.col("id") * 12).cast("int").alias("start"),
            (F.col("id") * 12 + F.when(F.lit(form) == "staircase", 13 + F.col("id") % 40).otherwise(9)).cast("int").alias("end"),
            F.lit("p").alias("rule_id"), F.lit("rule").alias("source"), F.lit("l").alias("label"), F.lit("low").alias("risk_level"),
            F.lit(None).cast("string").alias("category"), F.lit("").alias("text"), F.lit("[X_1]").alias("placeholder"), F.lit("m").alias("message"),
            F.lit(1.0).alias("confidence"), F.col("id").cast("string").alias("id"),
        )
        if form == "one line":  # a medium finding over all of them, and one more in front
            rows = rows.unionAll(rows.limit(1).withColumn("start", F.lit(0)).withColumn("end", F.lit(12 * n)))
        packed = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("hits")).cache()
        packed.count()
        took, out = seconds(packed.select(F.size(resolve_overlaps(F.col("hits")))))
        assert out[0][0] == {"apart": n, "one line": 1}.get(form, out[0][0])
        return took

    doubles(run, (50_000, 100_000), factor=2.5, floor=1.0)


def test_hundred_thousand_hits_of_one_text(spark):
    rules = [r for r in BUNDLED_RULES if r.id == "email"]
    doubles(lambda n: seconds(raw_findings(one(spark, "ab@cd.ef " * n), "text", rules).select(F.size("hits")))[0], (50_000, 100_000), factor=2.5, floor=1.0)
    doubles(lambda n: seconds(one(spark, "ab " * n).select(F.size(find_literal(F.col("text"), F.lit("ab")))))[0], (50_000, 100_000), factor=2.5, floor=1.0)


def test_membership_and_first_of_each(spark):
    r = random.Random(3)
    for n in (0, 1, 5, 700):
        keys, wanted = ([r.choice([None, *map(str, range(n))]) for _ in range(n)] for _ in range(2))
        row = spark.createDataFrame([(keys, [w for w in wanted if w])], "k array<string>, w array<string>").select(
            is_in(F.col("k"), F.col("w")).alias("hit"), first_of_each(F.col("k"), lambda c: c).alias("first")
        ).first()
        assert row["hit"] == [k is not None and k in wanted for k in keys] and row["first"] == list(dict.fromkeys(keys))

    def run(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string")).alias("k")).cache()
        return seconds(df.select(F.size(F.filter(is_in(F.col("k"), F.reverse("k")), lambda x: x))))[0]

    doubles(run, (50_000, 100_000), factor=2.5, floor=1.0)


# --- candidates --------------------------------------------------------------


def bare(surface):
    return re.sub(r"[\s\x01]+", "", surface).lower()


def merged(candidates, terms):
    kind = lambda c: "org" if c in ("company_name", "customer_name") else c
    business = [t for t in terms if t[1] in C.C.BUSINESS_CATEGORIES]
    out = [c for c in candidates if not (c[1] in C.C.BUSINESS_CATEGORIES and any(bare(t[0]) in bare(c[0]) for t in business))]
    for t in terms:
        if not any(kind(c[1]) == kind(t[1]) and (bare(c[0]) in bare(t[0]) or bare(t[0]) in bare(c[0])) for c in out):
            out.append(t)
    return out


def term_rows(surfaces):
    return [(s, "P", k, "l", "r", "medium", 0.8) for s, k in surfaces]


def candidate_rows(surfaces):
    return [(f"m{i}", k, s, "l", "r", "medium", "[P_1]", 0.9, None, None) for i, (s, k) in enumerate(surfaces)]


def test_merge_equals_pairwise_form(spark):
    r = random.Random(11)
    kinds = ["person_name", "company_name", "customer_name", "project_name", *C.C.BUSINESS_CATEGORIES]
    surface = lambda: "".join(r.choice("ab B　x") for _ in range(r.randint(0, 5)))
    rows = []
    for _ in range(300):
        terms = sorted(((surface(), r.choice(kinds)) for _ in range(r.randint(0, 12))), key=lambda t: -len(t[0]))
        rows.append((candidate_rows([(surface(), r.choice(kinds)) for _ in range(r.randint(0, 4))]), term_rows(terms)))
    df = spark.createDataFrame(rows, f"c {C.CANDIDATE_TYPE}, t {C.TERM_TYPE}")
    for (c, t), got in zip(rows, df.select(C.merge_residual(F.col("c"), F.col("t")).alias("m")).collect(), strict=True):
        assert [(x["surface"], x["category"]) for x in got["m"]] == merged([(x[2], x[1]) for x in c], [(x[0], x[2]) for x in t])


def test_ten_thousand_candidates(spark):
    n = 10_000
    terms = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.concat(F.lit("名前"), i.cast("string"), F.lit("さん")), F.lit("P"), F.lit("person_name"), F.lit("l"), F.lit("r"), F.lit("medium"), F.lit(0.8)))
    model = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.lit("m"), F.lit("company_name"), F.concat(F.lit("会社"), i.cast("string")), F.lit("l"), F.lit("r"), F.lit("medium"), F.lit("[X_1]"), F.lit(0.9), i, i + 2))
    df = spark.range(1).select(terms.cast(C.TERM_TYPE).alias("t"), model.cast(C.CANDIDATE_TYPE).alias("c")).cache()
    took, rows = seconds(df.select(F.size(C.merge_residual(F.col("c"), F.col("t")))))
    assert rows[0][0] == 2 * n and took < 20
    took, rows = seconds(df.select(F.size(C.distinct_candidates(F.concat("c", "c")))))
    assert rows[0][0] == n and took < 10
