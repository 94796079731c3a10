"""Signals and windows of short texts go short ways, and are those of the plain definition."""

import random
import re

from pyspark.sql import functions as F

from veilscan.functions import context_fixed as C
from veilscan.functions.patterns import SP
from veilscan.functions.rules import _DETECTORS, all_findings, select_rules
from veilscan.operators import context as X

TERMS = [(term, reason, score) for reason, score, terms in C.CONTEXT_TERMS for term in terms]
HONORIFIC = "[\\p{IsHan}々〆ヵヶ]{1,6}(?:様|さん|氏|先生|くん|ちゃん)"
MONEY = f"¥{SP}?[0-9][0-9,]*|[0-9][0-9,]*(?:円|万円)"
PIECES = [term for term, _, _ in TERMS] + ["様", "さん", "氏", "先生", "田中", "々", "ヵ", "ア", "〇", "¥", "¥ ", "12", ",", "3,400", "円", "。", "\n", " ", "　", "NDA", "Confidential", "é", "﷐", "x" * 90]


def random_texts(n, length):
    pick = random.Random(11)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, length))) for _ in range(n)] + ["", None, "nda", "円", "円" * 200]


def test_patterns_hit_what_their_plain_forms_hit(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(3000, 10) if t], "t string")
    for plain, pattern in [(HONORIFIC, C.HONORIFIC_NAME), (MONEY, C.MONEY_LIKE)]:
        got = df.select("t", F.regexp_replace("t", plain, "<$0>").alias("a"), F.regexp_replace("t", pattern, "<$0>").alias("b")).collect()
        assert [r for r in got if r["a"] != r["b"]] == [] and any(r["a"] != r["t"] for r in got)


def test_terms_are_found_in_one_pass_and_all_of_them(spark):
    texts = random_texts(1500, 12)
    df = X.with_signals(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    # One search per term cost more than all else of a signal.
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") < 15
    people, money = re.compile(HONORIFIC.replace("\\p{IsHan}", "一-鿯〇々")), re.compile(MONEY.replace(SP, "[ 　\\n]"))
    for r in df.collect():
        want, lower = [], (r["text"] or "").lower()
        for n, (term, reason, score) in enumerate(TERMS):
            at = lower.find(term)
            while at >= 0:
                want.append((-score, at, 1, n, at + len(term), reason))
                at = lower.find(term, at + len(term))
        for part, pattern, reason in [(2, people, "near_person_like"), (3, money, "near_money")]:
            want += [(-2, m.start(), part, 0, m.end(), reason) for m in pattern.finditer(r["text"] or "")]
        got = [(s["start"], s["end"], s["reason"], s["score"], s["source"]) for s in r["signals"]]
        assert got == [(start, end, reason, -order, "term") for order, start, _, _, end, reason in sorted(want)], r["text"]


def plain_windows(text, signals, budget, size):
    def tidy(w):
        return re.sub("\n{3,}", "\n\n", re.sub("[\\s　]+\n", "\n", w)).strip(" \t\n　")

    pad, islands = max(C.MIN_WINDOW_PADDING, size // 2), []
    spans = sorted((max(0, s - pad), -score, i, min(len(text), e + pad), reason) for i, (s, e, reason, score) in enumerate(signals))
    for start, order, _, end, reason in spans:
        if islands and start <= islands[-1][2]:
            last = islands[-1]
            islands[-1] = (min(order, last[0]), last[1], max(end, last[2]), reason if order < last[0] else last[3])
        else:
            islands.append((order, start, end, reason))
    out, used = [], 0
    for _, start, end, reason in sorted(islands):
        window = tidy(text[start : start + min(end - start, budget - used)]) if used < budget else ""
        if window and window not in [w for w, _ in out]:
            out, used = out + [(window, reason)], used + len(window)
    head = tidy(text[: min(budget, size)])
    return out or ([(head, "near_business_context")] if head else [])


def test_windows_of_one_island_and_of_many(spark):
    pick, rows = random.Random(3), []
    for n in (0, 1, 1, 2, 2, 3, 5, 8, 70, 140):
        for length in (0, 30, 300, 4000):
            text = "".join(pick.choice("ab \n\n　あ漢") for _ in range(length))
            starts = [pick.randint(0, max(0, length - 1)) for _ in range(n if length else 0)]
            rows.append((text, [(s, min(length, s + pick.randint(1, 9)), f"r{s % 4}", s % 3) for s in starts]))
    df = spark.createDataFrame(rows, "text string, signals array<struct<start:int,end:int,reason:string,score:int>>")
    for budget, size in [(1200, 360), (220, 120), (5, 3)]:
        for r in X.with_windows(df, "text", max_input_chars=budget, window_chars=size).collect():
            want = plain_windows(r["text"], [tuple(s) for s in r["signals"]], budget, size)
            assert [tuple(w) for w in r["windows"]] == want, (r["text"], budget)


def test_no_guard_stops_a_hit(spark):
    words = "0 1 12 2026 4111 1111 - / . , 月 日 年 4111111111111111 a Z abcdefgh12345678 x 0000000000000 090 - 1234 5678 user@a.bc 10.0.0.7 ab.cdefghijkl. 番号".split(" ") + [" ", "\n"]
    pick = random.Random(5)
    df = spark.createDataFrame([("".join(pick.choice(words) for _ in range(pick.randint(1, 12))),) for _ in range(4000)], "t string")
    t = F.col("t")
    for rule_id in ["credit_card", "date", "long_id", "jwt", "ip_address", "postal_code", "phone", "email"]:
        guard, patterns = _DETECTORS[rule_id]
        hits = df.where(F.rlike(t, F.lit(patterns[0][0])))
        assert hits.where(~guard(t)).take(1) == [] and hits.take(1) != [], rule_id
        assert df.where(~guard(t)).take(1) != [], rule_id


def test_a_rule_costs_a_plain_branch(spark):
    assert str(all_findings(F.col("t"), select_rules())).count("CASE WHEN") < 10
