"""A test of the first character stands before the costly part of a pattern, and changes no hit; one hit needs no fold."""

import random
import re

from pyspark.sql import functions as F

from veilscan.functions import patterns as P
from veilscan.functions.rules import all_findings, select_rules
from veilscan.functions.spans import CHUNK_CHARS, cut, marked_pieces, rewrite, spans_of_pieces, text_chunks

FIRST = re.compile(r"^(\(\?i\))?\(\?=(?:\[[^\]]*\]|\w)\)")
GUARDED = "EMAIL PHONE CREDIT_CARD POSTAL_CODE URL IP_ADDRESS DATE LONG_ID AMOUNT INTERNAL_HOST JWT OAUTH_SECRET ENV_SECRET BASIC_AUTH_URL".split()
WORDS = (
    "0 1 12 2026 4111 1234 255 . , - _ / : @ % + = ¥ ￥ 円 万円 月額 月 日 年 a Z ab \n 　   社 http:// HTTPS://u:p@ localhost LocalHost dev .corp INTERNAL "
    "client_secret ClientSecret API_KEY TOKEN x1y2z3a4b5c6d7e8 abcdefghij. 090 03 090-1234-5678 a.b@c.de 10.0.0.7 2026/1/2"
).split(" ") + [" "]


def test_hits_are_those_without_the_test(spark):
    pick = random.Random(7)
    texts = ["".join(pick.choice(WORDS) for _ in range(pick.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in GUARDED:
        pattern = getattr(P, name)
        assert FIRST.match(pattern), name
        plain = FIRST.sub(lambda m: m.group(1) or "", pattern)
        hit = "<$2>" if pattern in P.WITH_LEAD else "<$0>"
        got = df.select("t", F.regexp_replace("t", pattern, hit).alias("a"), F.regexp_replace("t", plain, hit).alias("b")).collect()
        assert [r for r in got if r["a"] != r["b"]] == [], name
        assert any(r["a"] != r["t"] for r in got), name


def test_words_in_any_case_without_a_lower_cased_copy(spark):
    rules = select_rules(["oauth_client_secret", "confidential_text", "internal_url"])
    assert "_folded" not in str(all_findings(F.col("t"), rules))
    texts = ["CLIENTsecret: abcdefgh", "x nDa y", "CONFIDENTIAL", "a.CoRp", "LOCALHOST:1", "未公開", "client secret: abcdefgh", "n d a", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(all_findings(F.col("t"), rules).alias("f")).collect()
    assert [[f["rule_id"] for f in r["f"]] for r in rows] == [
        ["oauth_client_secret"], ["confidential_text"], ["confidential_text"], ["internal_url"], ["internal_url"], ["confidential_text"], [], [], [],
    ]


def test_one_hit_needs_no_fold(spark):
    assert "aggregate" not in str(spans_of_pieces(F.col("p"))).split("ELSE")[0]
    rows = spark.createDataFrame([("éabあ",), ("ab",), ("あ",), ("",), (None,)], "t string")
    got = rows.select(spans_of_pieces(marked_pieces(F.col("t"), "ab")).alias("s")).collect()
    assert [r["s"] and [tuple(s) for s in r["s"]] for r in got] == [[(1, 3, "ab")], [(0, 2, "ab")], [], [], None]


def test_texts_of_one_piece_are_not_cut_up(spark):
    assert str(text_chunks(F.col("t"))).startswith("Column<'CASE WHEN")
    for size in (0, 1, CHUNK_CHARS - 1, CHUNK_CHARS, CHUNK_CHARS + 1, 2 * CHUNK_CHARS + 3):
        text = "".join(chr(97 + i % 26) for i in range(size))
        spans = [(s, min(s + 5, size)) for s in range(0, size, 1000)]
        df = spark.createDataFrame([(text, [(*s, "*") for s in spans])], "t string, f array<struct<start:int,end:int,placeholder:string>>")
        df = df.withColumn("c", text_chunks(F.col("t")))
        row = df.select(rewrite(F.col("c"), F.char_length("t"), F.col("f")).alias("r"), cut(F.col("c"), F.lit(0), F.lit(size)).alias("all")).first()
        want, at = "", 0
        for s, e in spans:
            want, at = want + text[at:s] + "*", e
        assert row["r"] == want + text[at:] and row["all"] == text
