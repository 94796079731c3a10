"""Inputs derived from the given tables for operators whose own input is not a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import RULE_IDS
from ..functions.lets import fixed
from ..sources.readers import parse_signed_bundles, read_table
from ..sources.schemas import FIXTURE_SCHEMA
from .corpus import dealt, memos, spread

# Plain SQL that builds the same value in any engine.
FILE_NAME_SQL = """source || '/' || CASE doc_id % 9
WHEN 0 THEN 'note' || CAST(doc_id AS STRING) || '.txt'
WHEN 1 THEN 'Report ' || CAST(doc_id AS STRING) || '.MD '
WHEN 2 THEN 'scan' || CAST(doc_id AS STRING) || '.pdf'
WHEN 3 THEN '.env'
WHEN 4 THEN 'archive.tar.gz'
WHEN 5 THEN 'README'
WHEN 6 THEN 'photo' || CAST(doc_id AS STRING) || '.JPEG'
WHEN 7 THEN 'trailing.'
ELSE 'app' || CAST(doc_id AS STRING) || '.test.ts' END"""
BASE_NAME_SQL = FILE_NAME_SQL.replace("source || '/' || ", "")

PAGE_ADDRESS_SQL = """CASE page_id % 8
WHEN 0 THEN 'https://chatgpt.com/c/' || CAST(page_id AS STRING)
WHEN 1 THEN 'https://Claude.ai/chat/' || CAST(page_id AS STRING)
WHEN 2 THEN 'https://gemini.google.com:443/app?x=' || CAST(page_id AS STRING)
WHEN 3 THEN 'https://www.perplexity.ai/search/' || CAST(page_id AS STRING)
ELSE url END"""

USER_AGENT_SQL = """CASE event_type
WHEN 'view' THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/' || CAST(100 + user_id % 40 AS STRING) || '.0.0.0 Safari/537.36'
WHEN 'purchase' THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Edg/' || CAST(90 + user_id % 9 AS STRING) || '.1'
WHEN 'click' THEN 'Mozilla/5.0 (Linux; Android 14) Chromium/' || CAST(user_id % 30 AS STRING) || '.2 Mobile'
WHEN 'signup' THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Version/17.0 Safari/604.1'
ELSE 'Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101 Firefox/' || CAST(user_id % 100 AS STRING) END"""

_U = "CAST(user_id AS STRING)"
MESSAGE_SQL = f"""CASE event_type
WHEN 'view' THEN 'Failed to fetch model for user' || {_U} || '@mail.example.com  retry'
WHEN 'purchase' THEN 'quota exceeded, input: order of customer ' || {_U} || ' code: 507'
WHEN 'click' THEN 'worker said "the quick brown fox number ' || {_U} || ' jumps over" phone 090-1234-5678'
WHEN 'signup' THEN 'aborted after 30s key AKIA' || LPAD({_U}, 16, '0') || ' by 山田花子 account' || {_U}
ELSE 'prompt = ' || {_U} || ' body text' END"""
SOURCE_SQL = f"""CASE event_type
WHEN 'signup' THEN '山田花子 uses account' || {_U}
WHEN 'view' THEN 'retry later'
WHEN 'click' THEN ''
ELSE 'customer order ' || {_U} END"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(read_table(spark, folder, "documents"))
    return docs.select(
        "doc_id", "source", F.expr(BASE_NAME_SQL).alias("name"), F.expr(FILE_NAME_SQL).alias("path"), "text"
    )


def spans_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve spans per order with all kinds of overlap, some of them not valid."""
    orders = dealt(read_table(spark, folder, "orders").select("o_orderkey", "o_custkey"))
    levels = F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")])
    ids = F.array(*[F.lit(x) for x in RULE_IDS])

    def span(i):
        start = ((F.col("o_orderkey") * 7 + i * 13) % 40 - 2).cast("int")
        end = (start + (F.col("o_custkey") + i * 5) % 9 - 1).cast("int")
        rule = F.element_at(ids, ((F.col("o_custkey") + i * 3) % len(RULE_IDS) + 1).cast("int"))
        return F.struct(
            start.alias("start"),
            end.alias("end"),
            rule.alias("rule_id"),
            F.lit("rule").alias("source"),
            rule.alias("label"),
            F.element_at(levels, ((F.col("o_orderkey") + i * i) % 4 + 1).cast("int")).alias("risk_level"),
            F.lit(None).cast("string").alias("category"),
            F.lit("").alias("text"),
            F.concat(F.lit("["), F.upper(F.substring(rule, 1, 3)), F.lit("_1]")).alias("placeholder"),
            F.lit("").alias("message"),
            F.lit(1.0).alias("confidence"),
            F.lit("").alias("id"),
        )

    return orders.select("o_orderkey", F.transform(F.sequence(F.lit(0), F.lit(11)), span).alias("hits"))


def installs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored settings per customer, partly missing or wrong."""
    customers = read_table(spark, folder, "customer")
    ids = F.array(*[F.lit(x) for x in RULE_IDS])
    key = F.col("c_custkey")
    one = F.create_map(
        F.element_at(ids, (key % len(RULE_IDS) + 1).cast("int")), F.col("c_acctbal") > 5000, F.lit("retired_rule"), F.lit(False)
    )
    every = F.map_from_arrays(ids, F.transform(ids, lambda r: F.length(r) % 2 == key % 2))
    sites = F.create_map(
        F.lit("chatgpt"), F.lit(True), F.lit("openai_chat"), F.col("c_acctbal") > 0, F.lit("claude"), key % 3 == 0,
        F.lit("gemini"), F.lit(True), F.lit("perplexity"), F.lit(False),
    )
    return customers.select(
        "c_custkey",
        F.when(F.col("c_nationkey") % 3 == 0, 3).otherwise(4).alias("version"),
        F.when(F.col("c_nationkey") % 2 == 0, every).otherwise(one).alias("rules"),
        F.when(F.col("c_nationkey") % 5 == 0, F.create_map(F.lit("claude"), F.lit(False))).otherwise(sites).alias("sites"),
        F.when(F.col("c_mktsegment") == "BUILDING", "auto").when(F.col("c_mktsegment") == "MACHINERY", "sometimes")
        .otherwise("manual").alias("mode"),
        (F.col("c_acctbal") > 0).alias("enabled"),
        F.when(key % 2 == 0, "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0").otherwise("Mozilla/5.0 (X11; Linux) Edg/99.1")
        .alias("user_agent"),
    )


def bundles(spark: SparkSession, folder: str) -> DataFrame:
    """A signed bundle per part, written as JSON text and parsed back by the bundle source."""
    part = dealt(read_table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_brand"))
    key, size = F.col("p_partkey"), F.col("p_size")

    def rule(i: int):
        return F.struct(
            F.when(size == 3 + i, "Bad Id").otherwise(F.concat(F.lit(f"rule{i}-"), key.cast("string"))).alias("id"),
            F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("label"),
            F.when(size == 11 + i, "urgent").when(size % 2 == 0, "high").otherwise("low").alias("riskLevel"),
            F.when(size % 3 == 0, "secret").when(size % 3 == 1, "unheard_of").alias("category"),
            F.when(size == 21 + i, "lower").otherwise("PART").alias("placeholderPrefix"),
            F.when(size == 31 + i, "").when(size == 33 + i, F.repeat(F.lit("x"), 501)).otherwise(F.col("p_brand")).alias("pattern"),
            F.when(size == 41 + i, "gx").when(size % 4 == 0, "gi").alias("flags"),
            F.lit(" check ").alias("message"),
            ((size - 10) / 20).alias("confidence"),
            F.when(size % 7 == 0, F.lit(False)).alias("enabled"),
        )

    payload = F.struct(
        F.when(key % 50 == 49, 2).otherwise(1).alias("schemaVersion"),
        F.when(key % 50 == 48, "  ").otherwise(F.concat(F.lit("v"), size.cast("string"))).alias("version"),
        F.when(key % 50 == 47, "someday").when(key % 50 == 46, "2026-07-29T12:30:00.000Z")
        .otherwise("2026-07-29T00:00:00.000Z").alias("generatedAt"),
        F.when(key % 50 == 45, "2020-01-01T00:00:00.000Z").when(key % 50 == 44, "2026-07-29T06:00:00.000Z")
        .when(key % 50 < 40, "2099-12-31T00:00:00.000Z").alias("expiresAt"),
        F.when(key % 50 == 43, "broken").when(key % 50 == 42, "paused").when(key % 50 < 30, "active").alias("deliveryStatus"),
        F.lit("0.1.2").alias("minExtensionVersion"),
        F.when(key % 50 == 41, F.lit(None)).otherwise(F.array(rule(0), rule(1))).alias("rules"),
    )
    signed = F.struct(
        F.when(key % 20 == 19, "RS256").otherwise("ECDSA-P256-SHA256").alias("alg"),
        F.when(key % 20 == 18, "").otherwise(F.concat(F.lit("key-"), (key % 12).cast("string"))).alias("keyId"),
        payload.alias("payload"),
        F.when(key % 20 == 17, "").otherwise("c2lnbmF0dXJl").alias("signature"),
    )
    written = F.to_json(signed)
    # Some bundles are no JSON object, and some hold fields of a wrong type.
    written = (
        F.when(key % 60 == 59, F.concat(F.lit("not json "), F.col("p_name")))
        .when(key % 60 == 58, F.concat(F.lit("["), written, F.lit("]")))
        .when(key % 60 == 57, F.regexp_replace(written, '"version":"[^"]*"', '"version":7'))
        .when(key % 60 == 56, F.regexp_replace(written, '"label":"[^"]*"', '"label":{"text":"x"}'))
        .when(key % 60 == 55, F.regexp_replace(written, '"expiresAt":"[^"]*"', '"expiresAt":5'))
        .otherwise(written)
    )
    return part.select(
        "p_partkey", parse_signed_bundles(written).alias("b"),
        F.when(key % 20 == 16, F.lit(False)).when(key % 20 != 15, F.lit(True)).alias("signature_ok"),
    ).select("p_partkey", "b.*", "signature_ok")


def documented_catalogues(spark: SparkSession, folder: str) -> DataFrame:
    """A rule list per supplier, each with its own slips: a rule left out, moved, told twice, or not known."""
    key, n = F.col("s_suppkey"), len(RULE_IDS)
    ids = F.array(*[F.lit(x) for x in RULE_IDS])
    base = read_table(spark, folder, "supplier").select(key, F.posexplode(ids).alias("i", "rule_id"))
    moved = F.when((F.col("i") == key * 7 % n) & (key % 2 == 0), 60).when((F.col("i") == key * 11 % n) & (key % 6 == 0), -5).otherwise(F.col("i") * 2)
    listed = base.where(~((F.col("i") == key % n) & (key % 3 == 0))).select(key, moved.cast("int").alias("position"), "rule_id")
    twice = base.where((F.col("i") == key * 5 % n) & (key % 4 == 1)).select(key, F.lit(90).alias("position"), "rule_id")
    old = base.where((F.col("i") == 0) & (key % 5 == 0)).select(key, F.lit(7).alias("position"), F.lit("retired_rule").alias("rule_id"))
    return listed.unionByName(twice).unionByName(old)


PACKING_SQL = """'Order ' || CAST(l_orderkey AS STRING) || ' needs Brand#' || CAST(1 + l_linenumber % 5 AS STRING) || CAST(1 + l_suppkey % 5 AS STRING)
|| ', not brand#' || CAST(1 + l_partkey % 5 AS STRING) || CAST(1 + l_orderkey % 5 AS STRING)"""


def packing_notes(spark: SparkSession, folder: str) -> DataFrame:
    """One note per line of an order; its part says which bundle it belongs to."""
    lines = read_table(spark, folder, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.expr(PACKING_SQL).alias("text"))


def signing_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Known keys: ten of the twelve that bundles name."""
    nation = read_table(spark, folder, "nation").where("n_nationkey < 10")
    return nation.select(F.concat(F.lit("key-"), F.col("n_nationkey").cast("string")).alias("key_id"))


NOW_MS = 1_785_322_800_000  # 2026-07-29T11:00:00Z


def fetch_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """One rule fetch per customer."""
    c = read_table(spark, folder, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("client_id"),
        F.when(key % 11 == 0, " ").otherwise("https://rules.example.com/latest.json").alias("endpoint"),
        F.when(key % 3 == 0, "ok").when(key % 3 == 1, "http").otherwise("error").alias("outcome"),
        (F.col("c_acctbal") > 2000).alias("admitted"),
        F.when(F.col("c_acctbal") <= 2000, "rejected").alias("reason"),
        F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("version"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit(NOW_MS) + key * 1000).alias("expires_ms"),
    )


def attempts_over_time(spark: SparkSession, folder: str) -> DataFrame:
    """The fetches of customers, three each, at moments before, between and after their cached entries."""
    moment = F.lit(NOW_MS) - (F.col("client_id") * 7919 + F.col("nth") * 1_700_017) % 6_000_000
    return fetch_attempts(spark, folder).withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "*", moment.alias("attempted_at")
    ).drop("nth")


def cache_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Cached bundles: one per order, so a customer has several over time."""
    o = read_table(spark, folder, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("client_id"),
        F.concat(F.lit("key-"), (key % 5).cast("string")).alias("key_id"),
        F.concat(F.lit("key-"), (key % 5 + F.when(key % 17 == 0, 1).otherwise(0)).cast("string")).alias("bundle_key_id"),
        F.concat(F.lit("v"), key.cast("string")).alias("version"),
        F.lit("2026-07-29T00:00:00.000Z").alias("generated_at"),
        (F.lit(NOW_MS) - (key * 37) % 5_000_000).alias("cached_at"),
        (F.lit(NOW_MS) - (key * 37) % 5_000_000 + 1_800_000).alias("expires_at"),
        (key % 13 != 0).alias("admitted"),
        F.concat(F.lit("v"), (key + F.when(key % 19 == 0, 1).otherwise(0)).cast("string")).alias("payload_version"),
        F.lit("2026-07-29T00:00:00.000Z").alias("payload_generated_at"),
    )


def stored_cache_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Cache entries as stored, some of them incomplete."""
    o = read_table(spark, folder, "orders")
    key = F.col("o_orderkey")
    bundle = F.struct(
        F.lit("ECDSA-P256-SHA256").alias("alg"),
        F.when(key % 7 != 0, "key-1").alias("keyId"),
        F.lit("c2ln").alias("signature"),
        F.when(key % 11 != 0, F.struct(F.lit(1).alias("schemaVersion"))).alias("payload"),
    )
    return o.select(
        "o_orderkey",
        F.when(key % 23 != 0, bundle).alias("bundle"),
        F.when(key % 5 == 0, "").otherwise("key-1").alias("key_id"),
        F.when(key % 6 != 0, "v1").alias("version"),
        F.lit("2026-07-29T00:00:00.000Z").alias("generated_at"),
        F.when(key % 9 == 0, F.lit(float("nan"))).otherwise(key.cast("double")).alias("cached_at"),
        F.when(key % 8 == 0, F.lit(float("inf"))).otherwise(key.cast("double")).alias("expires_at"),
    )


def words_as_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Entity tokens from chat turns: each word of a turn, labelled by its length."""
    turns = spread(read_table(spark, folder, "conversations"))
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key")
    kind = "array<struct<start:int,word:string>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))

    def step(acc, word):
        entry = F.struct(acc["pos"].alias("start"), word.alias("word"))
        return F.struct(
            (acc["pos"] + F.char_length(word) + 1).alias("pos"), F.concat(acc["out"], F.array(entry)).alias("out")
        )

    placed = fixed(F.aggregate(F.split("text", " "), start, step, lambda acc: acc["out"]))
    words = turns.select(key, "text", placed.alias("w")).select("key", "text", F.posexplode("w").alias("index", "w"))
    words = words.select("key", "text", "index", F.col("w")["word"].alias("word"), F.col("w")["start"].alias("start"))
    n, before = F.char_length("word"), F.col("start")
    label = (
        F.when(n % 9 == 1, "O").when(n % 9 == 2, "B-PER").when(n % 9 == 3, "I-PER").when(n % 9 == 4, "LOC")
        .when(n % 9 == 5, "B-ORG").when(n % 9 == 6, "PRD").when(n % 9 == 7, "ORG-P").when(n % 9 == 8, "X").otherwise("EVT")
    )
    return words.select(
        "key", "text", "index", label.alias("entity"), ((n * 7 + F.col("index") * 3) % 50 / 100 + 0.5).alias("score"),
        "word", before.alias("start"), (before + n).alias("end"),
    )


def text_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """A fixture per memo, written as JSON text and parsed back by the fixture schema."""
    form = F.col("o_orderkey") % 16
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs])
    expect = F.struct(
        F.struct(
            F.when(form == 0, 3).when(form == 1, 4).when(form == 8, 4).when(form == 13, 0).otherwise(1).alias("total"),
            F.when(form == 0, 2).alias("high"),
        ).alias("summary"),
        F.when(form == 0, strings("email", "phone")).when(form == 8, strings("date", "url")).otherwise(strings("amount"))
        .alias("includesRuleIds"),
        F.when(form < 8, strings("date")).alias("excludesRuleIds"),
        F.struct(
            F.when(form.isin(3, 4, 5, 6, 0), "sanitize_required").when(form == 12, "allow").alias("action"),
            F.when(form == 13, "none").alias("severity"),
            F.when(form > 10, F.lit(True)).alias("canSendRaw"),
        ).alias("policy"),
        F.when(form == 1, strings("[金額情報]", "[URL]")).alias("generalizedIncludes"),
        F.when(form == 0, strings("@mail")).alias("generalizedExcludes"),
        F.when(form == 8, strings("[DATE_1]", "[URL_1]")).alias("maskedIncludes"),
        F.when(form == 9, strings("corp", "10.")).alias("maskedExcludes"),
    )
    whole = F.struct(
        F.concat(F.lit("memo-"), (F.col("o_orderkey") - F.when(F.col("o_custkey") % 40 == 0, 1).otherwise(0)).cast("string")).alias("id"),
        F.concat(F.lit("form"), form.cast("string")).alias("category"),
        F.lit("memo").alias("description"),
        F.col("text").alias("input"),
        expect.alias("expect"),
    )
    parsed = memos(spark, folder).select("o_orderkey", F.from_json(F.to_json(whole), FIXTURE_SCHEMA).alias("f"))
    return parsed.select("o_orderkey", "f.*")
