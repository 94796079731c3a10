"""Delivered rule bundles: admission checks, verdicts, cache fallback, rules."""

from __future__ import annotations

import datetime as dt
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.lets import fixed, strip
from ..functions.patterns import EDGE, SP, SPACE
from ..functions.rules import TextRule
from ..functions.spans import CLOSE, FINDINGS_TYPE, OPEN, empty, spans_of_pieces, without_marks
from .asof import HOUR_MS, as_of


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def clean_rule(rule: Column) -> Column:
    """A rule entry in normal form: trimmed, confidence clamped, unknown category dropped."""
    return F.struct(
        strip(_text(rule["id"])).alias("id"),
        strip(_text(rule["label"])).alias("label"),
        rule["riskLevel"].alias("risk_level"),
        F.when(rule["category"].isin(X.CATEGORIES), rule["category"]).alias("category"),
        strip(_text(rule["placeholderPrefix"])).alias("prefix"),
        _text(rule["pattern"]).alias("pattern"),
        _text(rule["flags"]).alias("flags"),
        F.nullif(strip(_text(rule["message"])), F.lit("")).alias("message"),
        F.when(
            rule["confidence"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), rule["confidence"]))
        ).alias("confidence"),
        rule["enabled"].alias("enabled"),
    )


def rule_is_valid(rule: Column) -> Column:
    """Whether a cleaned rule may be part of a bundle."""
    return (
        F.rlike(rule["id"], F.lit("^[a-z0-9][a-z0-9_-]{1,62}\\z"))
        & (rule["label"] != "")
        & F.coalesce(rule["risk_level"].isin(list(X.RISK_RANK)), F.lit(False))
        & F.rlike(rule["prefix"], F.lit("^[A-Z0-9_]{2,40}\\z"))
        & F.char_length(rule["pattern"]).between(1, X.BUNDLE_MAX_PATTERN_CHARS)
        & F.rlike(rule["flags"], F.lit("^[dgimsuvy]*\\z"))
    )


def with_clean_payload(bundles: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``rules`` (cleaned), ``generated_ts``, ``expires_ts`` and ``payload_valid``.

    One bad rule rejects its bundle. The rules sit in an array of the bundle row,
    so this is a projection.
    """
    p = F.col(payload)
    expires = _text(strip(p["expiresAt"]))
    staged = (
        bundles.withColumn("rules", F.transform(p["rules"], clean_rule))
        .withColumn("generated_ts", F.try_to_timestamp(strip(p["generatedAt"])))
        .withColumn("expires_ts", F.when(expires != "", F.try_to_timestamp(expires)))
    )
    status = p["deliveryStatus"]
    valid = (
        (p["schemaVersion"] == X.BUNDLE_SCHEMA_VERSION)
        & (strip(_text(p["version"])) != "")
        & F.col("generated_ts").isNotNull()
        & (status.isNull() | status.isin("active", "paused"))
        & ((expires == "") | (F.col("expires_ts") > F.col("generated_ts")))
        & F.col("rules").isNotNull()
        & F.forall(F.col("rules"), rule_is_valid)
        & (F.size(F.col("rules")) <= X.BUNDLE_MAX_RULES)
    )
    return staged.withColumn("payload_valid", F.coalesce(valid, F.lit(False)))


def with_known_key(bundles: DataFrame, keys: DataFrame, expected_key_id: str | None = None) -> DataFrame:
    """Mark bundles whose key is the expected one and is in the key table."""
    known = keys.select(F.col("key_id").alias("keyId")).distinct().withColumn("key_known", F.lit(True))
    matches = F.lit(True) if expected_key_id is None else (F.col("keyId") == expected_key_id)
    return (
        bundles.join(known, "keyId", "left")
        .withColumn("key_known", F.coalesce("key_known", F.lit(False)))
        .withColumn("key_expected", F.coalesce((F.col("keyId") != "") & matches, F.lit(False)))
    )


def temporal_reason(now: Column, max_future_seconds: int = X.BUNDLE_MAX_FUTURE_SECONDS) -> Column:
    """Why a bundle is out of its time, or null."""
    return F.when(
        F.col("generated_ts") > now + F.make_dt_interval(secs=F.lit(max_future_seconds)), X.BUNDLE_REASON["future"]
    ).when(F.col("expires_ts") <= now, X.BUNDLE_REASON["expired"])


def with_verdict(
    bundles: DataFrame, now: dt.datetime | Column, payload: str = "payload", signature_ok: str = "signature_ok"
) -> DataFrame:
    """First failed check as ``reason``; null means admitted.

    Checks run in a fixed order. The outcome of the signature check is an input
    column; a null there means the check itself failed, which rejects.
    """
    at = now if isinstance(now, Column) else F.lit(now)
    why = X.BUNDLE_REASON
    formed = F.col("well_formed") if "well_formed" in bundles.columns else F.lit(True)
    reason = (
        F.when(~F.coalesce(formed, F.lit(False)), why["format"])
        .when(F.col("alg").isNull() | (F.col("alg") != X.BUNDLE_SIGNATURE_ALG), why["alg"])
        .when(~F.col("key_expected"), why["key_id"])
        .when(~F.col("key_known"), why["no_key"])
        .when(~F.col("payload_valid"), why["payload"])
        .when(_text(F.col("signature")) == "", why["no_signature"])
        .when(F.col(signature_ok).isNull(), why["check_failed"])
        .when(~F.col(signature_ok), why["signature"])
        .otherwise(
            F.coalesce(
                temporal_reason(at), F.when(F.col(payload)["deliveryStatus"] == "paused", why["paused"])
            )
        )
    )
    return bundles.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def cache_row_is_valid() -> Column:
    """Whether a cached entry has every required field, present and finite."""
    b = F.col("bundle")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return (
        b.isNotNull()
        & b["alg"].isNotNull()
        & b["keyId"].isNotNull()
        & b["signature"].isNotNull()
        & b["payload"].isNotNull()
        & (_text(F.col("key_id")) != "")
        & (_text(F.col("version")) != "")
        & (_text(F.col("generated_at")) != "")
        & finite(F.col("cached_at").cast("double"))
        & finite(F.col("expires_at").cast("double"))
    )


def latest_cached(cache: DataFrame, client: str = "client_id") -> DataFrame:
    """Newest cache entry per client, by partial aggregation rather than a window."""
    fields = [c for c in cache.columns if c != client]
    newest = F.max_by(F.struct(*fields), F.struct("cached_at", "version"))
    return cache.groupBy(client).agg(newest.alias("cached"))


def delivery_outcome(
    attempts: DataFrame,
    cache: DataFrame,
    now_ms: int | Column,
    client: str = "client_id",
    ttl_seconds: int = X.BUNDLE_CACHE_TTL_SECONDS,
) -> DataFrame:
    """Which rules a client works with after a fetch.

    ``attempts``: client, ``endpoint``, ``outcome`` (ok, http or error), ``admitted``,
    ``reason``, ``version``, ``expires_ms``. ``cache``: client, ``key_id``,
    ``bundle_key_id``, ``version``, ``generated_at``, ``cached_at``, ``expires_at``,
    ``admitted``, ``payload_version``, ``payload_generated_at``. The cache counts only
    when the fetch failed; a bundle that arrived but was rejected never falls back to it.
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return _outcome(attempts.join(latest_cached(cache, client), client, "left"), now, client, ttl_seconds)


def delivery_outcome_as_of(
    attempts: DataFrame,
    cache: DataFrame,
    at: str = "attempted_at",
    client: str = "client_id",
    ttl_seconds: int = X.BUNDLE_CACHE_TTL_SECONDS,
    width: int = HOUR_MS,
) -> DataFrame:
    """The same for attempts over time: each is judged at its own moment (``at``, milliseconds), with the entry that was the newest then."""
    joined = as_of(attempts, cache, [client], at, "cached_at", "version", "cached", width)
    return _outcome(joined, F.col(at), client, ttl_seconds, [at])


def _outcome(joined: DataFrame, now: Column, client: str, ttl_seconds: int, keep: list[str] | None = None) -> DataFrame:
    c = F.col("cached")
    usable = F.coalesce(
        (c["expires_at"] > now)
        & c["admitted"]
        & (c["key_id"] == c["bundle_key_id"])
        & (c["version"] == c["payload_version"])
        & (c["generated_at"] == c["payload_generated_at"]),
        F.lit(False),
    )
    off = strip(_text(F.col("endpoint"))) == ""
    arrived = F.col("outcome") == "ok"
    status = (
        F.when(off, "disabled")
        .when(arrived & F.col("admitted"), "verified")
        .when(arrived, "fallback")
        .when(usable, "cached")
        .otherwise("fallback")
    )
    reason = (
        F.when(off | (arrived & F.col("admitted")), F.lit(None).cast("string"))
        .when(arrived, F.col("reason"))
        .when(F.col("outcome") == "http", X.BUNDLE_REASON["http"])
        .otherwise(X.BUNDLE_REASON["fetch"])
    )
    ttl = now + F.lit(ttl_seconds * 1000)
    return joined.select(
        client,
        *(keep or []),
        status.alias("status"),
        reason.alias("reason"),
        F.when(status == "verified", F.col("version")).when(status == "cached", c["version"]).alias("version"),
        F.when(status == "verified", F.least(ttl, F.coalesce(F.col("expires_ms"), ttl))).alias("cache_until"),
    )


# --- rules of an admitted bundle -------------------------------------------

_TOKEN = re.compile(r"\\u\{[0-9A-Fa-f]+\}|\\[pP]\{[^}]*\}|\\.|\[\^?\]|\[\^?|\]|\^|\$|\.", re.S)
_LINE_END = "\\n\\r\\u2028\\u2029"


def java_pattern(pattern: str, flags: str = "") -> str | None:
    """A delivered pattern spelled for the Java engine, or None if it has no counterpart."""
    if "v" in flags:
        return None
    multi, dot_all = "m" in flags, "s" in flags
    in_class = False

    def one(match: re.Match) -> str:
        nonlocal in_class
        token = match.group(0)
        if token.startswith("\\u{"):
            return f"\\x{{{token[3:-1]}}}"
        if token[:2] in ("\\p", "\\P") and len(token) > 2:
            name = token[3:-1]
            script = re.fullmatch(r"(?:Script|sc|Script_Extensions|scx)=(\w+)", name)
            return f"{token[:2]}{{Is{script.group(1)}}}" if script else token
        if in_class:
            in_class = token != "]"
            return {"\\s": SPACE, "\\S": f"&&[^{SPACE}]", "[": "\\["}.get(token, token)
        if token in ("[]", "[^]"):
            return "(?!)" if token == "[]" else "[\\s\\S]"
        in_class = token in ("[", "[^")
        plain = {
            "\\b": EDGE,
            "\\B": f"(?!{EDGE})",
            "\\s": SP,
            "\\S": f"[^{SPACE}]",
            ".": "[\\s\\S]" if dot_all else f"[^{_LINE_END}]",
            "^": f"(?<![^{_LINE_END}])" if multi else "\\A",
            "$": f"(?![^{_LINE_END}])" if multi else "\\z",
            "\\/": "/",
        }
        return plain.get(token, token)

    body = _TOKEN.sub(one, pattern)
    if "y" in flags:
        body = f"\\G(?:{body})"
    if "i" in flags:
        body = ("(?iu)" if "u" in flags else "(?i)") + body
    return body


def compiles(spark, pattern: str) -> bool:
    """Whether the JVM accepts a pattern; the driver's regex engine is asked, with no job."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except (IllegalArgumentException, Py4JJavaError):
        return False


def rules_of_bundle(spark, admitted: DataFrame) -> list[TextRule]:
    """Rules of one admitted bundle as plan-time rules.

    ``admitted`` holds one row of :func:`with_verdict`; more admitted rows are refused. Validation has capped a bundle at
    100 rules of 500 characters, so it is safe to bring to the driver.
    """
    bundles = admitted.where("admitted").select("rules").limit(2).collect()
    if len(bundles) > 1:
        raise ValueError("more than one admitted bundle; choose one")
    rows = [r for b in bundles for r in b["rules"] or []]
    out = []
    for r in rows:
        pattern = java_pattern(r["pattern"], r["flags"])
        if pattern is None or not compiles(spark, pattern):
            continue
        out.append(
            TextRule(
                id=f"remote:{r['id']}",
                label=r["label"],
                risk_level=r["risk_level"],
                prefix=r["prefix"],
                message=r["message"] or X.BUNDLE_DEFAULT_MESSAGE,
                confidence=X.BUNDLE_DEFAULT_CONFIDENCE if r["confidence"] is None else r["confidence"],
                category=r["category"],
                pattern=pattern,
                id_source="remote",
                enabled=r["enabled"] is not False,
            )
        )
    return out


# --- rules of many bundles, as a table --------------------------------------

_ESCAPE = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]+\}|c[A-Za-z]|[pP]\{[^}]*\}|k<[^>]*>|[0-9]+|.|$)", re.S)
_PLAIN = re.compile(r"\\[^A-Za-z0-9]|[^\\^$.|?*+()\[\]{}]")


def required_text(pattern: str, flags: str = "") -> str:
    """The longest text that every hit of a delivered pattern holds, in lower case if case does not count; perhaps empty.

    Only what stands outside of groups and classes counts, and nothing in a pattern of alternatives.
    """
    best, run, depth, at = "", "", 0, 0
    while at < len(pattern):
        if pattern[at] == "[":
            token = re.compile(r"\[(?:\\.|[^\]\\])*\]", re.S).match(pattern, at)
            token = token.group(0) if token else pattern[at:]
        elif quantifier := re.compile(r"\{[0-9]+(?:,[0-9]*)?\}").match(pattern, at):
            token = quantifier.group(0)
        else:
            token = _ESCAPE.match(pattern, at).group(0) if pattern[at] == "\\" else pattern[at]
        at += len(token)
        depth += (token == "(") - (token == ")")
        if token == "|" and depth == 0:
            return ""
        after = pattern[at : at + 1]
        plain = depth == 0 and _PLAIN.fullmatch(token) and after not in ("?", "*", "{")
        run = run + token[-1] if plain else ""
        best = max(best, run, key=len)
        if after == "+":
            run = ""
    return best.lower() if "i" in flags else best


def bundle_rule_table(bundles: DataFrame, key: str) -> DataFrame:
    """Rules of all admitted bundles as rows of ``key``, ``number`` and ``rule``, ready to be scanned with.

    Patterns are spelled for the JVM once per distinct pattern, streamed through the driver, whose regex engine is asked whether it
    takes them; rules without a counterpart are left out, as in :func:`rules_of_bundle`.
    """
    spark = bundles.sparkSession
    r = F.col("rule")
    rows = bundles.where("admitted").select(key, F.posexplode("rules").alias("number", "rule")).where(F.coalesce(r["enabled"], F.lit(True)))
    usable = []
    for p in rows.select(r["pattern"].alias("pattern"), r["flags"].alias("flags")).distinct().toLocalIterator():
        pattern = java_pattern(p["pattern"], p["flags"])
        if pattern is not None and compiles(spark, pattern):
            usable.append((p["pattern"], p["flags"], pattern, required_text(p["pattern"], p["flags"]), "i" in p["flags"]))
    known = spark.createDataFrame(usable, "pattern string, flags string, java string, needle string, any_case boolean")
    rows = rows.join(known, (r["pattern"] == known["pattern"]) & (r["flags"] == known["flags"]))
    return rows.select(
        key,
        "number",
        F.struct(
            F.concat(F.lit("remote:"), r["id"]).alias("id"),
            r["label"].alias("label"),
            r["risk_level"].alias("risk_level"),
            F.concat(F.lit("["), r["prefix"], F.lit("_1]")).alias("placeholder"),
            F.coalesce(r["message"], F.lit(X.BUNDLE_DEFAULT_MESSAGE)).alias("message"),
            F.coalesce(r["confidence"], F.lit(X.BUNDLE_DEFAULT_CONFIDENCE)).alias("confidence"),
            r["category"].alias("category"),
            "java",
            "needle",
            "any_case",
        ).alias("rule"),
    )


def scan_with_own_bundle(texts: DataFrame, rules: DataFrame, key: str, text: str = "text", out: str = "hits") -> DataFrame:
    """Unsettled hits of each text with the rules of its own bundle (``key`` on both sides).

    A bundle's rules come to its texts as one array, at most as long as a bundle may be; a byte search for the text that a rule's
    hits must hold decides whether its pattern runs at all. Texts whose bundle has no rules have no hits.
    """
    packed = rules.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", "rule"))).alias("_rules"))
    staged = texts.join(packed, key, "left").withColumn("_match", without_marks(F.coalesce(F.col(text), F.lit("")))).withColumn("_folded", F.lower("_match"))
    match = F.col("_match")

    def hits_of(rule: Column) -> Column:
        marked = F.regexp_replace(match, rule["java"], F.lit(f"{OPEN}$0{CLOSE}"))
        spans = spans_of_pieces(F.split(F.concat(F.lit(CLOSE), marked), OPEN, -1))
        found = F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                rule["id"].alias("rule_id"),
                F.lit("rule").alias("source"),
                rule["label"].alias("label"),
                rule["risk_level"].alias("risk_level"),
                rule["category"].alias("category"),
                F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]).alias("text"),
                rule["placeholder"].alias("placeholder"),
                rule["message"].alias("message"),
                rule["confidence"].alias("confidence"),
                F.concat_ws(":", rule["id"], s["start"].cast("string"), s["end"].cast("string")).alias("id"),
            ),
        ).cast(FINDINGS_TYPE)
        near = F.contains(F.when(rule["any_case"], F.col("_folded")).otherwise(match), rule["needle"])
        return F.when(near, found).otherwise(empty(FINDINGS_TYPE))

    every = F.flatten(F.transform(F.coalesce("_rules", F.array().cast(packed.schema["_rules"].dataType)), lambda r: hits_of(r["rule"])))
    return staged.withColumn(out, fixed(every)).drop("_match", "_folded", "_rules")
