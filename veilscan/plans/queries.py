"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lets import fixed
from ..functions.rules import BUNDLED_RULES, TextRule, select_rules
from ..functions.scoring import category_of
from ..operators import bundles as B
from ..operators import candidates as C
from ..operators import context as X
from ..operators import evaluation as E
from ..operators import files as FL
from ..operators import intervals as I
from ..operators import logs as L
from ..operators import models as M
from ..operators import policy as P
from ..operators import reports as R
from ..operators import scan as S
from ..operators import settings as ST
from ..session import work_folder
from ..sources.readers import parse_signed_bundles, read_table, read_text_files, safe_files
from ..sources.safe_sink import read_files, write_files
from ..streaming.messages import start_scan, start_versioned_scan
from ..streaming.rules import publish_rules
from . import derived as D
from .corpus import corpus, memos

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _found(spark: SparkSession, folder: str, rules: list[TextRule] | None = None) -> DataFrame:
    return S.with_findings(corpus(spark, folder), "text", rules)


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return P.with_policy(_found(spark, folder))


def _note_texts(spark: SparkSession, folder: str) -> DataFrame:
    return memos(spark, folder).select(F.col("o_orderkey").alias("key"), "text")


def _spans(df: DataFrame, keys: list[str], column: str = "findings") -> DataFrame:
    f = F.col("f")
    return df.select(*keys, F.explode(column).alias("f")).select(
        *keys,
        f["rule_id"].alias("rule_id"),
        f["start"].alias("span_start"),
        f["end"].alias("span_end"),
        f["text"].alias("surface"),
        f["placeholder"].alias("placeholder"),
        f["confidence"].alias("confidence"),
    )


# --- scans, sources, sinks --------------------------------------------------


@query("corpus_scan")
def corpus_scan(spark, folder):
    scanned = S.scan(corpus(spark, folder), "text")
    return scanned.select(
        "key", F.col("summary")["total"].alias("n_findings"), "highest_risk", F.md5("rewritten").alias("safe_text_md5")
    )


@query("file_preflight")
def file_preflight(spark, folder):
    files = D.files(spark, folder)
    return files.select("doc_id", "name", FL.extension(F.col("name")).alias("extension"), FL.file_kind(F.col("name")).alias("kind"))


@query("text_file_source")
def text_file_source(spark, folder):
    """Chat turns written as text files of at most 1,000 lines, and read back as whole files."""
    target = work_folder(spark, "turns")
    line = F.concat_ws("\t", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.regexp_replace("text", "[\\r\\n]+", " "))
    read_table(spark, folder, "conversations").select(line.alias("value")).write.option("compression", "none").option("maxRecordsPerFile", 1000).text(target)
    lines = read_text_files(spark, target).select(F.explode(F.split("text", "\\n")).alias("line")).where("line <> ''")
    parts = F.split("line", "\\t", 3)
    return lines.select(
        F.get(parts, 0).cast("bigint").alias("conv_id"), F.get(parts, 1).cast("bigint").alias("turn"), F.get(parts, 2).alias("line")
    )


@query("safe_file_name")
def safe_file_name(spark, folder):
    return D.files(spark, folder).select("doc_id", "name", FL.safe_name(F.col("name")).alias("safe_name"))


@query("safe_file_sink")
def safe_file_sink(spark, folder):
    target = work_folder(spark, "safe-files")
    files = D.files(spark, folder).where(FL.file_kind(F.col("name")) == "supported_text").select("doc_id", "name", "text")
    safe_files(files, "mask").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).select("doc_id", "name", "rewritten", F.md5("text").alias("text_md5"))


@query("safe_files_written")
def safe_files_written(spark, folder):
    """Inspectable files written one by one under their safe names, and read back from their folders."""
    target = work_folder(spark, "safe-single-files")
    files = D.files(spark, folder).where(FL.file_kind(F.col("name")) == "supported_text").select(F.col("doc_id").cast("string").alias("key"), "name", "text")
    write_files(safe_files(files, "mask"), target)
    read = read_files(files.select("key"), target)
    return read.select(F.col("key").cast("bigint").alias("doc_id"), "name", F.length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("text_md5"))


@query("batch_attach_verdict")
def batch_attach_verdict(spark, folder):
    files = P.with_policy(S.with_findings(D.files(spark, folder), "text"))
    staged = files.select(
        "source", "name",
        F.when(FL.file_kind(F.col("name")) == "supported_text", F.size("findings")).alias("n_findings"),
        F.col("policy")["can_send_raw"].alias("can_send_raw"),
    )
    return FL.batch_verdicts(staged, "source")


@query("batch_unsupported_files")
def batch_unsupported_files(spark, folder):
    files = P.with_policy(S.with_findings(D.files(spark, folder), "text"))
    staged = files.select(
        "source", "name",
        F.when(FL.file_kind(F.col("name")) == "supported_text", F.size("findings")).alias("n_findings"),
        F.col("policy")["can_send_raw"].alias("can_send_raw"),
    )
    return FL.unsupported_names(staged, "source")


@query("rule_bundle_source")
def rule_bundle_source(spark, folder):
    p = F.col("payload")
    return D.bundles(spark, folder).select(
        "p_partkey", "alg", "keyId", p["version"].alias("version"), p["generatedAt"].alias("generated_at"),
        p["expiresAt"].alias("expires_at"), F.coalesce(F.size(p["rules"]), F.lit(-1)).alias("n_rules"),
    )


@query("fixture_source")
def fixture_source(spark, folder):
    x = F.col("expect")
    return D.text_fixtures(spark, folder).select(
        "o_orderkey", "id", "category", "input", x["summary"]["total"].alias("total"),
        F.array_join(x["includesRuleIds"], ",").alias("includes"), x["policy"]["action"].alias("action"),
    )


# --- rule selection, settings, labels ---------------------------------------


@query("rule_selection")
def rule_selection(spark, folder):
    rules = select_rules(enabled_ids=["email", "phone", "url", "internal_url", "date", "amount"], disabled_ids=["date"])
    return _spans(_found(spark, folder, rules), ["key"]).drop("confidence")


@query("min_risk_scan")
def min_risk_scan(spark, folder):
    found = _found(spark, folder, select_rules(min_risk="medium", include_low=False))
    return _spans(found, ["key"]).select("key", "rule_id", "span_start", "span_end", "placeholder")


@query("disabled_rules_per_row")
def disabled_rules_per_row(spark, folder):
    """Each memo is scanned with the rules its own customer has left on."""
    off = D.installs(spark, folder).select("c_custkey", ST.disabled_rules(ST.normal_rules(F.col("rules"))).alias("off"))
    notes = memos(spark, folder).join(off, F.col("o_custkey") == F.col("c_custkey"), "left")
    notes = notes.withColumn("off", F.coalesce("off", F.array().cast("array<string>")))
    return _spans(S.with_findings(notes, "text", disabled="off"), ["o_orderkey"]).select(
        "o_orderkey", "rule_id", "span_start", "span_end", "placeholder"
    )


@query("rule_settings")
def rule_settings(spark, folder):
    return D.installs(spark, folder).select(
        "c_custkey", F.explode(ST.normal_rules(F.col("rules"))).alias("rule_id", "enabled")
    )


@query("settings_messages")
def settings_messages(spark, folder):
    messages = ST.validation_messages(F.col("version"), F.col("sites"), F.col("rules"), F.col("mode"))
    return D.installs(spark, folder).select(
        "c_custkey", F.size(messages).alias("n_messages"), F.array_join(messages, "|").alias("messages"),
        (F.size(messages) == 0).alias("valid"),
    )


@query("site_gating")
def site_gating(spark, folder):
    pages = read_table(spark, folder, "pages").select("page_id", F.expr(D.PAGE_ADDRESS_SQL).alias("address"))
    site = ST.site_of_url(F.col("address"))
    sites = F.create_map(F.lit("gemini"), F.lit(False), F.lit("claude"), F.lit(True))
    return pages.select("page_id", site.alias("site"), ST.site_is_on(site, F.lit(True), sites).alias("scanning"))


@query("valid_span_filter")
def valid_span_filter(spark, folder):
    spans = D.spans_of_orders(spark, folder)
    valid = F.filter("hits", lambda f: (f["start"] >= 0) & (f["end"] > f["start"]))
    return spans.select("o_orderkey", F.size("hits").alias("n_spans"), F.size(valid).alias("n_valid"))


@query("category_lookup")
def category_lookup(spark, folder):
    cats = _found(spark, folder).select(F.explode(F.transform("findings", category_of)).alias("category"))
    return cats.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("selection_by_id")
def selection_by_id(spark, folder):
    """Findings of at least twelve characters, selected by their ids within each text: one scan, no join."""
    ids = F.transform(F.filter("findings", lambda f: F.char_length(f["text"]) >= 12), lambda f: f["id"])
    chosen = _found(spark, folder).withColumn("ids", fixed(ids)).withColumn("chosen", fixed(P.select_findings(F.col("findings"), F.col("ids"))))
    return chosen.select("key", F.explode("chosen").alias("f")).select("key", F.col("f")["id"].alias("id"), F.col("f")["rule_id"].alias("rule_id"))


@query("confidence_preselect")
def confidence_preselect(spark, folder):
    notes = _with_analysis(spark, folder)
    found = F.col("analysis")["candidates"]
    return notes.select(
        "key", F.size(C.preselected(found)).alias("n_default"),
        F.array_join(C.preselected(found, 0.82), ",").alias("strict_ids"),
    )


@query("risk_labels")
def risk_labels(spark, folder):
    judged = _judged(spark, folder)
    return judged.select(
        "key", P.risk_label(S.highest_risk(F.col("findings"))).alias("risk_label"),
        P.decision_label(F.col("policy")["risk"]["level"]).alias("decision_label"),
    )


# --- detectors --------------------------------------------------------------


def _detect(rule: TextRule) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        hits = S.raw_findings(corpus(spark, folder), "text", [rule])
        return _spans(hits, ["key"], "hits").drop("placeholder", "rule_id")

    return run


for _rule in BUNDLED_RULES:
    QUERIES[f"detect_{_rule.id}"] = _detect(_rule)

# Delivered rules as they come in a bundle: id, prefix, pattern, flags.
DELIVERED = [
    ("slack_webhook", "HOOK", "https://hooks\\.slack\\.com/services/[A-Za-z0-9/_-]+", "g"),
    ("corp_host", "HOST", "\\bDB\\d+\\.corp\\.[a-z.]+", "gi"),
    ("line_key", "LINE", "^ghp_\\w+", "gm"),
]


def _delivered(spark: SparkSession, folder: str) -> DataFrame:
    """A bundle of these rules as it arrives: JSON text, checked and judged like any other."""
    rules = [
        {"id": i, "label": i, "riskLevel": "high", "category": "secret", "placeholderPrefix": prefix, "pattern": pattern, "flags": flags, "message": i}
        for i, prefix, pattern, flags in DELIVERED
    ]
    payload = {"schemaVersion": 1, "version": "v1", "generatedAt": "2026-07-29T00:00:00.000Z", "expiresAt": "2099-12-31T00:00:00.000Z", "rules": rules}
    signed = {"alg": "ECDSA-P256-SHA256", "keyId": "key-3", "payload": payload, "signature": "c2lnbmF0dXJl"}
    row = spark.createDataFrame([(json.dumps(signed),)], "value string").select(parse_signed_bundles(F.col("value")).alias("b"), F.lit(True).alias("signature_ok"))
    keyed = B.with_known_key(B.with_clean_payload(row.select("b.*", "signature_ok")), D.signing_keys(spark, folder))
    return B.with_verdict(keyed, _now())


@query("bundle_rule_detection")
def bundle_rule_detection(spark, folder):
    rules = B.rules_of_bundle(spark, _delivered(spark, folder))
    hits = S.raw_findings(corpus(spark, folder), "text", rules)
    return _spans(hits, ["key"], "hits").select("key", "rule_id", "span_start", "span_end", "surface")


@query("bundle_rules_per_text")
def bundle_rules_per_text(spark, folder):
    """Each packing note with the rules of its own part's bundle, for all admitted bundles at once."""
    keyed = B.with_known_key(B.with_clean_payload(D.bundles(spark, folder)), D.signing_keys(spark, folder))
    rules = B.bundle_rule_table(B.with_verdict(keyed, _now()), "p_partkey")
    found = B.scan_with_own_bundle(D.packing_notes(spark, folder), rules, "p_partkey")
    return _spans(found, ["l_orderkey", "l_linenumber"], "hits").select("l_orderkey", "l_linenumber", "rule_id", "span_start", "span_end", "surface", "placeholder")


# --- span algebra -----------------------------------------------------------


@query("overlap_resolution")
def overlap_resolution(spark, folder):
    settled = S.resolve_column(D.spans_of_orders(spark, folder), "hits")
    f = F.col("f")
    return settled.select("o_orderkey", F.explode("findings").alias("f")).select(
        "o_orderkey", f["start"].alias("span_start"), f["end"].alias("span_end"), f["rule_id"].alias("rule_id"),
        f["risk_level"].alias("risk_level"), f["placeholder"].alias("placeholder"), f["id"].alias("id"),
    )


def _span_rows(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("f")
    return D.spans_of_orders(spark, folder).select("o_orderkey", F.posexplode("hits").alias("at", "f")).select(
        "o_orderkey", f["start"].alias("start"), f["end"].alias("end"), f["rule_id"].alias("rule_id"), f["risk_level"].alias("risk_level"),
        F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("at").cast("string")).alias("span_id"),
    )


@query("overlap_rows")
def overlap_rows(spark, folder):
    """Overlap resolution of spans that come as rows."""
    kept = I.resolve_span_rows(_span_rows(spark, folder), ["o_orderkey"])
    return kept.select("o_orderkey", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "rule_id", "risk_level")


@query("overlap_pairs")
def overlap_pairs(spark, folder):
    """How many spans each kept span has pushed out: interval join of the kept with all."""
    spans = _span_rows(spark, folder).where("start >= 0 AND end > start")
    settled = S.resolve_column(D.spans_of_orders(spark, folder), "hits").select("o_orderkey", F.explode("findings").alias("f"))
    kept = settled.select("o_orderkey", F.col("f")["start"].alias("start"), F.col("f")["end"].alias("end"))
    pairs = I.interval_join(kept, spans.select("o_orderkey", "start", "end"), ["o_orderkey"])
    return pairs.groupBy("o_orderkey", F.col("start").alias("span_start"), F.col("end").alias("span_end")).agg(
        F.count("*").alias("n_met"), F.sum(F.col("other_end") - F.col("other_start")).alias("n_chars")
    )


@query("settled_findings")
def settled_findings(spark, folder):
    return R.exploded(_found(spark, folder), ["key"]).select(
        "key", "id", "rule_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "label", "risk_level",
        "message", "confidence",
    )


@query("placeholder_numbering")
def placeholder_numbering(spark, folder):
    return _spans(_found(spark, folder), ["key"]).select("key", "span_start", "placeholder")


def _rewrite_query(mode: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return S.with_rewritten(_found(spark, folder), "text", "findings", mode).select("key", "rewritten")

    return run


QUERIES["mask_text"] = _rewrite_query("placeholder")
QUERIES["generalize_text"] = _rewrite_query("generalize")
QUERIES["redact_text"] = _rewrite_query("redact")


@query("placeholder_map")
def placeholder_map(spark, folder):
    found = _found(spark, folder).select("key", F.explode(S.placeholder_map(F.col("findings"))).alias("m"))
    return found.select("key", "m.*")


@query("transform_modes")
def transform_modes(spark, folder):
    """Every mode through the dispatch; ``mask`` is another name of ``placeholder``."""
    out = _found(spark, folder)
    for mode in ("mask", "placeholder", "generalize", "redact"):
        out = S.with_rewritten(out, "text", "findings", mode, mode)
    return out.select("key", *[F.md5(m).alias(m) for m in ("mask", "placeholder", "generalize", "redact")])


def _with_analysis(spark: SparkSession, folder: str) -> DataFrame:
    notes = _note_texts(spark, folder)
    none = F.array().cast(C.CANDIDATE_TYPE)
    return C.with_context_analysis(notes.withColumn("_e", none).withColumn("_s", none), "text", "_e", "_s")


def _with_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _with_analysis(spark, folder).withColumn("candidates", F.col("analysis")["candidates"])


@query("merge_findings")
def merge_findings(spark, folder):
    both = C.with_candidate_findings(S.with_findings(_with_candidates(spark, folder), "text"), "text", "candidates")
    merged = both.withColumn("all", S.merge_findings(F.col("findings"), F.col("candidate_findings")))
    return _spans(S.resolve_column(merged, "all", "merged"), ["key"], "merged").select(
        "key", "rule_id", "span_start", "span_end", "placeholder"
    )


@query("candidate_occurrences")
def candidate_occurrences(spark, folder):
    """Customer short names looked up in the memo of each order."""
    orders = memos(spark, folder)
    surface = F.element_at(F.array(F.lit("契約"), F.lit("月"), F.lit("です。"), F.col("o_custkey").cast("string")), (F.col("o_custkey") % 4 + 1).cast("int"))
    start = (F.col("o_orderkey") % 7).cast("int")
    candidate = F.struct(
        surface.alias("surface"),
        F.when(F.col("o_custkey") % 2 == 0, start).alias("start"),
        (start + F.char_length(surface)).alias("end"),
    )
    hits = C.occurrences(F.col("text"), F.col("candidate"))
    staged = orders.withColumn("candidate", candidate)
    return staged.select("o_orderkey", fixed(hits).alias("hits")).select("o_orderkey", F.explode("hits").alias("o")).select(
        "o_orderkey", F.col("o")["start"].alias("span_start"), F.col("o")["end"].alias("span_end"), F.col("o")["text"].alias("surface")
    )


@query("candidate_findings")
def candidate_findings(spark, folder):
    found = C.with_candidate_findings(_with_candidates(spark, folder), "text", "candidates")
    f = F.col("f")
    return found.select("key", F.explode("candidate_findings").alias("f")).select(
        "key", f["rule_id"].alias("rule_id"), f["start"].alias("span_start"), f["end"].alias("span_end"),
        f["text"].alias("surface"), f["placeholder"].alias("placeholder"), f["id"].alias("id"),
    )


@query("confirmed_rewrite")
def confirmed_rewrite(spark, folder):
    """Only findings of at least 12 characters are selected; the rest stays in the text."""
    found = _found(spark, folder)
    chosen = F.transform(F.filter("findings", lambda f: F.char_length(f["text"]) >= 12), lambda f: f["id"])
    kept = found.withColumn("_ids", chosen).withColumn("chosen", P.select_findings(F.col("findings"), F.col("_ids")))
    return S.transform_text(kept, "text", "chosen", "generalize").select("key", F.md5("rewritten").alias("text_md5"))


# --- score and policy -------------------------------------------------------


def _policy_query(name: str, *columns: Callable[[Column, Column], Column]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        policy = F.col("policy")
        return _judged(spark, folder).select("key", *[c(policy, policy["risk"]) for c in columns])

    QUERIES[name] = run


_policy_query("risk_score", lambda p, r: r["score"].alias("score"))
_policy_query("risk_level", lambda p, r: r["level"].alias("level"))
_policy_query("secret_guard", lambda p, r: r["secret_guard"].alias("secret_guard"))
_policy_query("blocked_flag", lambda p, r: r["blocked"].alias("blocked"))
_policy_query("risk_reasons", lambda p, r: F.array_join(r["reasons"], "|").alias("reasons"))
_policy_query("policy_severity", lambda p, r: p["severity"].alias("severity"))
_policy_query(
    "policy_action",
    lambda p, r: p["action"].alias("action"),
    lambda p, r: p["can_send_raw"].alias("can_send_raw"),
    lambda p, r: p["requires_sanitization"].alias("requires_sanitization"),
    lambda p, r: p["reason"].alias("reason"),
)
_policy_query(
    "policy_split",
    lambda p, r: F.array_join(p["required_ids"], ",").alias("required_ids"),
    lambda p, r: F.array_join(p["optional_ids"], ",").alias("optional_ids"),
)


@query("category_counts")
def category_counts(spark, folder):
    counts = _judged(spark, folder).select("key", F.explode(F.col("policy")["risk"]["category_counts"]).alias("category", "n"))
    return counts


@query("pair_bonus_score")
def pair_bonus_score(spark, folder):
    """Rule findings together with candidates, so that people meet phones and addresses."""
    both = C.with_candidate_findings(S.with_findings(_with_candidates(spark, folder), "text"), "text", "candidates")
    merged = S.resolve_column(both.withColumn("_all", F.concat("findings", "candidate_findings")), "_all", "merged")
    risk = F.col("risk")
    return P.with_risk(merged, "merged").select(
        "key", risk["score"].alias("score"), risk["level"].alias("level"), F.array_join(risk["reasons"], "|").alias("reasons")
    )


@query("paste_verdict")
def paste_verdict(spark, folder):
    action = P.paste_action(F.col("findings"), F.col("policy"))
    return _judged(spark, folder).select("key", action.alias("action"), (action != "sanitize_required").alias("raw_paste_allowed"))


@query("paste_route")
def paste_route(spark, folder):
    judged = _judged(spark, folder)
    hinted = X.with_hint(X.with_signals(judged, "text", "findings"), "text", "signals", "findings")
    route = P.paste_route(P.paste_action(F.col("findings"), F.col("policy")), F.col("hint")["offer"])
    return hinted.select("key", route.alias("route"))


@query("send_review")
def send_review(spark, folder):
    """Messages about to be sent: chat turns, and each order's memo as a message of its customer."""
    turns = read_table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    notes = memos(spark, folder).select(
        F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").cast("long").alias("turn"), F.lit("user").alias("role"), "text"
    )
    judged = P.with_policy(S.with_findings(turns.unionByName(notes), "text"))
    return judged.where(P.needs_send_review(F.col("findings"), F.col("policy"))).select(
        "conv_id", "turn", "role", F.size("findings").alias("n_findings"), F.col("policy")["action"].alias("action")
    )


# --- context layer ----------------------------------------------------------


def _hinted(spark: SparkSession, folder: str) -> DataFrame:
    return X.with_signals(_found(spark, folder), "text", "findings")


@query("context_signals")
def context_signals(spark, folder):
    s = F.col("s")
    return _hinted(spark, folder).select("key", F.explode("signals").alias("s")).select(
        "key", s["start"].alias("span_start"), s["end"].alias("span_end"), s["reason"].alias("reason"), s["score"].alias("score"),
        s["source"].alias("source"),
    )


@query("context_hint")
def context_hint(spark, folder):
    hint = F.col("hint")
    return X.with_hint(_hinted(spark, folder), "text", "signals", "findings").select(
        "key", hint["offer"].alias("offer"), hint["score"].alias("score"), F.array_join(hint["reasons"], ",").alias("reasons")
    )


@query("context_windows")
def context_windows(spark, folder):
    windows = X.with_windows(_hinted(spark, folder), "text")
    return windows.select("key", F.posexplode("windows").alias("position", "w")).select(
        "key", "position", F.col("w")["text"].alias("window_text"), F.col("w")["reason"].alias("reason")
    )


@query("context_input")
def context_input(spark, folder):
    """Small windows, small budget; a text without signals gives its head."""
    windows = X.with_windows(_hinted(spark, folder), "text", max_input_chars=220, window_chars=120)
    return windows.select("key", F.size("windows").alias("n_windows"), X.joined_windows(F.col("windows")).alias("input"))


@query("sentence_segments")
def sentence_segments(spark, folder):
    texts = corpus(spark, folder).select("key", fixed(M.segments(F.col("text"))).alias("s"))
    return texts.select("key", F.posexplode("s").alias("position", "segment"))


def _label_prototypes(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of each label, standing in for the embedded prototype texts."""
    e = read_table(spark, folder, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One vector per label: the group is as large as the vector is long.
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    names = F.array(*[F.lit(p[0]) for p in M.C.PROTOTYPES])
    return vectors.select(
        F.col("label").alias("position"),
        F.coalesce(F.get(names, F.col("label").cast("int")), F.concat(F.lit("label_"), F.col("label").cast("string"))).alias("category"),
        F.transform("v", lambda p: p["x"]).alias("embedding"),
    )


@query("nearest_prototype")
def nearest_prototype(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    found = M.nearest_prototype(vectors, _label_prototypes(spark, folder), min_similarity=0.3, min_margin=0.015)
    return found.select(
        "vec_id", "category", F.round("similarity", 6).alias("similarity"), F.round("margin", 6).alias("margin"), "accepted",
        F.round("confidence", 6).alias("confidence"),
    )


@query("semantic_candidates")
def semantic_candidates(spark, folder):
    """Vectors taken as segments of texts of eight."""
    vectors = read_table(spark, folder, "embeddings")
    found = M.nearest_prototype(vectors, _label_prototypes(spark, folder), min_similarity=0.3, min_margin=0.015)
    staged = found.select(
        F.floor(F.col("vec_id") / 8).alias("text_id"), (F.col("vec_id") % 8).alias("position"),
        F.concat(F.lit("segment "), F.col("vec_id").cast("string")).alias("surface"), "category", "accepted", "confidence",
    )
    out = M.semantic_candidates(staged, ["text_id"])
    return out.select("text_id", "position", "id", "category", "surface", "suggested_placeholder")


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    tokens = D.words_as_tokens(spark, folder)
    turns = read_table(spark, folder, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key")
    return M.entity_candidates(tokens.drop("text"), turns.select(key, "text"), "key")


@query("entity_spans")
def entity_spans(spark, folder):
    return _entities(spark, folder).select(
        "key", "position", "id", "category", "surface", "label", "risk_level", "suggested_placeholder",
        F.round("confidence", 6).alias("confidence"), F.col("start").alias("span_start"), F.col("end").alias("span_end"),
    )


@query("residual_entities")
def residual_entities(spark, folder):
    t = F.col("t")
    texts = corpus(spark, folder).select("key", fixed(C.residual_entity_terms(F.col("text"))).alias("terms"))
    return texts.select("key", F.explode("terms").alias("t")).select(
        "key", t["surface"].alias("surface"), t["category"].alias("category"), t["prefix"].alias("prefix"), t["confidence"].alias("confidence")
    )


@query("residual_business")
def residual_business(spark, folder):
    t = F.col("t")
    texts = corpus(spark, folder).select("key", fixed(C.residual_business_terms(F.col("text"))).alias("terms"))
    return texts.select("key", F.explode("terms").alias("t")).select(
        "key", t["surface"].alias("surface"), t["category"].alias("category"), t["confidence"].alias("confidence")
    )


@query("residual_terms")
def residual_terms(spark, folder):
    terms = corpus(spark, folder).withColumn("terms", fixed(C.residual_terms(F.col("text"))))
    return terms.select("key", F.posexplode("terms").alias("position", "t")).select(
        "key", "position", F.col("t")["prefix"].alias("prefix"), F.col("t")["surface"].alias("surface")
    )


def _given_candidates(text: Column) -> Column:
    """Model candidates for a memo: its whole head as legal info, and one name."""

    def candidate(name: str, category: str, surface: Column):
        return F.struct(
            F.lit(name).alias("id"), F.lit(category).alias("category"), surface.alias("surface"), F.lit("l").alias("label"),
            F.lit("r").alias("reason"), F.lit("medium").alias("risk_level"), F.lit("[X_1]").alias("suggested_placeholder"),
            F.lit(0.9).alias("confidence"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
        )

    return F.array(
        candidate("m1", "legal_info", F.substring(text, 1, 40)),
        candidate("m2", "person_name", F.lit("山田 花子")),
        candidate("m3", "company_name", F.lit("Ａ社")),
    ).cast(C.CANDIDATE_TYPE)


@query("residual_merge")
def residual_merge(spark, folder):
    notes = _note_texts(spark, folder)
    staged = notes.withColumn("_t", fixed(C.residual_terms(F.col("text")))).withColumn("_c", _given_candidates(F.col("text")))
    merged = staged.withColumn("m", fixed(C.merge_residual(F.col("_c"), F.col("_t"))))
    c = F.col("c")
    return merged.select("key", F.posexplode("m").alias("position", "c")).select(
        "key", "position", c["id"].alias("id"), c["category"].alias("category"), c["surface"].alias("surface"),
        c["suggested_placeholder"].alias("suggested_placeholder"),
    )


@query("candidate_distinct")
def candidate_distinct(spark, folder):
    packed = M.gather_candidates(_entities(spark, folder), ["key"])
    doubled = packed.withColumn("twice", F.concat("candidates", "candidates"))
    return doubled.select("key", F.posexplode(C.distinct_candidates(F.col("twice"))).alias("position", "c")).select(
        "key", "position", F.col("c")["id"].alias("id"), F.col("c")["surface"].alias("surface")
    )


@query("context_analysis")
def context_analysis(spark, folder):
    """Each customer's memos with both, one or none of the models at hand."""
    notes = memos(spark, folder)
    given = _given_candidates(F.col("text"))
    staged = notes.withColumn("_e", F.when(F.col("o_custkey") % 4 < 2, F.slice(given, 2, 2))).withColumn(
        "_s", F.when(F.col("o_custkey") % 2 == 0, F.slice(given, 1, 1))
    )
    a = F.col("analysis")
    return C.with_context_analysis(staged, "text", "_e", "_s").select(
        "o_orderkey", F.size(a["candidates"]).alias("n_candidates"), a["summary"].alias("summary"), a["error"].alias("error"),
        F.array_join(a["warnings"], "|").alias("warnings"),
        F.array_join(F.transform(a["candidates"], lambda c: c["id"]), ",").alias("ids"),
    )


@query("result_message")
def result_message(spark, folder):
    return _with_candidates(spark, folder).select("key", C.result_message(F.col("candidates")).alias("message"))


# --- reports ----------------------------------------------------------------


@query("findings_summary")
def findings_summary(spark, folder):
    counts = S.summary(F.col("findings"))
    return _found(spark, folder).select("key", *[counts[c].alias(c) for c in ("total", "critical", "high", "medium", "low")])


@query("findings_by_rule")
def findings_by_rule(spark, folder):
    return _found(spark, folder).select("key", F.explode(S.summary(F.col("findings"))["by_rule"]).alias("rule_id", "n"))


@query("highest_risk")
def highest_risk(spark, folder):
    return _found(spark, folder).select("key", S.highest_risk(F.col("findings")).alias("highest_risk"))


@query("category_groups")
def category_groups(spark, folder):
    groups = P.category_groups(_judged(spark, folder), ["key"])
    return groups.select(
        "key", "position", "category", "label", "required", "n_findings", "risk_level", F.array_join("finding_ids", ",").alias("finding_ids")
    )


@query("label_counts")
def label_counts(spark, folder):
    return R.label_counts(_found(spark, folder))


@query("risk_meter")
def risk_meter(spark, folder):
    return _judged(spark, folder).select("key", P.risk_meter(S.summary(F.col("findings")), F.col("policy")).alias("m")).select("key", "m.*")


@query("risk_tiles")
def risk_tiles(spark, folder):
    return _found(spark, folder).select("key", P.risk_tiles(S.summary(F.col("findings"))).alias("t")).select("key", "t.*")


@query("selection_complete")
def selection_complete(spark, folder):
    """Selecting findings of at least 12 characters: is every required one among them?"""
    judged = _judged(spark, folder)
    chosen = F.transform(F.filter("findings", lambda f: F.char_length(f["text"]) >= 12), lambda f: f["id"])
    staged = judged.withColumn("chosen", chosen)
    button = P.send_button(F.col("findings"), F.col("policy"), F.col("chosen"))
    return staged.select(
        "key", P.selection_complete(F.col("policy")["required_ids"], F.col("chosen")).alias("complete"), button["text"].alias("button")
    )


@query("privacy_report")
def privacy_report(spark, folder):
    judged = _judged(spark, folder).withColumn("kind", F.substring_index("key", ":", 1))
    return R.privacy_safe_report(judged, ["kind"])


@query("diagnostics")
def diagnostics(spark, folder):
    return R.diagnostics(D.installs(spark, folder), "c_custkey")


@query("user_agents")
def user_agents(spark, folder):
    agents = read_table(spark, folder, "events").select(F.expr(D.USER_AGENT_SQL).alias("ua"))
    named = agents.select(R.browser_of(F.col("ua")).alias("browser"), R.os_of(F.col("ua")).alias("os"))
    return named.groupBy("browser", "os").agg(F.count(F.lit(1)).alias("n"))


# --- rule bundles -----------------------------------------------------------


@query("bundle_rules")
def bundle_rules(spark, folder):
    r = F.col("r")
    return B.with_clean_payload(D.bundles(spark, folder)).select("p_partkey", F.posexplode("rules").alias("position", "r")).select(
        "p_partkey", "position", r["id"].alias("id"), r["label"].alias("label"), r["category"].alias("category"),
        r["message"].alias("message"), F.round(r["confidence"], 6).alias("confidence"), B.rule_is_valid(r).alias("valid"),
    )


@query("bundle_valid")
def bundle_valid(spark, folder):
    return B.with_clean_payload(D.bundles(spark, folder)).select("p_partkey", "payload_valid")


def _now() -> Column:
    return F.timestamp_millis(F.lit(D.NOW_MS))


@query("bundle_time")
def bundle_time(spark, folder):
    return B.with_clean_payload(D.bundles(spark, folder)).select("p_partkey", B.temporal_reason(_now()).alias("reason"))


@query("bundle_verdict")
def bundle_verdict(spark, folder):
    keyed = B.with_known_key(B.with_clean_payload(D.bundles(spark, folder)), D.signing_keys(spark, folder))
    return B.with_verdict(keyed, _now()).select("p_partkey", "reason", "admitted")


@query("bundle_keys")
def bundle_keys(spark, folder):
    keyed = B.with_known_key(D.bundles(spark, folder), D.signing_keys(spark, folder), expected_key_id="key-3")
    return keyed.select("p_partkey", "keyId", "key_known", "key_expected")


@query("rule_delivery")
def rule_delivery(spark, folder):
    return B.delivery_outcome(D.fetch_attempts(spark, folder), D.cache_rows(spark, folder), D.NOW_MS)


@query("rule_delivery_as_of")
def rule_delivery_as_of(spark, folder):
    """Each fetch with the cache entry that was the newest at its moment."""
    return B.delivery_outcome_as_of(D.attempts_over_time(spark, folder), D.cache_rows(spark, folder))


@query("bundle_cache_rows")
def bundle_cache_rows(spark, folder):
    return D.stored_cache_entries(spark, folder).select("o_orderkey", B.cache_row_is_valid().alias("valid"))


# --- logs and line scan -----------------------------------------------------


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        "event_id", F.expr(D.MESSAGE_SQL).alias("message"), F.expr(D.SOURCE_SQL).alias("source_text")
    )


@query("log_scrub")
def log_scrub(spark, folder):
    return _messages(spark, folder).select("event_id", L.scrub_detail(F.col("message")).alias("detail"))


@query("log_scrub_with_source")
def log_scrub_with_source(spark, folder):
    m = _messages(spark, folder)
    return m.select("event_id", L.scrub_display(F.col("message"), F.col("source_text")).alias("message"))


@query("safe_detail")
def safe_detail(spark, folder):
    m = _messages(spark, folder)
    return m.select("event_id", L.safe_detail(F.col("message"), F.col("source_text")).alias("detail"))


@query("error_triage")
def error_triage(spark, folder):
    return _messages(spark, folder).select("event_id", L.triage(F.col("message")).alias("kind"))


def _source_files(spark: SparkSession, folder: str) -> DataFrame:
    notes = memos(spark, folder)
    path = F.concat(
        F.lit("src/"),
        F.element_at(F.array(*[F.lit(x) for x in ("a.ts", "dist/b.js", "c.log", "d.md", "e.png")]), (F.col("o_custkey") % 5 + 1).cast("int")),
    )
    return notes.select(
        F.when(F.col("o_custkey") % 5 == 2, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"), F.lit(".log")))
        .otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), path)).alias("path"),
        "text",
    )


@query("line_scan")
def line_scan(spark, folder):
    return L.line_scan(_source_files(spark, folder))


@query("line_scan_allowed")
def line_scan_allowed(spark, folder):
    """The same memos with an allow table: keys of orders that are finished."""
    done = read_table(spark, folder, "orders").where("o_orderstatus = 'F'")
    allowed = done.select(F.concat(F.lit("AKIA"), F.lpad(F.col("o_orderkey").cast("string"), 16, "0")).alias("value"))
    return L.line_scan(_source_files(spark, folder), allowed=allowed)


# --- evaluation -------------------------------------------------------------


@query("fixture_evaluation")
def fixture_evaluation(spark, folder):
    return E.evaluate(D.text_fixtures(spark, folder).drop("o_orderkey"))


@query("fixture_repeated_ids")
def fixture_repeated_ids(spark, folder):
    return E.repeated_ids(D.text_fixtures(spark, folder))


@query("catalogue_check")
def catalogue_check(spark, folder):
    """Rules and prefixes seen in the corpus against the catalogue."""
    seen = R.exploded(_found(spark, folder, select_rules(disabled_ids=["jwt"])), ["key"]).select(
        "rule_id", F.regexp_extract("placeholder", "^\\[(.*)_[0-9]+\\]\\z", 1).alias("prefix")
    )
    return E.check_catalogue(E.catalogue(spark), seen.distinct())


@query("catalogue_order")
def catalogue_order(spark, folder):
    """The rule list of each supplier against the catalogue, order included."""
    return E.check_catalogue_order(E.catalogue(spark), D.documented_catalogues(spark, folder), "s_suppkey")


# --- streaming --------------------------------------------------------------


@query("stream_scan")
def stream_scan(spark, folder):
    """Chat turns as a file stream, run to its end; the result is the written table."""
    schema = read_table(spark, folder, "conversations").schema
    # The table may be one file or a folder of files. A stream takes a plain path for a folder, but a glob for either.
    stream = spark.readStream.schema(schema).parquet(f"{folder}/conversations.parque[t]")
    target, state = work_folder(spark, "stream-out"), work_folder(spark, "stream-state")
    start_scan(stream, "text", target, state).awaitTermination()
    return spark.read.parquet(target).select(
        "conv_id", "turn", "role", "n_findings", "action", "severity", "score", "needs_review", F.md5("safe_text").alias("safe_md5")
    )


@query("stream_reload")
def stream_reload(spark, folder):
    """Memos as a stream of two batches; a second version of the rules is published in between and takes effect at once."""
    source, target, state, rules = (work_folder(spark, n) for n in ("messages", "stream-out", "stream-state", "rules"))
    notes = memos(spark, folder)
    versions = [["email", "phone", "amount"], ["email", "amount", "date", "url", "aws_access_key"]]
    for number, ids in enumerate(versions):
        publish_rules(spark, rules, number + 1, select_rules(enabled_ids=ids))
        notes.where(F.col("o_orderkey") % 2 == number).write.mode("append").parquet(source)
        stream = spark.readStream.schema(notes.schema).parquet(source)
        start_versioned_scan(stream, "text", target, state, rules).awaitTermination()
    return spark.read.parquet(target).select("o_orderkey", "rules_version", "n_findings", "action", F.md5("safe_text").alias("safe_md5"))


__all__ = ["QUERIES"]
