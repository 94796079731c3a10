"""The corpus scan: text in, findings and rewritten text out, one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import REDACTED_LABEL, RISK_RANK
from ..functions.lets import fixed
from ..functions.rules import TextRule, all_findings, select_rules
from ..functions.scoring import category_of, generalized_label
from ..functions.spans import (
    FINDINGS_TYPE,
    cut,
    empty,
    has_marks,
    number_placeholders,
    resolve_overlaps,
    rewrite,
    text_chunks,
    without_marks,
)

TRANSFORM_MODES = ("placeholder", "generalize", "redact")


def raw_findings(df: DataFrame, text: str, rules: list[TextRule] | None = None, out: str = "hits") -> DataFrame:
    """All hits of all rules, before overlaps are settled."""
    rules = select_rules() if rules is None else rules
    if not rules:
        return df.withColumn(out, empty(FINDINGS_TYPE))
    staged = df.withColumn("_marks", has_marks(F.col(text))).withColumn("_match", without_marks(F.coalesce(F.col(text), F.lit(""))))
    staged = staged.withColumn(out, fixed(all_findings(F.col("_match"), rules)))
    # Where the text itself holds a mark, spell the surface out of the original.
    true_surface = F.transform(
        F.col(out),
        lambda f: f.withField("text", F.substring(F.col(text), f["start"] + 1, f["end"] - f["start"])),
    )
    return staged.withColumn(
        out, F.when(F.col("_marks"), true_surface).otherwise(F.col(out))
    ).drop("_match", "_marks")


def resolve_column(df: DataFrame, hits: str, out: str = "findings") -> DataFrame:
    """Settle overlaps, then number the placeholders, each in its own projection."""
    return df.withColumn("_kept", fixed(resolve_overlaps(F.col(hits)))).withColumn(
        out, fixed(number_placeholders(F.col("_kept")))
    ).drop("_kept")


def with_findings(
    df: DataFrame,
    text: str,
    rules: list[TextRule] | None = None,
    out: str = "findings",
    disabled: str | None = None,
) -> DataFrame:
    """Settled and numbered findings of a text column.

    ``disabled`` names an array column of rule ids that are off for that row.
    """
    hits = raw_findings(df, text, rules, "_hits")
    if disabled is not None:
        hits = hits.withColumn(
            "_hits", F.filter("_hits", lambda h: ~F.array_contains(F.col(disabled), h["rule_id"]))
        )
    return resolve_column(hits, "_hits", out).drop("_hits")


def resolve_mode(mode: str) -> str:
    resolved = "placeholder" if mode == "mask" else mode
    if resolved not in TRANSFORM_MODES:
        raise ValueError(f"unknown transform mode: {mode}")
    return resolved


def relabel(findings: Column, mode: str) -> Column:
    """Findings with the replacement text of a transform mode as placeholder."""
    resolved = resolve_mode(mode)
    if resolved == "generalize":
        return F.transform(findings, lambda f: f.withField("placeholder", generalized_label(category_of(f))))
    if resolved == "redact":
        return F.transform(findings, lambda f: f.withField("placeholder", F.lit(REDACTED_LABEL)))
    return findings


def with_rewritten(
    df: DataFrame, text: str, findings: str, mode: str = "placeholder", out: str = "rewritten"
) -> DataFrame:
    """Rewrite a text with findings that are already resolved and numbered."""
    return (
        df.withColumn("_chunks", text_chunks(F.col(text)))
        .withColumn("_labelled", relabel(F.col(findings), mode))
        .withColumn(out, rewrite(F.col("_chunks"), F.char_length(F.col(text)), F.col("_labelled")))
        .drop("_chunks", "_labelled")
    )


def transform_text(
    df: DataFrame, text: str, findings: str, mode: str = "mask", out: str = "rewritten"
) -> DataFrame:
    """Rewrite a text with any findings: they are settled and numbered first."""
    staged = resolve_column(df, findings, "_resolved")
    return with_rewritten(staged, text, "_resolved", mode, out).drop("_resolved")


def placeholder_map(findings: Column) -> Column:
    """Placeholder, original, label and risk. Holds raw text: opt-in output only."""
    return F.transform(
        findings,
        lambda f: F.struct(
            f["placeholder"].alias("placeholder"),
            f["text"].alias("original_text"),
            f["label"].alias("label"),
            f["risk_level"].alias("risk_level"),
        ),
    )


def summary(findings: Column) -> Column:
    """Counts in total, per risk level and per rule."""

    def at_level(level: str) -> Column:
        return F.size(F.filter(findings, lambda f: f["risk_level"] == level)).alias(level)

    ids = F.transform(findings, lambda f: f["rule_id"])
    distinct = F.array_distinct(ids)
    by_rule = F.map_from_arrays(
        distinct, F.transform(distinct, lambda r: F.size(F.filter(ids, lambda x: x == r)))
    )
    return F.struct(
        F.size(findings).alias("total"), *[at_level(level) for level in reversed(RISK_RANK)], by_rule.alias("by_rule")
    )


def highest_risk(findings: Column) -> Column:
    """Strongest risk level present, or null."""
    levels = F.transform(findings, lambda f: f["risk_level"])
    out = F.lit(None).cast("string")
    for level in RISK_RANK:
        out = F.when(F.array_contains(levels, level), level).otherwise(out)
    return out


def merge_findings(left: Column, right: Column) -> Column:
    """Both sets in one; settle with :func:`resolve_column`."""
    return F.concat(left, right)


def scan(
    df: DataFrame,
    text: str,
    rules: list[TextRule] | None = None,
    mode: str = "placeholder",
    keep_placeholder_map: bool = False,
) -> DataFrame:
    """Full scan of a text column: findings, summary, highest risk, rewritten text."""
    found = with_findings(df, text, rules)
    out = (
        with_rewritten(found, text, "findings", mode, "rewritten")
        .withColumn("summary", summary(F.col("findings")))
        .withColumn("highest_risk", highest_risk(F.col("findings")))
    )
    return out.withColumn("placeholder_map", placeholder_map(F.col("findings"))) if keep_placeholder_map else out


__all__ = [
    "TRANSFORM_MODES", "cut", "highest_risk", "merge_findings", "placeholder_map", "raw_findings",
    "relabel", "resolve_column", "resolve_mode", "scan", "summary", "transform_text",
    "with_findings", "with_rewritten",
]
