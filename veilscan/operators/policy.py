"""Policy decisions over findings, and the verdicts built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import (
    CATEGORY_GROUP_LABEL,
    DECISION_LABEL,
    METER_STATUS_LABEL,
    METER_STATUS_TEXT,
    METER_WEIGHT,
    POLICY_REASON,
    RISK_LABEL,
    RISK_RANK,
    SEVERITY_BY_RANK,
)
from ..functions.lets import either, fixed, let, literal_array, lookup
from ..functions.lists import is_in
from ..functions.scoring import category_of, decision_rank, risk_score
from ..functions.spans import risk_rank


def with_risk(df: DataFrame, findings: str = "findings", out: str = "risk", block_at_level: str = "high") -> DataFrame:
    return (
        df.withColumn("_categories", fixed(F.transform(F.col(findings), category_of)))
        .withColumn(out, fixed(risk_score(F.col(findings), F.col("_categories"), block_at_level)))
        .drop("_categories")
    )


def needs_sanitizing(finding: Column) -> Column:
    return finding["risk_level"].isin("critical", "high") | (category_of(finding) == "secret")


def _ids(findings: Column) -> Column:
    return F.transform(findings, lambda f: f["id"])


def _without(ids: Column, others: Column) -> Column:
    return let(is_in(ids, others), lambda hit: F.filter(ids, lambda _, i: ~F.get(hit, i)))


def with_policy(df: DataFrame, findings: str = "findings", out: str = "policy") -> DataFrame:
    """Action, severity, and which findings must or may be rewritten."""
    found = F.col(findings)
    risk = F.col("_risk")
    must = F.col("_must")
    staged = with_risk(df, findings, "_risk").withColumn("_must", F.filter(found, needs_sanitizing))
    sanitize = risk["blocked"] | (F.size(must) > 0)
    action = (
        F.when(sanitize, "sanitize_required").when(risk["level"] == "medium", "confirm").otherwise("allow")
    )
    strongest = F.greatest(
        decision_rank(risk["level"]),
        F.coalesce(F.array_max(F.transform(found, lambda f: risk_rank(f["risk_level"]))), F.lit(0)),
    )
    required = either(F.size(must) > 0, _ids(must), _ids(found))
    none = F.array().cast("array<string>")
    staged = staged.withColumn("_action", action).withColumn(
        "_required", either(sanitize, required, none)
    )
    act = F.col("_action")
    return staged.withColumn(
        out,
        fixed(F.struct(
            act.alias("action"),
            F.element_at(literal_array(SEVERITY_BY_RANK), strongest + 1).alias("severity"),
            lookup(POLICY_REASON, act).alias("reason"),
            F.col("_required").alias("required_ids"),
            F.when(~sanitize, _ids(found)).when(F.size(must) == 0, none).otherwise(_without(_ids(found), F.col("_required")))
            .alias("optional_ids"),
            (act != "sanitize_required").alias("can_send_raw"),
            (act == "sanitize_required").alias("requires_sanitization"),
            risk.alias("risk"),
            lookup(POLICY_REASON, act).alias("message"),
        )),
    ).drop("_risk", "_must", "_action", "_required")


def paste_action(findings: Column, policy: Column) -> Column:
    """What a guarded paste does; anything but sanitizing lets the raw text through."""
    return (
        F.when((F.size(findings) == 0) | (policy["action"] == "allow"), "allow")
        .when(policy["requires_sanitization"], "sanitize_required")
        .otherwise("confirm")
    )


def paste_route(paste: Column, offer_context: Column, context_enabled: bool | Column = True) -> Column:
    """Which review a paste goes to: guard, plain review, context check or none."""
    enabled = F.lit(context_enabled) if isinstance(context_enabled, bool) else context_enabled
    return (
        F.when(paste == "sanitize_required", "paste_guard")
        .when(paste == "confirm", "default")
        .when(enabled & offer_context, "context_check")
        .otherwise("allow")
    )


def needs_send_review(findings: Column, policy: Column) -> Column:
    return (F.size(findings) > 0) & (policy["action"] != "allow")


def risk_label(level: Column) -> Column:
    return lookup(RISK_LABEL, level)


def decision_label(level: Column) -> Column:
    return lookup(DECISION_LABEL, level)


def group_label(category: Column) -> Column:
    return lookup(CATEGORY_GROUP_LABEL, category)


def category_groups(df: DataFrame, keys: list[str], findings: str = "findings", policy: str = "policy") -> DataFrame:
    """One row per text, category and required flag.

    Groups live within one row's findings, so they are built in the row; the
    rank column gives the display order (required first, then risk, then label).
    """
    found = let(
        is_in(_ids(F.col(findings)), F.col(policy)["required_ids"]),
        lambda required: F.transform(
            F.col(findings),
            lambda f, i: F.struct(
                category_of(f).alias("category"),
                F.get(required, i).alias("required"),
                risk_rank(f["risk_level"]).alias("rank"),
                f["id"].alias("id"),
            ),
        ),
    )
    staged = df.withColumn("_found", fixed(found))
    key = F.transform(F.col("_found"), lambda f: F.struct(f["category"].alias("category"), f["required"].alias("required")))
    groups = F.transform(
        F.array_distinct(key),
        lambda k: F.struct(
            (~k["required"]).cast("int").alias("order_required"),
            (
                -F.array_max(
                    F.transform(
                        F.filter(F.col("_found"), lambda f: (f["category"] == k["category"]) & (f["required"] == k["required"])),
                        lambda f: f["rank"],
                    )
                )
            ).alias("order_risk"),
            lookup(CATEGORY_GROUP_LABEL, k["category"]).alias("label"),
            k["category"].alias("category"),
            k["required"].alias("required"),
            F.transform(
                F.filter(F.col("_found"), lambda f: (f["category"] == k["category"]) & (f["required"] == k["required"])),
                lambda f: f["id"],
            ).alias("finding_ids"),
        ),
    )
    out = staged.select(*keys, F.posexplode(F.array_sort(groups)).alias("position", "g"))
    levels = literal_array(list(RISK_RANK))
    return out.select(
        *keys,
        (F.col("position") + 1).alias("position"),
        F.col("g")["category"].alias("category"),
        F.col("g")["label"].alias("label"),
        F.col("g")["required"].alias("required"),
        F.size(F.col("g")["finding_ids"]).alias("n_findings"),
        F.element_at(levels, -F.col("g")["order_risk"]).alias("risk_level"),
        F.col("g")["finding_ids"].alias("finding_ids"),
    )


def selection_complete(required_ids: Column, selected_ids: Column) -> Column:
    """Whether every required finding has been selected."""
    return F.size(F.array_except(required_ids, selected_ids)) == 0


def select_findings(findings: Column, selected_ids: Column) -> Column:
    return let(is_in(_ids(findings), selected_ids), lambda chosen: F.filter(findings, lambda _, i: F.get(chosen, i)))


def risk_meter(summary: Column, policy: Column) -> Column:
    """Meter of the report: strongest risk, width in percent and status."""
    width = F.lit(0)
    for level, weight in METER_WEIGHT.items():
        width = width + summary[level] * weight
    strongest = F.lit("low")
    for level in ["medium", "high", "critical"]:
        strongest = either(summary[level] > 0, level, strongest)
    status = (
        F.when(summary["total"] == 0, "empty")
        .when(policy["requires_sanitization"], "sanitize")
        .when(policy["action"] == "confirm", "confirm")
        .otherwise("low")
    )
    return F.struct(
        strongest.alias("meter_risk"),
        F.least(width, F.lit(100)).alias("meter_width"),
        lookup(METER_STATUS_LABEL, status).alias("status_label"),
        lookup(METER_STATUS_TEXT, status).alias("status_text"),
    )


def risk_tiles(summary: Column) -> Column:
    return F.struct(
        (summary["high"] + summary["critical"]).alias("high"),
        summary["medium"].alias("medium"),
        summary["low"].alias("low"),
    )


def send_button(findings: Column, policy: Column, selected_ids: Column) -> Column:
    """Label and lock of the submit button for a selection."""
    chosen = F.size(select_findings(findings, selected_ids))
    return F.struct(
        either(policy["can_send_raw"] & (chosen == 0), "そのまま送信", "安全化して送信").alias("text"),
        (~selection_complete(policy["required_ids"], selected_ids)).alias("disabled"),
    )
