"""Counts over findings, free of any raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import RISK_RANK, SETTINGS_VERSION
from .settings import normal_mode, normal_rules, normal_sites

REPORT_TEXT_FIELDS = ("text", "original_text", "rewritten", "findings", "placeholder_map", "url", "html")


def exploded(df: DataFrame, keys: list[str], findings: str = "findings") -> DataFrame:
    """One row per finding."""
    return df.select(*keys, F.explode(findings).alias("f")).select(*keys, "f.*")


def label_counts(df: DataFrame, findings: str = "findings") -> DataFrame:
    """Findings per label; a handful of keys, combined before the shuffle."""
    return df.select(F.explode(F.transform(F.col(findings), lambda f: f["label"])).alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )


def privacy_safe_report(scanned: DataFrame, by: list[str]) -> DataFrame:
    """Counts and flags of scanned texts per group. Needs ``findings`` and ``policy``."""
    found, policy = F.col("findings"), F.col("policy")
    levels = [F.sum(_level_count(found, level)).alias(f"n_{level}") for level in RISK_RANK]
    out = scanned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.size(found) > 0).alias("n_texts_with_findings"),
        F.sum(F.size(found)).alias("n_findings"),
        *levels,
        F.count_if(policy["action"] == "allow").alias("n_allow"),
        F.count_if(policy["action"] == "confirm").alias("n_confirm"),
        F.count_if(policy["action"] == "sanitize_required").alias("n_sanitize"),
        F.max(policy["risk"]["score"]).alias("max_score"),
    )
    return without_text(out)


def _level_count(findings: Column, level: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["risk_level"] == level))


def without_text(report: DataFrame) -> DataFrame:
    """Refuse a report that would carry text, findings, a placeholder map or an address."""
    leaking = [c for c in report.columns if c in REPORT_TEXT_FIELDS]
    if leaking:
        raise ValueError(f"report would expose {leaking}")
    return report


def browser_of(user_agent: Column) -> Column:
    chrome = F.regexp_extract(user_agent, "(?:Chrome|Chromium)/([0-9.]+)", 1)
    edge = F.regexp_extract(user_agent, "Edg/([0-9.]+)", 1)
    return (
        F.when(chrome != "", F.concat(F.lit("Chrome "), chrome))
        .when(edge != "", F.concat(F.lit("Edge "), edge))
        .otherwise("unknown")
    )


def os_of(user_agent: Column) -> Column:
    low = F.lower(user_agent)
    return (
        F.when(F.contains(low, F.lit("windows nt")), "Windows")
        .when(F.contains(low, F.lit("mac os x")), "macOS")
        .when(F.contains(low, F.lit("android")), "Android")
        .when(F.rlike(low, F.lit("iphone|ipad|ipod")), "iOS")
        .when(F.contains(low, F.lit("linux")), "Linux")
        .otherwise("unknown")
    )


def diagnostics(installs: DataFrame, key: str) -> DataFrame:
    """Environment and settings of an installation, as names, counts and flags only.

    Needs ``user_agent``, ``enabled``, ``sites``, ``rules`` and ``mode``.
    """
    staged = installs.withColumn("_sites", normal_sites(F.col("sites"))).withColumn(
        "_rules", normal_rules(F.col("rules"))
    )

    def sites(on: bool) -> Column:
        return F.array_join(F.map_keys(F.map_filter(F.col("_sites"), lambda _, v: v == F.lit(on))), ",")

    def rules(on: bool) -> Column:
        return F.size(F.map_filter(F.col("_rules"), lambda _, v: v == F.lit(on)))

    return without_text(
        staged.select(
            key,
            F.lit(SETTINGS_VERSION).alias("settings_version"),
            browser_of(F.col("user_agent")).alias("browser"),
            os_of(F.col("user_agent")).alias("os"),
            "enabled",
            sites(True).alias("enabled_sites"),
            sites(False).alias("disabled_sites"),
            normal_mode(F.col("mode")).alias("mode"),
            rules(True).alias("n_enabled_rules"),
            rules(False).alias("n_disabled_rules"),
            F.lit(False).alias("includes_user_text"),
            F.lit(False).alias("includes_findings"),
            F.lit(False).alias("includes_placeholder_map"),
            F.lit(False).alias("includes_page_url"),
        )
    )
