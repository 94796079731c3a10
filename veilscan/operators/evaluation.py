"""Evaluation of the scan against fixtures, and the rule catalogue check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import RULES
from .policy import with_policy
from .scan import summary, with_findings, with_rewritten

CHECKS = [
    "summary_ok", "includes_ok", "excludes_ok", "policy_ok", "generalized_includes_ok", "generalized_excludes_ok",
    "masked_includes_ok", "masked_excludes_ok",
]


def _agrees(expected: Column, actual: Column) -> Column:
    """A missing expectation agrees with anything."""
    return expected.isNull() | F.coalesce(expected == actual, F.lit(False))


def _all_in(expected: Column, actual: Column) -> Column:
    return expected.isNull() | (F.size(F.array_except(expected, actual)) == 0)


def _none_in(unwanted: Column, actual: Column) -> Column:
    return unwanted.isNull() | ~F.arrays_overlap(unwanted, actual)


def _all_within(expected: Column, text: Column) -> Column:
    return expected.isNull() | F.forall(expected, lambda e: F.contains(text, e))


def _none_within(unwanted: Column, text: Column) -> Column:
    return unwanted.isNull() | ~F.exists(unwanted, lambda e: F.contains(text, e))


def evaluate(fixtures: DataFrame) -> DataFrame:
    """Scan each fixture's input and compare with what it expects, one row per fixture."""
    scanned = with_policy(with_findings(fixtures, "input"))
    scanned = with_rewritten(scanned, "input", "findings", "generalize", "_general")
    scanned = with_rewritten(scanned, "input", "findings", "mask", "_masked").withColumn(
        "_summary", summary(F.col("findings"))
    )
    want, counts, policy = F.col("expect"), F.col("_summary"), F.col("policy")
    ids = F.transform(F.col("findings"), lambda f: f["rule_id"])
    checks = {
        "summary_ok": _every([_agrees(want["summary"][k], counts[k]) for k in ("total", "critical", "high", "medium", "low")]),
        "includes_ok": _all_in(want["includesRuleIds"], ids),
        "excludes_ok": _none_in(want["excludesRuleIds"], ids),
        "policy_ok": _every([
            _agrees(want["policy"]["action"], policy["action"]),
            _agrees(want["policy"]["severity"], policy["severity"]),
            _agrees(want["policy"]["canSendRaw"], policy["can_send_raw"]),
            _agrees(want["policy"]["requiresSanitization"], policy["requires_sanitization"]),
        ]),
        "generalized_includes_ok": _all_within(want["generalizedIncludes"], F.col("_general")),
        "generalized_excludes_ok": _none_within(want["generalizedExcludes"], F.col("_general")),
        "masked_includes_ok": _all_within(want["maskedIncludes"], F.col("_masked")),
        "masked_excludes_ok": _none_within(want["maskedExcludes"], F.col("_masked")),
    }
    out = scanned.select(
        "id",
        "category",
        *[F.coalesce(check, F.lit(False)).alias(name) for name, check in checks.items()],
        counts["total"].alias("total"),
        policy["action"].alias("action"),
        policy["severity"].alias("severity"),
    )
    return out.withColumn("passed", _every([F.col(c) for c in CHECKS]))


def _every(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def repeated_ids(fixtures: DataFrame, key: str = "id") -> DataFrame:
    return fixtures.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def catalogue(spark) -> DataFrame:
    """The bundled rules as a table."""
    return spark.createDataFrame(
        [(i + 1, r.id, r.label, r.risk_level, r.prefix, r.category) for i, r in enumerate(RULES)],
        "position int, rule_id string, label string, risk_level string, prefix string, category string",
    )


def longest_run(positions: Column) -> Column:
    """A longest rising run of distinct positions, the one that ends first among equals; for the few entries of a catalogue."""
    chains = "array<array<int>>"

    def step(ends: Column, x: Column) -> Column:
        below = F.filter(ends, lambda c: F.element_at(c, -1) < x)
        longest = F.aggregate(below, F.array().cast("array<int>"), lambda best, c: F.when(F.size(c) > F.size(best), c).otherwise(best))
        return F.concat(ends, F.array(F.concat(longest, F.array(x))))

    every = F.aggregate(positions, F.array().cast(chains), step)
    return F.aggregate(every, F.array().cast("array<int>"), lambda best, c: F.when(F.size(c) > F.size(best), c).otherwise(best))


def check_catalogue_order(known: DataFrame, documented: DataFrame, group: str) -> DataFrame:
    """Per documented catalogue (``group``), rules that are repeated, unknown, missing, or moved.

    ``known`` has ``position`` and ``rule_id``; ``documented`` has ``group``, ``position`` and ``rule_id``, in an order of its own. A rule is
    moved if it is not in the longest run of rules (first mentions) that keep the order of the known ones.
    """
    mentions = documented.groupBy(group, "rule_id").agg(F.count(F.lit(1)).alias("_n"), F.min("position").alias("_at"))
    catalogue = known.agg(F.collect_list(F.struct("rule_id", F.col("position").cast("int").alias("_known"))))
    wanted = documented.select(group).distinct().select(group, F.inline(catalogue.scalar()))
    both = wanted.join(mentions, [group, "rule_id"], "full_outer")
    # As many entries as the catalogue has rules.
    order = both.where("_n IS NOT NULL AND _known IS NOT NULL").groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_known"))), lambda m: m["_known"]).alias("_order")
    )
    order = order.select(group, longest_run(F.col("_order")).alias("_run"))
    out = both.join(order, group, "left")
    problem = (
        F.when(F.col("_known").isNull(), "unknown rule")
        .when(F.col("_n").isNull(), "not documented")
        .when(F.col("_n") > 1, "repeated id")
        .when(~F.array_contains("_run", F.col("_known")), "moved")
    )
    return out.select(group, "rule_id", problem.alias("problem")).where("problem IS NOT NULL")


def check_catalogue(known: DataFrame, documented: DataFrame) -> DataFrame:
    """Rules that are repeated, missing on one side, or documented with another prefix.

    Both sides carry ``rule_id`` and ``prefix``.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("rule_id").agg(
            F.count(F.lit(1)).alias(f"n_{name}"), F.min("prefix").alias(f"prefix_{name}")
        )

    both = counted(known, "known").join(counted(documented, "documented"), "rule_id", "full_outer")
    problem = (
        F.when(F.col("n_known").isNull(), "unknown rule")
        .when(F.col("n_documented").isNull(), "not documented")
        .when((F.col("n_known") > 1) | (F.col("n_documented") > 1), "repeated id")
        .when(~F.col("prefix_known").eqNullSafe(F.col("prefix_documented")), "other prefix")
    )
    return both.select("rule_id", problem.alias("problem")).where("problem IS NOT NULL")
