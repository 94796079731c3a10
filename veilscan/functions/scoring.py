"""Category lookup, risk score and level as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (
    CATEGORY_BY_RULE_ID,
    CATEGORY_WEIGHT,
    DECISION_RANK,
    GENERALIZED_LABEL,
    GUARD_EXTRA_RULE_IDS,
    GUARD_REASON_PREFIX,
    PAIR_BONUS,
    PERSON_ADDRESS_REASON,
    PERSON_PHONE_REASON,
    RULES,
    SCORE_CAP,
)
from .lets import either, let, lookup


def category_of(finding: Column) -> Column:
    """Own category, else that of the rule, else ``other``."""
    return F.coalesce(finding["category"], lookup(CATEGORY_BY_RULE_ID, finding["rule_id"]), F.lit("other"))


def generalized_label(category: Column) -> Column:
    return lookup(GENERALIZED_LABEL, category)


def is_guarded(finding: Column) -> Column:
    """Whether a finding trips the secret guard."""
    ids = [rule.id for rule in RULES if rule.category == "secret"] + GUARD_EXTRA_RULE_IDS
    return (category_of(finding) == "secret") | finding["rule_id"].isin(ids)


def level_of_score(score: Column) -> Column:
    return (
        F.when(score <= 0, "safe")
        .when(score < 20, "low")
        .when(score < 50, "medium")
        .when(score < 80, "high")
        .otherwise("critical")
    )


def decision_rank(level: Column) -> Column:
    return lookup(DECISION_RANK, level)


def risk_score(findings: Column, categories: Column, block_at_level: str = "high") -> Column:
    """Score, level, blocked flag, guard flag, counts per category and reasons.

    ``categories`` is the array of categories of ``findings``, computed once.
    """
    person = F.array_contains(categories, "person")
    with_address = person & F.array_contains(categories, "address")
    with_phone = person & F.array_contains(categories, "phone")
    weights = F.aggregate(
        F.transform(categories, lambda c: lookup(CATEGORY_WEIGHT, c)), F.lit(0), lambda total, w: total + w
    )
    bonus = either(with_address, PAIR_BONUS, 0) + either(with_phone, PAIR_BONUS, 0)
    score = F.least(weights + bonus, F.lit(SCORE_CAP))
    guard = F.exists(findings, is_guarded)
    distinct = F.array_distinct(categories)
    counts = F.map_from_arrays(
        distinct, F.transform(distinct, lambda c: F.size(F.filter(categories, lambda x: x == c)))
    )
    reasons = F.concat(
        F.transform(
            F.filter(findings, is_guarded), lambda f: F.concat(F.lit(GUARD_REASON_PREFIX), f["label"])
        ),
        either(with_address, F.array(F.lit(PERSON_ADDRESS_REASON)), F.array().cast("array<string>")),
        either(with_phone, F.array(F.lit(PERSON_PHONE_REASON)), F.array().cast("array<string>")),
    )

    def scored(s: Column) -> Column:
        return F.struct(
            s["score"].alias("score"),
            s["level"].alias("level"),
            (s["guard"] | (decision_rank(s["level"]) >= DECISION_RANK[block_at_level])).alias("blocked"),
            s["guard"].alias("secret_guard"),
            counts.alias("category_counts"),
            reasons.alias("reasons"),
        )

    # The level asks for the score again and again, and the flags for the level and the guard: each is computed once.
    levelled = let(score, lambda s: F.struct(s.alias("score"), level_of_score(s).alias("level"), guard.alias("guard")))
    return let(levelled, scored)
