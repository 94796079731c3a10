"""The scan over a stream of messages. Every column is narrow, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import TextRule
from ..operators.policy import needs_send_review, with_policy
from ..operators.scan import with_findings, with_rewritten
from .rules import rules_of_version, version_of_batch


def review_columns(messages: DataFrame, text: str, rules: list[TextRule] | None = None, mode: str = "mask") -> DataFrame:
    """Action, severity, review flag and safe text of each message."""
    scanned = with_policy(with_findings(messages, text, rules))
    safe = with_rewritten(scanned, text, "findings", mode, "safe_text")
    policy = F.col("policy")
    return safe.select(
        *[c for c in messages.columns if c != text],
        F.size("findings").alias("n_findings"),
        policy["action"].alias("action"),
        policy["severity"].alias("severity"),
        policy["risk"]["score"].alias("score"),
        needs_send_review(F.col("findings"), policy).alias("needs_review"),
        "safe_text",
    )


def start_scan(
    messages: DataFrame,
    text: str,
    target: str,
    checkpoint: str,
    load_rules: Callable[[], list[TextRule]] | None = None,
    mode: str = "mask",
    trigger: dict | None = None,
):
    """Start a streaming scan into a parquet table.

    With ``load_rules`` the rules are loaded anew for every batch, so a newly
    admitted bundle takes effect without a restart. Batch output goes to a folder
    per batch id, which makes a replayed batch overwrite itself.
    """
    trigger = trigger or {"availableNow": True}
    if load_rules is None:
        return (
            review_columns(messages, text, None, mode)
            .writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        review_columns(batch, text, load_rules(), mode).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        messages.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def start_versioned_scan(messages: DataFrame, text: str, target: str, checkpoint: str, rules: str, mode: str = "mask", trigger: dict | None = None):
    """Start a streaming scan whose rules are a versioned table (:mod:`streaming.rules`), read for every batch.

    A new version takes effect with the next batch, without a restart. The version of each batch is written down before its
    output, so a replayed batch gives the same rows even if the rules have changed since; it overwrites itself.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = version_of_batch(spark, rules, f"{checkpoint}-rules", batch_id)
        out = review_columns(batch, text, rules_of_version(spark, rules, version), mode).withColumn("rules_version", F.lit(version))
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        messages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
