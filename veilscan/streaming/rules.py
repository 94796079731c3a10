"""Rules as versioned data, read anew by every batch of a stream."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import BUNDLED_RULES, TextRule

RULES_DDL = (
    "number int, id string, label string, risk_level string, prefix string, message string, confidence double, category string, pattern string, "
    "id_source string, enabled boolean"
)


def publish_rules(spark: SparkSession, path: str, version: int, rules: list[TextRule]) -> None:
    """Add a version; a version that is there already is left alone and refused."""
    rows = [(i, *[asdict(r)[c.split()[0]] for c in RULES_DDL.split(", ")[1:]]) for i, r in enumerate(rules)]
    spark.createDataFrame(rows, RULES_DDL).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def newest_version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).agg(F.max("version").cast("int")).first()[0]


def rules_of_version(spark: SparkSession, path: str, version: int) -> list[TextRule]:
    """Rules of one version, in order. As few as a bundle holds, since a batch's plan is made of them."""
    rows = spark.read.parquet(path).where(F.col("version") == version).orderBy("number").collect()
    bundled = {r.id: r for r in BUNDLED_RULES}
    fields = [c.split()[0] for c in RULES_DDL.split(", ")[1:]]
    return [bundled[r["id"]] if r["pattern"] is None else TextRule(**{f: r[f] for f in fields}) for r in rows if r["enabled"]]


def version_of_batch(spark: SparkSession, rules: str, record: str, batch_id: int) -> int:
    """The version a batch works with: the newest when it first runs, and the same again if it is replayed."""
    try:
        return spark.read.schema("version int").parquet(f"{record}/{batch_id}").first()[0]
    except AnalysisException:
        version = newest_version(spark, rules)
        _one(spark, version).write.mode("overwrite").parquet(f"{record}/{batch_id}")
        return version


def _one(spark: SparkSession, version: int) -> DataFrame:
    return spark.range(1).select(F.lit(version).cast("int").alias("version"))
