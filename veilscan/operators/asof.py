"""As-of join: each row with the newest row of another table that is not younger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: str, out: str = "found", width: int = HOUR_MS) -> DataFrame:
    """``left`` with ``out``: the row of ``right`` (a struct of its columns) with equal ``keys`` and the largest ``right_time`` not
    after ``left_time``, or null; of equal times that with the largest ``tie``.

    Both tables are put in one order by a union, and the last value of the right side is carried on. Time is cut into buckets of
    ``width``, and a window holds one bucket of one key, so a key with a third of all rows is spread over its buckets; what comes
    from earlier buckets is the newest row of each (a partial aggregate), carried on over the few buckets of a key. A null key is a key
    like any other; a null time finds and is found by nothing. Each row of ``left`` comes back once.
    """
    bucket = lambda t: F.floor(F.col(t) / width)
    row = F.struct(*[F.col(c) for c in right.columns])
    kept = right.where(F.col(right_time).isNotNull()).select(
        *keys, bucket(right_time).alias("_bucket"), F.col(right_time).cast("long").alias("_t"), F.col(tie).alias("_tie"), row.alias("_right")
    )
    asked = left.select(*keys, bucket(left_time).alias("_bucket"), F.col(left_time).cast("long").alias("_t"), F.struct(*left.columns).alias("_left"))
    newest = kept.groupBy(*keys, "_bucket").agg(F.max_by("_right", F.struct("_t", "_tie")).alias("_newest"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = newest.unionByName(asked.select(*keys, "_bucket").distinct(), allowMissingColumns=True)
    places = places.groupBy(*keys, "_bucket").agg(F.first("_newest", ignorenulls=True).alias("_newest"))
    carried = places.withColumn("_carried", F.last("_newest", ignorenulls=True).over(before)).select(*keys, "_bucket", "_carried")

    both = kept.withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_right", ignorenulls=True).over(within)).where("_side = 1").alias("f")
    met = F.col("f._bucket").eqNullSafe(F.col("c._bucket"))
    for key in keys:
        met = met & F.col(f"f.{key}").eqNullSafe(F.col(f"c.{key}"))
    joined = found.join(carried.alias("c"), met, "left")
    value = F.when(F.col("f._t").isNotNull(), F.coalesce(F.col("f._here"), F.col("c._carried")))
    return joined.select(*[F.col("f._left")[c].alias(c) for c in left.columns], value.alias(out))
