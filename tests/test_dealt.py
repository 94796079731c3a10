"""Rows that a few row groups hold are worked through by all cores."""

import datetime as dt
from decimal import Decimal

from veilscan.plans import derived as D
from veilscan.plans.corpus import corpus, memos


def test_rows_of_one_row_group_are_dealt_over_the_cores(spark, tmp_path):
    day = dt.date(2024, 5, 6)
    orders = spark.createDataFrame([(i, i % 7, Decimal("12.50"), day) for i in range(400)] + [(None, None, None, None)] * 2, "o_orderkey long, o_custkey long, o_totalprice decimal(12,2), o_orderdate date")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, f"part {i}", i % 50, "Brand#11") for i in range(400)], "p_partkey long, p_name string, p_size int, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name, fields in (("documents", "doc_id long, text string"), ("pages", "page_id long, html string"), ("conversations", "conv_id long, turn long, text string")):
        spark.createDataFrame([], fields).write.parquet(str(tmp_path / f"{name}.parquet"))
    folder, splits = str(tmp_path), spark.conf.get("spark.veilscan.spread")
    spark.conf.unset("spark.veilscan.spread")
    try:
        for rows, n in ((memos, 402), (corpus, 402), (D.spans_of_orders, 402), (D.bundles, 400)):
            df = rows(spark, folder)
            assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
            assert df.count() == n
    finally:
        spark.conf.set("spark.veilscan.spread", splits)
