"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application."""
    context = spark.sparkContext
    if getattr(context, "_veilscan_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="veilscan-"), "veilscan.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("veilscan", os.path.relpath(full, PACKAGE)))
    context.addPyFile(path)
    context._veilscan_shipped = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with as many underscores in front as it takes for no column's name to begin with it."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem = "_" + stem
    return stem


def as_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and UTF-8 text, whatever else the table holds."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` text bytes, whole rows only; a longer row stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def table_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema
    )
