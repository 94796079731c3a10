"""File preflight: classes, safe names, batch verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BINARY_EXTENSIONS, TEXT_EXTENSIONS
from ..functions.lets import strip


def extension(name: Column) -> Column:
    """Last extension, lower case; empty without one."""
    low = strip(F.lower(name))
    return F.when(F.contains(low, F.lit(".")), F.substring_index(low, ".", -1)).otherwise("")


def file_kind(name: Column) -> Column:
    ext = extension(name)
    return (
        F.when(ext.isin(TEXT_EXTENSIONS), "supported_text")
        .when(ext.isin(BINARY_EXTENSIONS), "unsupported_binary")
        .otherwise("unknown")
    )


def safe_name(name: Column) -> Column:
    """``a.env`` becomes ``a.safe.env``; a name without a stem gets the mark in front."""
    return (
        F.when(F.rlike(name, F.lit("^[\\s\\S]+\\.[^.]*\\z")), F.regexp_replace(name, "^([\\s\\S]+)(\\.[^.]*)\\z", "$1.safe$2"))
        .when(F.startswith(name, F.lit(".")), F.concat(F.lit(".safe"), name))
        .otherwise(F.concat(F.lit(".safe."), name))
    )


def batch_verdicts(files: DataFrame, batch: str) -> DataFrame:
    """One verdict per batch of attached files.

    ``files``: batch, ``name``, ``n_findings`` (null where not inspected) and
    ``can_send_raw``. Only flags and counts are aggregated, so they combine before
    the shuffle and one huge batch does no harm; :func:`unsupported_names` lists the
    file names as rows.
    """
    kind = file_kind(F.col("name"))
    risky = (kind == "supported_text") & (F.col("n_findings") > 0)
    return files.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(kind == "supported_text").alias("n_inspected"),
        F.count_if(risky).alias("n_risky"),
        F.count_if(kind == "unsupported_binary").alias("n_unsupported"),
        F.coalesce(F.bool_and(F.when(risky, F.col("can_send_raw"))), F.lit(True)).alias("can_attach_raw"),
        (F.count_if(risky) > 0).alias("needs_review"),
    )


def unsupported_names(files: DataFrame, batch: str) -> DataFrame:
    """Names of files that could not be inspected, for the batches under review."""
    reviewed = batch_verdicts(files, batch).where("needs_review").select(batch)
    return files.where(file_kind(F.col("name")) == "unsupported_binary").join(reviewed, batch, "left_semi").select(
        batch, "name"
    )
