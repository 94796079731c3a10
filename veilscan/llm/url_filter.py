"""URL filters: host-suffix and path-prefix expressions, hash-prefix join, digest check, rule precedence.

A rule ``host/path`` (action block or allow) fits a url whose host is the rule's or below it and whose path starts with
the rule's. Each url is expanded into host suffixes and path prefixes that end in a slash, no more of them than the rules have
labels and slashes. These meet the rules' own hosts and folders on the first bytes of their digests, full digests confirm, and
only what a folder's rules need is expanded further: the path lengths that occur in that very folder. The resulting expressions
meet whole rules in the same way, and the longest rule wins; of equally long ones block wins, then the lesser text.

Everything is a DataFrame operation. Urls are first reduced to distinct (host, path) pairs with partial aggregation, so a
hot url is expanded once; expressions carry a salt that the rules are repeated for, so that a hot expression (a third of
all urls below one domain) is spread if the rules are too many for Spark to broadcast by its own size check. The way back to
the rows is salted too, and rows without a host meet nothing. Two numbers of the rules come to the driver, however many they are.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and the default verdict. Repeated
rows give one row each. Null or malformed rules (no slash, unknown action) fit nothing. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, path), 256))


def _short(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules with host, path, digest and rank, each text once."""
    host, path = F.regexp_extract("rule", r"(?s)^([^/]+)(/.*)$", 1), F.regexp_extract("rule", r"(?s)^([^/]+)(/.*)$", 2)
    valid = rules.where(F.col("action").isin("block", "allow")).select(
        "rule", "action", F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("rule_host"), path.alias("rule_path")
    )
    valid = valid.where("rule_host <> ''").groupBy("rule_host", "rule_path").agg(
        F.min_by(F.struct("rule", "action"), F.struct(F.when(F.col("action") == "block", 0).otherwise(1), "rule")).alias("own")
    )
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    return valid.select(
        digest.alias("rule_digest"), _short(digest).alias("short"), F.col("own.rule").alias("rule"), F.col("own.action").alias("action"),
        "rule_host", F.regexp_extract("rule_path", r"(?s)^(.*/)", 1).alias("folder"), F.char_length("rule_path").alias("chars"),
    )


def _salted(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS))


def _expressions(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``host, path, suffix, chars``: host suffixes and path lengths that rules below the same host and folder have."""
    folders = table.groupBy("rule_host", "folder").agg(F.collect_set("chars").alias("lengths"))
    digest = _digest(F.col("rule_host"), F.col("folder"))
    folders = folders.select(digest.alias("folder_digest"), _short(digest).alias("short"), "lengths")
    most = table.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("folder", "/")) - 1)).first()
    labels, slashes = most[0] or 0, most[1] or 0
    n_labels = F.least(F.size(F.split("host", r"\.")), F.lit(labels))
    n_slashes = F.least(F.char_length("path") - F.char_length(F.replace("path", F.lit("/"), F.lit(""))), F.lit(slashes))
    pairs = pairs.withColumns({"n_labels": n_labels, "n_slashes": n_slashes}).where("n_labels > 0 AND n_slashes > 0")
    wide = pairs.select("host", "path", "n_slashes", F.explode(F.sequence(F.lit(1), "n_labels")).alias("label"))
    wide = wide.select("host", "path", F.expr("substring_index(host, '.', -label)").alias("suffix"), F.explode(F.sequence(F.lit(1), "n_slashes")).alias("slash"))
    wide = wide.withColumn("digest", _digest(F.col("suffix"), F.concat(F.expr("substring_index(path, '/', slash)"), F.lit("/"))))
    wide = wide.select("host", "path", "suffix", "digest", _short(F.col("digest")).alias("short"), _salt("host", "path").alias("salt"))
    met = wide.join(_salted(folders), ["short", "salt"]).where(F.col("digest") == F.col("folder_digest"))
    return met.select("host", "path", "suffix", F.explode("lengths").alias("chars")).where(F.char_length("path") >= F.col("chars"))


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict`` per row of ``pages``; ``rules`` has ``rule`` (``host/path``) and ``action``."""
    table = rule_table(rules)
    urls = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    pairs = urls.select("host", "path").where("host <> ''").distinct()
    wide = _expressions(pairs, table).withColumn("digest", _digest(F.col("suffix"), F.expr("substring(path, 1, chars)")))
    wide = wide.select("host", "path", "digest", _short(F.col("digest")).alias("short"), _salt("host", "path").alias("salt"))
    rules_of = _salted(table.select("rule_digest", "short", "rule", "action"))
    met = wide.join(rules_of, ["short", "salt"]).where(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(-F.char_length("rule"), F.when(F.col("action") == "block", 0).otherwise(1), "rule")
    best = _salted(met.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), rank).alias("best")))
    urls = urls.withColumn("salt", F.when(F.col("host") != "", _salt(key)).otherwise(SALTS + F.abs(F.xxhash64(key) % 1_000_003)))
    return urls.join(best, ["host", "path", "salt"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict")
    )
