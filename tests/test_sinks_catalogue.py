"""Files under safe names, and the order of a documented catalogue."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from veilscan.operators.evaluation import check_catalogue_order, longest_run
from veilscan.sources.safe_sink import read_files, write_files


def test_one_file_per_row_bytes_and_names(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("a", ".safe.env", "x\nü"), ("b/c", "n/a me.txt", ""), ("d", "e.md", None), ("a", "two.txt", "2"), ("", "x.txt", "y")]
    df = spark.createDataFrame(rows, "key string, name string, text string").repartition(3)
    write_files(df, folder)
    got = {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, ns in os.walk(folder) for n in ns}
    assert {k: v for k, v in got.items() if k != "_SUCCESS"} == {
        "a/.safe.env": "x\nü".encode(), "b_c/n_a me.txt": b"", "d/e.md": b"", "a/two.txt": b"2", "x.txt": b"y",
    }
    assert got["_SUCCESS"] == b"5" and not any("_temporary" in k for k in got)
    back = read_files(df.select("key").where("key <> ''").distinct(), folder).collect()
    assert sorted((r["key"], r["name"], bytes(r["content"])) for r in back) == sorted([("a", ".safe.env", "x\nü".encode()), ("a", "two.txt", b"2"), ("b/c", "n_a me.txt", b""), ("d", "e.md", b"")])


def test_a_failed_write_leaves_no_half_file_and_can_be_repeated(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.range(20).select(F.col("id").cast("string").alias("key"), F.lit("f.txt").alias("name"), F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.repeat(F.lit("z"), 5000)).alias("text"))
    with pytest.raises(Exception, match="lost"):
        write_files(df, folder)
    files = [os.path.join(d, n) for d, _, ns in os.walk(folder) for n in ns]
    assert all(os.path.getsize(f) == 5000 for f in files) and not any(f.endswith("_SUCCESS") for f in files)
    write_files(df.withColumn("text", F.repeat(F.lit("z"), 5000)), folder)
    assert len(list((tmp_path / "out").glob("*/f.txt"))) == 20 and (tmp_path / "out" / "_SUCCESS").read_text() == "20"
    write_files(df.limit(0).withColumn("text", F.lit("")), folder)


def test_longest_run_is_as_long_as_by_trying_all(spark):
    orders = [list(p) for p in itertools.permutations(range(5))][::7] + [[], [3], [2, 0, 1, 4, 3]]
    rows = spark.createDataFrame([(o,) for o in orders], "p array<int>").select("p", longest_run(F.col("p")).alias("r")).collect()
    for r in rows:
        best = max((len(c) for n in range(len(r.p) + 1) for c in itertools.combinations(r.p, n) if list(c) == sorted(c)), default=0)
        assert len(r.r) == best and r.r == sorted(r.r) and [x for x in r.p if x in r.r] == r.r


def test_catalogue_order_names_what_is_wrong(spark):
    known = spark.createDataFrame([(i, f"r{i}") for i in range(6)], "position int, rule_id string")
    lists = {"same": [0, 1, 2, 3, 4, 5], "moved": [0, 4, 1, 2, 3, 5], "short": [0, 1, 3, 4, 5], "twice": [0, 1, 1, 2, 3, 4, 5], "new": [0, 1, 9, 2, 3, 4, 5]}
    said = spark.createDataFrame([(k, i, f"r{x}") for k, v in lists.items() for i, x in enumerate(v)], "list string, position int, rule_id string")
    got = {tuple(r) for r in check_catalogue_order(known, said, "list").collect()}
    assert got == {("moved", "r4", "moved"), ("short", "r2", "not documented"), ("twice", "r1", "repeated id"), ("new", "r9", "unknown rule")}
