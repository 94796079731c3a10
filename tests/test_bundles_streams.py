"""Rules of several bundles at once, and rules that change between the batches of a stream."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from veilscan import select_rules
from veilscan.operators import bundles as B
from veilscan.operators.scan import resolve_column
from veilscan.plans.queries import QUERIES
from veilscan.streaming.messages import start_versioned_scan
from veilscan.streaming.rules import newest_version, publish_rules, rules_of_version

NEEDLES = [
    ("Brand#13", "", "Brand#13"), ("Brand#13", "gi", "brand#13"), ("a|b", "", ""), ("ab?cd", "", "cd"), ("ab*", "", "a"), ("ab+cd", "", "ab"), ("ab{2}c", "", "a"),
    ("x(?:longer)y", "", "x"), ("[abc]\\.corp\\d", "", ".corp"), ("^https:\\/\\/a\\.b", "", "https://a.b"), ("\\bkey\\w+", "", "key"), ("(a|b)cd", "", "cd"), ("[\\]x]yz", "", "yz"), ("", "", ""), ("a.b", "", "a"), ("\\d{3,}", "", ""), ("ab\\x41c", "", "ab"),
]


@pytest.mark.parametrize("pattern,flags,needle", NEEDLES)
def test_required_text(pattern, flags, needle):
    assert B.required_text(pattern, flags) == needle


def admitted(spark, bundles):
    rows = []
    for key, rules in bundles.items():
        full = [{"id": i, "label": i, "risk_level": "high", "category": None, "prefix": p.upper(), "pattern": x, "flags": f, "message": None, "confidence": None, "enabled": on} for i, p, x, f, on in rules]
        rows.append((key, full, True))
    rule = "struct<id:string,label:string,risk_level:string,category:string,prefix:string,pattern:string,flags:string,message:string,confidence:double,enabled:boolean>"
    return spark.createDataFrame(rows, f"bundle string, rules array<{rule}>, admitted boolean")


def test_each_text_meets_only_its_own_bundle(spark):
    bundles = {
        "one": [("num", "NUM", "\\d{3,}", "g", None), ("off", "OFF", "abc", "g", False), ("bad", "BAD", "(", "g", None), ("set", "SET", "x", "v", None)],
        "two": [("abc", "ABC", "AbC+", "gi", True), ("num", "NUM", "[0-9]", "g", True)],
    }
    texts = [("one", "abc 1234 x"), ("two", "xabccC 12"), ("three", "abc 1234"), (None, "abc 1234"), ("two", None), ("two", ""), ("one", "﷐123﷑456")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "n int, bundle string, text string")
    rules = B.bundle_rule_table(admitted(spark, bundles), "bundle")
    found = resolve_column(B.scan_with_own_bundle(df, rules, "bundle"), "hits")
    got = {r["n"]: [(f["start"], f["end"], f["rule_id"], f["text"], f["placeholder"]) for f in r["findings"]] for r in found.collect()}
    assert got == {
        0: [(4, 8, "remote:num", "1234", "[NUM_1]")], 1: [(1, 6, "remote:abc", "abccC", "[ABC_1]"), (7, 8, "remote:num", "1", "[NUM_1]"), (8, 9, "remote:num", "2", "[NUM_2]")],
        2: [], 3: [], 4: [], 5: [], 6: [(1, 4, "remote:num", "123", "[NUM_1]"), (5, 8, "remote:num", "456", "[NUM_2]")],
    }


def test_new_version_takes_effect_and_a_replayed_batch_keeps_its_own(spark, tmp_path):
    source, target, state, rules = (str(tmp_path / n) for n in ("in", "out", "state", "rules"))

    def batch(texts):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(source)

    def run():
        start_versioned_scan(spark.readStream.schema("text string").parquet(source), "text", target, state, rules).awaitTermination()
        return sorted((r["batch"], r["rules_version"], r["safe_text"]) for r in spark.read.parquet(target).collect())

    publish_rules(spark, rules, 1, select_rules(enabled_ids=["email"]))
    batch(["a@b.co 2024-05-06"])
    first = run()
    assert first == [(0, 1, "[EMAIL_1] 2024-05-06")]
    publish_rules(spark, rules, 2, select_rules(enabled_ids=["date"]))
    batch(["c@d.co 2024-05-06"])
    second = run()
    assert second == [*first, (1, 2, "c@d.co [DATE_1]")]
    # The commit of the last batch is lost and the rules change again: the batch is replayed under the rules it had.
    for name in os.listdir(f"{state}/commits"):
        if name.strip(".").startswith("1"):
            os.remove(f"{state}/commits/{name}")
    shutil.rmtree(f"{target}/batch=1")
    publish_rules(spark, rules, 3, select_rules(enabled_ids=["email"]))
    assert run() == second
    assert newest_version(spark, rules) == 3 and [r.id for r in rules_of_version(spark, rules, 2)] == ["date"]
    with pytest.raises(Exception, match="(?i)exist"):
        publish_rules(spark, rules, 3, [])


def test_stream_reads_a_table_of_one_file_or_of_many(spark, tmp_path):
    turns = spark.createDataFrame([(i, 0, "user", f"a{i}@b.co") for i in range(6)], "conv_id long, turn long, role string, text string")
    turns.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    turns.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "written").glob("*.parquet")), tmp_path / "one" / "conversations.parquet")
    for folder in ("one", "many"):
        got = QUERIES["stream_scan"](spark, str(tmp_path / folder)).collect()
        assert sorted((r["conv_id"], r["n_findings"]) for r in got) == [(i, 1) for i in range(6)]
