import re
from collections import Counter

import numpy as np

from veilscan.llm.weak_quality import COUNTS, fit_votes, judged, keep_good, statistics

from .helpers import ODD_TEXTS, docs_of, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeat = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat)]


TEXTS = [
    *(t or "" for t in ODD_TEXTS), "a b c d e f g h " * 3 + "x", "#1 a|b &&\n\n x\x0bz\n#1 a|b &&", text(3), text(3) + "\n" + text(3), "é" * 30 + " ü\u2003ü",
    "p q r s t u v w 1 p q r s t u v w", "p q r s t u v", "same\nsame \nsame",
]


def test_statistics_equal_brute_force():
    got = np.stack(statistics([t.encode() for t in TEXTS]))[:5].T.tolist()
    assert got == [brute(t) for t in TEXTS]
    assert [len(x) for x in statistics([])] == [0] * len(COUNTS)


def test_base_rules_nulls_repeats_and_empty_table(spark):
    rows = judged(docs_of(spark, [*TEXTS, None])).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        n, _, _, _, repeat = brute((TEXTS + [""])[r["doc_id"]])
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    assert judged(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_filter_takes_the_same_decisions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in judged(docs).where("kept").collect())


def test_agrees_with_held_out_labels(spark):
    """No label is used to fit; most junk goes and no good document beyond the base rules."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = judged(docs).where("NOT base_failed").join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"]], [r["kept"] for r in rows if not r["quality"]]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_em_finds_the_rules_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20000) < 0.9
    chance = np.array([[0.2, 0.95], [0.3, 0.9], [0.1, 0.97], [0.5, 0.9]])
    votes = (r.random((20000, 4)) < np.where(good[:, None], chance[:, 1], chance[:, 0])).astype(int)
    votes[r.random(votes.shape) < 0.2] = -1
    pattern, count = np.unique(votes, axis=0, return_counts=True)
    model = fit_votes(pattern, count)
    assert np.abs(model.good - chance).max() < 0.08
