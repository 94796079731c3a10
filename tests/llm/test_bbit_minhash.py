import random
import re

import numpy as np

from veilscan.llm import bbit_minhash as M

from .helpers import ODD_TEXTS, docs_of, text, words

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def edited(base, share, seed):
    r = random.Random(seed)
    out = list(base)
    for k in r.sample(range(len(out)), int(share * len(out))):
        out[k] = f"w{r.randint(0, 10**6)}"
    return " ".join(out)


def cases():
    base, other = words(1, 150, 3000), words(2, 90, 3000)
    near = [edited(base, s, k) for k, s in enumerate([0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08, 0.15, 0.3] * 8)]
    chain = [" ".join(other[i : i + 60]) for i in range(0, 30, 3)]
    passage = [f"{text(100 + i, 30)} {' '.join(other[:40])}" for i in range(30)]
    return [*ODD_TEXTS, *near, *chain, *passage, " ".join(base).upper(), "one two", "One\tTWO", "one two three four five", "x y", "É f g h i j", "é f g h i j"]


def run(spark, docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(docs).collect()}


def test_equals_brute_force_in_whole_buckets_and_in_blocks(spark, monkeypatch):
    texts = cases()
    want = brute(texts)
    assert run(spark, docs_of(spark, texts)) == want
    monkeypatch.setattr(M, "BLOCK", 8)
    assert run(spark, docs_of(spark, texts)) == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = docs_of(spark, [text(1), text(2), text(1)], first=5)
    twice = docs.unionAll(docs).unionAll(docs_of(spark, [text(2), text(3)]).selectExpr("CAST(NULL AS long) AS doc_id", *docs.columns[1:]))
    rows = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in M.near_duplicates(twice).collect())
    assert rows == [("5", "5", True)] * 2 + [("6", "6", True)] * 2 + [("7", "5", False)] * 2 + [("None", "6", False), ("None", "None", True)]
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_filter_keeps_rows_whole(spark):
    texts = cases()
    docs, want = docs_of(spark, texts), brute(texts)
    kept = M.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if w[2]}


def test_filter_keeps_one_row_of_each_group(spark):
    docs = docs_of(spark, [text(1), text(2), text(1)], first=5)
    nulls = docs_of(spark, [text(2), text(3), text(3)]).selectExpr("CAST(NULL AS long) AS doc_id", *docs.columns[1:])
    kept = M.drop_near_duplicates(docs.unionAll(docs).unionAll(nulls)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("5", text(1)), ("6", text(2)), ("None", text(3))]


def test_estimate_is_close_to_the_similarity(spark):
    base = words(3, 400, 5000)
    texts = [edited(base, s, 9).encode() for s in (0, 0.02, 0.05, 0.1)]
    sets = M.shingle_sets(texts)
    packed = M.packed(M.minima(sets)).tolist()
    rows = spark.createDataFrame([(packed[0], p) for p in packed], "a array<long>, b array<long>")
    for row, s in zip(rows.select(M.estimate(rows["a"], rows["b"]).alias("e")).collect(), sets, strict=True):
        true = len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s))
        assert abs(row["e"] - true) < 0.15
