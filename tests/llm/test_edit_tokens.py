import random

import public_tokenizers
from pyspark.sql import functions as F

from veilscan.llm.edit_tokens import Tree, apply_edits, counter, edit, with_trees

from .helpers import ODD_TEXTS, docs_of, text

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BITS = ["a", "b", "the", " ", "  ", "\n", "'s", "'", "re", "'r", "e", "12", "!!", "é", "\t", "x" * 50, "日"]


def test_counts_after_random_edits_equal_a_fresh_count():
    counts, r = counter(RANKS, PATTERN), random.Random(1)
    for _ in range(600):
        t = "".join(r.choice(BITS) for _ in range(r.choice([0, 1, 5, 60, 800])))
        tree = Tree.of(*counts.leaves(t))
        for _ in range(4):
            start = r.randint(0, len(t))
            end, new = min(len(t), start + r.choice([0, 0, 1, 3, 40])), "".join(r.choice(BITS) for _ in range(r.choice([0, 1, 3, 30])))
            t, tree, _ = edit(counts, t, tree, start, end, new)
            assert tree.tokens[1] == len(counts.encoding.encode_ordinary(t)) and tree.chars[1] == len(t)
            assert all(tree.tokens[k] == tree.tokens[2 * k] + tree.tokens[2 * k + 1] for k in range(1, tree.half))


def test_only_the_touched_region_is_encoded():
    counts = counter(RANKS, PATTERN)
    t = text(1, 20000)
    _, _, n = edit(counts, t, Tree.of(*counts.leaves(t)), 5000, 5003, "new words")
    assert n < 1000


def test_a_long_insertion_gets_leaves_of_its_own():
    counts, r = counter(RANKS, PATTERN), random.Random(2)
    t = text(1, 20000)
    tree = Tree.of(*counts.leaves(t))
    for at in (70_000, 0, 30_000):
        new = text(at, 3000)
        t, tree, n = edit(counts, t, tree, at, at + 5, new)
        assert len(new) <= n < len(new) + 2000 and tree.tokens[1] == len(counts.encoding.encode_ordinary(t)) and tree.chars[1] == len(t)
        assert max(tree.chars[tree.half :]) < 1000
        for _ in range(5):
            start = r.randint(0, len(t))
            t, tree, _ = edit(counts, t, tree, start, start, " word")
            assert tree.tokens[1] == len(counts.encoding.encode_ordinary(t)) and tree.chars[1] == len(t)


def test_edits_of_a_table(spark):
    counts = counter(RANKS, PATTERN)
    texts = [*ODD_TEXTS, text(1), text(2, 500)]
    edits = [[(3, 5, "xy"), (0, 1, ""), (4, 9, "skipped"), (10**6, 10**7, " end"), (7, None, None)], None, [], [None, (2, 2, "in")]]
    rows = [(i, t, "clash", edits[i % 4]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tree_chars string, edits array<struct<start: long, end: long, text: string>>")
    trees = with_trees(df, RANKS, PATTERN).join(df.select("doc_id", "edits"), "doc_id")
    got = {r["doc_id"]: r for r in apply_edits(trees, RANKS, PATTERN).collect()}
    for i, t in enumerate(texts):
        t, taken, free, skipped = t or "", [], 0, 0
        before = len(counts.encoding.encode_ordinary(t))
        for e in sorted((e for e in edits[i % 4] or [] if e), key=lambda e: e[0]):
            start = min(e[0], len(t))
            end = min(max(start, e[1] or 0), len(t))
            if start < free:
                skipped += 1
                continue
            taken.append((start, end, e[2] or ""))
            free = end
        for start, end, new in reversed(taken):
            t = t[:start] + new + t[end:]
        r = got[i]
        assert (r["text"], r["n_edits"], r["n_skipped"], r["n_tokens_before"]) == (t, len(taken), skipped, before)
        assert r["n_tokens"] == len(counts.encoding.encode_ordinary(t))
    assert with_trees(df.limit(0), RANKS, PATTERN).withColumn("edits", F.lit(None)).count() == 0
    assert with_trees(docs_of(spark, ["x"]).unionAll(docs_of(spark, ["x"])), RANKS, PATTERN).count() == 2
