import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veilscan.llm.best_fit import pack, place

from .helpers import ODD_TEXTS, docs_of, text

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(texts, rows, length):
    tokenizer = Tokenizer.from_file(PATH)
    bins, docs = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k, s, len(ids[s : s + length]), zlib.crc32(np.array(ids[s : s + length], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), length))]
        assert sorted(docs[i]) == want
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_pieces_ids_and_places(spark):
    texts = [*ODD_TEXTS, "ÀÉß don't I'LL Σας İx <|endoftext|>x 12ab!!! ŒŸ e\u0301 a\x1cb", *(text(i, 5 * i) for i in range(60))]
    rows = pack(docs_of(spark, texts), PATH, length=256).collect()
    n_bins = check(texts, rows, 256)
    assert n_bins <= sum(r["length"] for r in rows) / 256 * 1.02 + 1


def test_groups_have_numbers_of_their_own(spark):
    texts = [text(i, 40) for i in range(50)]
    check(texts, pack(docs_of(spark, texts), PATH, length=256, group=10).collect(), 256)
    assert pack(docs_of(spark, texts).limit(0), PATH).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = docs_of(spark, [text(1, 10)])
    assert pack(docs.unionAll(docs), PATH).count() == 2


def test_every_constraint_holds_for_both_scores():
    r = np.random.default_rng(2)
    demand = np.stack([n := r.integers(1, 1000, 800), np.ones(800), n**2], axis=1).astype(float)
    capacity = np.array([1024.0, 6.0, 700_000.0])
    for score in ("norm", "dot"):
        where = place(demand, capacity, np.array([1.0, 0.5, 0.5]), score)
        for b in np.unique(where):
            own = demand[where == b]
            assert len(own) == 1 or (own.sum(axis=0) <= capacity * (1 + 1e-9)).all()
        assert len(np.unique(where)) <= 1.3 * np.ceil((demand.sum(axis=0) / capacity).max())


def slow_place(demand, capacity, weights, score):
    """Vector best fit, bin by bin: the best value, the bin opened first on a tie."""
    d = demand / capacity
    left, where = [], [None] * len(d)
    for i in sorted(range(len(d)), key=lambda i: (-float(d[i] @ weights), i)):
        best = None
        for b, room in enumerate(left):
            if all(room >= d[i] - 1e-12):
                value = -float(((room - d[i]) ** 2) @ weights) if score == "norm" else float((room * d[i]) @ weights)
                if best is None or value > best[0]:
                    best = (value, b)
        if best is None:
            left.append(np.ones(len(capacity)))
            best = (0, len(left) - 1)
        left[best[1]] = left[best[1]] - d[i]
        where[i] = best[1]
    return where


def test_placement_equals_bin_by_bin_also_on_ties():
    r = np.random.default_rng(7)
    for weights in ((1.0, 0.5, 0.5), (1.0, 0.0, 0.0), (0.2, 1.0, 0.3)):
        for score in ("norm", "dot"):
            n = r.choice([64, 128, 256, 384, 512], 150)  # many equal sizes: many ties
            demand = np.stack([n, np.ones(150), n**2], axis=1).astype(float)
            args = (demand, np.array([1024.0, 5.0, 600_000.0]), np.array(weights), score)
            assert place(*args).tolist() == slow_place(*args)


def test_weights_change_the_choice_and_not_the_constraints():
    n = np.random.default_rng(8).integers(1, 1000, 400)
    demand, capacity = np.stack([n, np.ones(400), n**2], axis=1).astype(float), np.array([1024.0, 1024.0, 1024.0**2])
    assert place(demand, capacity, np.array([1.0, 0.5, 0.5])).tolist() != place(demand, capacity, np.array([1.0, 0.0, 0.0])).tolist()
