import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from veilscan.llm import bwt_dedup as B

from .helpers import ODD_TEXTS, docs_of, text


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = {}
    for doc, x in enumerate(raw):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def cases():
    r = random.Random(4)
    passage = text(50, 60)
    near = text(51, 200)
    return [
        *ODD_TEXTS, near, near[:300] + "Q" + near[301:], passage + " " + text(52), text(53) + passage, "Z" + passage[:199], "Y" + passage[:200], "X" + passage[3:203],
        passage[:150] + "!" + passage[:201], near, text(54, 20), "é" * 150, "ü" + "é" * 120, "ab" * 150 + text(55, 10),
        *("".join(r.choice([passage[k : k + 230] for k in range(0, 90, 30)] + [text(60 + i, 15)]) for _ in range(4)) for i in range(12)),
    ]


def run(spark, texts):
    rows = B.dedup_bytes(docs_of(spark, texts)).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in rows}


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("part", [1, 2, 3, 7, 4096])
def test_merged_transforms_equal_a_sort(monkeypatch, seed, part):
    monkeypatch.setattr(B, "PART", part)
    r = np.random.default_rng(seed)
    group = np.sort(r.integers(0, 4, 60))
    right = r.integers(0, 2, (60, 27)).astype(np.uint8)
    right[:, : r.integers(0, 27)] = 1  # long common prefixes
    right[30:] = right[r.integers(0, 30, 30)]  # and equal suffixes
    order, common = B.merged(group, right)
    rows = [(int(group[i]), right[i].tobytes()) for i in order]
    assert sorted(order.tolist()) == list(range(60)) and rows == sorted(rows)
    for k, (g, x) in enumerate(rows):
        if not k or rows[k - 1][0] != g:
            assert common[k] == -1
        else:
            assert common[k] == len(os.path.commonprefix([rows[k - 1][1], x]))


@pytest.mark.parametrize(("shard", "part"), [(65_536, 4096), (65_536, 2), (5, 2), (2, 2)])
def test_equals_brute_force_with_merged_parts_and_shards(spark, monkeypatch, shard, part):
    for name, value in (("SHARD", shard), ("PART", part)):
        monkeypatch.setattr(B, name, value)
    texts = cases()
    assert run(spark, texts) == brute(texts)


def test_long_texts_come_in_segments(monkeypatch):
    monkeypatch.setattr(B, "SEGMENT", 300)
    t = text(1, 400).encode()
    windows = set()
    for base, part in B.segments(t, 200):
        _, a, first, last, _ = B.anchors([part], 200)
        for x, y in zip(first + base, last + base, strict=True):
            own = set(range(x, y + 1))
            assert not own & windows
            windows |= own
    assert windows == set(range(len(t) - 199))


def test_repeated_rows_and_empty_table(spark):
    docs = docs_of(spark, [text(1), text(2)])
    rows = B.dedup_bytes(docs.unionAll(docs)).collect()
    assert len(rows) == 4 and all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 for r in rows)
    assert B.dedup_bytes(docs.limit(0)).count() == 0
