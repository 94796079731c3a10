import hashlib
import zlib

import numpy as np
import pytest

from veilscan.llm import merkle
from veilscan.llm.sha_states import START, absorb, finish, fresh

from .helpers import ODD_TEXTS, docs_of, text


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout):
    """Root and, per leaf, runs of (children, place) on its way up."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, p in enumerate(at):
            ways[k].append((runs[p // fanout], p % fanout))
        at, nodes = [p // fanout for p in at], [sha("".join(r)) for r in runs]
    return nodes[0], ways


def brute(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf_of(r))))
        groups[lang] = (own, *tree([leaf_of(r) for r in own], fanout))
    root, tops = tree([groups[lang][1] for lang in langs], fanout)
    out = []
    for lang, top in zip(langs, tops, strict=True):
        own, subroot, ways = groups[lang]
        for r, way in zip(own, ways, strict=True):
            doc, source, _, n, t = r
            hit = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0
            value = leaf_of((doc, source, lang, n + 1 if hit and n is not None else n, t))
            proof = ""
            for run, at in way + top:
                proof += "".join(run[:at] + run[at + 1 :])
                value = sha("".join([*run[:at], value, *run[at + 1 :]]))
            out.append((doc, leaf_of(r), subroot, root, sha(proof), value, value == root))
    return out


def got(df):
    return sorted(map(str, (tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect())))


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_states_equal_hashlib_and_resume():
    digests = np.random.default_rng(1).integers(0, 256, (7, 32)).astype(np.uint8)
    texts = [d.tobytes().hex().encode() for d in digests]
    state = fresh(1)
    for k in range(7):
        assert finish(state, np.array([k]))[0].tobytes() == hashlib.sha256(b"".join(texts[:k])).digest()
        kept = state.tobytes()  # written down and taken up again
        state = absorb(np.frombuffer(kept, np.uint32).reshape(1, 8), digests[k : k + 1])
    assert len(START) == 8


@pytest.mark.parametrize("fanout", [2, 3])
def test_equals_brute_force(spark, fanout, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 8)  # several rounds of blocks
    import pyspark.sql.functions as F

    docs = docs_of(spark, [*ODD_TEXTS, *(text(i, 9) for i in range(80)), text(1, 9)])
    lang = F.expr("CASE WHEN doc_id < 3 THEN NULL WHEN doc_id < 5 THEN '' WHEN doc_id = 7 THEN 'ß' WHEN doc_id < 70 THEN 'en' ELSE concat('l', doc_id % 5) END")
    docs = docs.withColumn("lang", lang).withColumn("n_chars", F.expr("CASE WHEN doc_id % 11 = 3 THEN NULL ELSE n_chars END"))
    docs = docs.withColumn("source", F.expr("nullif(source, 'src1')"))
    assert got(merkle.manifest(docs, merkle.tampered(), fanout)) == sorted(map(str, brute(rows_of(docs), fanout)))


def test_real_blocks_null_and_repeated_ids(spark):
    import pyspark.sql.functions as F

    docs = spark.range(9000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.select(F.expr("CASE WHEN id % 1000 = 0 THEN NULL WHEN id % 3 = 0 THEN 5 ELSE id END").alias("doc_id"), "text", F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(9223372036854775806).alias("n_chars"))
    assert got(merkle.manifest(docs, merkle.tampered())) == sorted(map(str, brute(rows_of(docs))))


def test_repeated_rows_one_row_and_empty_table(spark):
    docs = docs_of(spark, ["a", "b"])
    twice = docs.unionAll(docs)
    assert got(merkle.manifest(twice, merkle.tampered())) == sorted(map(str, brute(rows_of(twice))))
    one = docs.limit(1)
    assert got(merkle.manifest(one, merkle.tampered())) == sorted(map(str, brute(rows_of(one))))
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_without_changes_all_rows_hold(spark):
    rows = merkle.manifest(docs_of(spark, [text(i, 5) for i in range(20)])).collect()
    assert len(rows) == 20 and all(r["verified"] for r in rows)
