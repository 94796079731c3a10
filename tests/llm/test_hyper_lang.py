import random
import zlib

import numpy as np

from veilscan.llm import hyper_lang
from veilscan.llm.common import read
from veilscan.llm.hyper_lang import Letters, bundles, languages, triples_of, unit

from .helpers import ODD_TEXTS, docs_of

STEMS = {"en": "the ing tion er and ed st wh", "de": "sch ein ung ß ä lich der", "el": "και του ση ός ν", "ja": "日本 の です ます"}


def sample(lang, seed, n):
    r = random.Random(seed)
    parts = STEMS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def bundle(text, letters):
    """Letter by letter."""
    out, codes = np.zeros(letters.size), [0]
    for c in text.lower():
        if c.isalpha():
            codes.append(ord(c))
        elif codes[-1]:
            codes.append(0)
    if codes[-1]:
        codes.append(0)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        out += np.roll(letters[a], 2).astype(float) * np.roll(letters[b], 1) * letters[c]
    return out


def test_bundles_equal_letter_by_letter(monkeypatch):
    monkeypatch.setattr(hyper_lang, "TRIPLES", 7)  # many blocks
    letters = Letters(64)
    texts = ["", "a", "Ab  ,,c", "...x", "İß ﬃ\0q", "日本\ud800の", *(sample(lang, i, 12) for i, lang in enumerate(STEMS)), "", "z1z"]
    got = bundles(*triples_of(texts), len(texts), letters)
    assert (got == np.array([bundle(t, letters) for t in texts])).all()


def test_query_equals_brute_force(spark):
    texts, langs = [*ODD_TEXTS, "123 ,.", *(sample(lang, i, i % 40) for i, lang in enumerate([*STEMS] * 20))], list(STEMS)
    docs = docs_of(spark, texts).selectExpr("doc_id", "text", f"CASE WHEN doc_id = 11 OR doc_id < 5 THEN NULL ELSE element_at(array{tuple(langs)}, CAST(1 + (doc_id + 2) % 4 AS INT)) END AS lang", "digest AS held_out", "items AS score")
    rows = {r["doc_id"]: r for r in languages(docs).collect()}
    letters = Letters()
    vectors = unit(np.array([bundle(t or "", letters) for t in texts]))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in truth}
    names = sorted({v for v in truth.values() if v}, key=str.encode)
    protos = unit(np.array([sum(vectors[i] for i in truth if truth[i] == n and not out[i]) for n in names]))
    for i in truth:
        cosines = np.clip(protos @ vectors[i], 0, 1)
        want = (names[int(cosines.argmax())], cosines.max()) if vectors[i].any() else ("und", 0.0)
        assert rows[i]["held_out"] == out[i] and rows[i]["lang_pred"] == want[0] and abs(rows[i]["score"] - want[1]) < 1e-6


def test_held_out_accuracy_on_the_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND length(text) >= 30").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) > 100
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_more_languages_than_a_block(spark, monkeypatch):
    docs = docs_of(spark, [sample(lang, i, 30) for i, lang in enumerate([*STEMS] * 9)])
    docs = docs.selectExpr("doc_id", "text", f"element_at(array{tuple(STEMS)}, CAST(1 + doc_id % 4 AS INT)) AS lang")
    want = sorted(map(tuple, languages(docs).collect()))
    monkeypatch.setattr(hyper_lang, "LANGS", 1)
    assert sorted(map(tuple, languages(docs).collect())) == want


def test_nothing_learned_empty_and_repeated(spark):
    docs = docs_of(spark, ["some words here", "and more"])
    none = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {(r["lang_pred"], r["score"]) for r in languages(none).collect()} == {("und", 0.0)}
    assert languages(docs.limit(0)).count() == 0
    assert languages(docs.unionAll(docs)).count() == 4
    null = docs.selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang")
    assert [r["held_out"] for r in languages(null).collect()] == [False, False]
