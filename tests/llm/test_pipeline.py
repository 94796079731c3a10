import __spark_entry__
import corpus_pipeline
import public_tokenizers

from .test_bbit_minhash import brute as near
from .test_best_fit import check
from .test_decontaminate import brute as leaks

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_on_what_is_left(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontaminate", "secrets", "packing"]

    def step(name):
        out = stages[name](spark, docs, FOLDER)
        assert out.columns == columns
        return corpus_pipeline.stored(out, f"test-{name}")

    docs = step("quality")
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0 < len(after) < len(kept) and all(kept[i] == t for i, t in after.items())

    ids = sorted(after)
    want = {ids[i] for i, (_, _, stays) in near([after[i] for i in ids]).items() if stays}
    docs = step("near_duplicates")
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(after) == want

    docs = step("decontaminate")
    clean = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(clean) == {i for i, t in after.items() if not leaks(t, items)[4]}

    docs = step("secrets")
    safe = {r["doc_id"]: r for r in docs.collect()}
    assert set(safe) == set(clean)
    for i, r in safe.items():
        assert r["n_chars"] == len(r["text"]) and (r["text"] == clean[i] or "[SECRET]" in r["text"])

    order = sorted(safe)
    place = {d: i for i, d in enumerate(order)}
    rows = [{**r.asDict(), "doc_id": place[r["doc_id"]]} for r in stages["packing"](spark, docs, FOLDER).collect()]
    check([safe[i]["text"] for i in order], rows, 4096)


def test_registered():
    queries = __spark_entry__.queries()
    assert queries["pipeline"] is corpus_pipeline.run
    assert sorted(int(q[2:].split("_")[0]) for q in queries if q.startswith("op") and q[2].isdigit()) == list(range(1, 14))
    assert public_tokenizers.path("word_bpe_49k.json")
