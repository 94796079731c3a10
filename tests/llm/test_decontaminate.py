import hashlib
import re

from veilscan.llm.decontaminate import decontamination, drop_contaminated

from .helpers import ODD_TEXTS, docs_of, text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(doc, items):
    w, hit, ids = split(doc), set(), set()
    for item, t in items:
        iw = split(t)
        n = min(10, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(max(1, len(iw) - 9))} if iw else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def cases(spark):
    items = [(1, text(1, 30)), (2, text(2, 12)), (10, text(1, 30)), (3, "Two words"), (4, "é"), (5, None), (6, ""), (7, "one two three four five six seven eight nine ten")]
    texts = [
        *ODD_TEXTS, text(1, 30), "pre " + text(1, 30).upper() + " post", text(2, 11), " ".join(text(2, 12).split()[1:]), "two, WORDS! two-words", "É é é",
        "nine ten one two three four five six seven eight nine ten eleven", text(1, 9) + " gap " + text(1, 30)[40:], text(1, 30), text(5, 400) + text(1, 30),
    ]
    return items, texts


def run(spark, items, texts, **options):
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS doc_id")
    got = decontamination(docs_of(spark, texts), benchmark, **options).collect()
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got}


def test_equals_brute_force_in_one_block_and_in_many(spark):
    items, texts = cases(spark)
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    assert run(spark, items, texts) == want
    assert run(spark, items, texts, block_bytes=100) == want  # more blocks than are held at once
    assert run(spark, items, texts, block_bytes=300) == want


def test_repeated_rows_and_empty_tables(spark):
    items, _ = cases(spark)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    twice = docs_of(spark, [text(1, 30)]).unionAll(docs_of(spark, [text(1, 30)]))
    assert [r["n_hit"] for r in decontamination(twice, benchmark, block_bytes=100).collect()] == [30, 30]
    assert decontamination(twice.limit(0), benchmark).count() == 0
    assert [r["contaminated"] for r in decontamination(twice, benchmark.limit(0)).collect()] == [False, False]


def test_filter_keeps_clean_rows_whole(spark):
    items, texts = cases(spark)
    docs = docs_of(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (2 << 20, 100):
        kept = drop_contaminated(docs, benchmark, block_bytes=block_bytes)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute(t, items)[4]}
