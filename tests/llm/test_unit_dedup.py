import pytest

from veilscan.llm.unit_dedup import dedup_units, normal, units_of

from .helpers import ODD_TEXTS, docs_of, text

TEXTS = [
    *ODD_TEXTS, "A line\nB line\n\nC  Line ", "c line\nD\n a  LINE\nB line\nB line\n", "D", "é\nÉ\n ", "p one\np two\n\n\nq one", "q one\n \np one\np two", text(1) + "\n" + text(2),
    text(2) + "\n" + text(3) + "\n" + text(1), "One two three. Four five! Six seven eight? A.\nNine。 z", "Six seven  eight?\tone TWO three. Four five! \n A. e.g. x.y",
]


def brute(texts, unit, min_words):
    seen, out = set(), {}
    for doc, t in enumerate(texts):
        t, gone, places = t or "", [], units_of(t or "", unit)
        n = 0
        for a, b in places:
            if form := normal(t[a:b]):
                n += 1
                if len(form.split()) < min_words:
                    continue
                if form in seen:
                    gone.append((a, b))
                seen.add(form)
        kept = [k for k, p in enumerate(places) if p not in gone]
        rest = "".join(t[places[k][0] : places[k][1] if k == kept[-1] else places[k + 1][0]] for k in kept)
        out[doc] = (n, len(gone), sum(b - a for a, b in gone), gone, rest)
    return out


@pytest.mark.parametrize("unit,min_words", [("line", 1), ("paragraph", 1), ("sentence", 1), ("sentence", 3), ("line", 5)])
def test_equals_brute_force(spark, unit, min_words):
    got = {
        r["doc_id"]: (r["n_units"], r["n_removed"], r["n_removed_chars"], [(x["start"], x["end"]) for x in r["removed"]], r["text"])
        for r in dedup_units(docs_of(spark, TEXTS), unit, min_words).collect()
    }
    assert got == brute(TEXTS, unit, min_words)
    if (unit, min_words) == ("line", 1):
        assert got[10][4] == "D\nB line\n" or got[10][1] >= 3


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = docs_of(spark, ["x y\nz"])
    null = docs.selectExpr("CAST(NULL AS long) AS doc_id", *docs.columns[1:])
    rows = sorted((str(r["doc_id"]), r["text"]) for r in dedup_units(docs.unionAll(docs).unionAll(null)).collect())
    assert rows == [("0", "x y\nz"), ("0", "x y\nz"), ("None", "")]
    assert dedup_units(docs.limit(0)).count() == 0
