import random
import re

from veilscan.llm.pii_bootstrap import KINDS, _luhn, base_spans, mentions, personal_data, with_digests

from .helpers import ODD_TEXTS, docs_of, text


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


BITS = ["a", "b.", "@", "c.d", "1", "25", "300", ".", "-", " ", "+", "4111 1111 1111 1111", "é", "(", ")", "%", "\n", "0", "00", "1.2.3.4", "x@y.z", "+1 (578) 555-6437"]


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    for _ in range(8000):
        t = "".join(r.choice(BITS) for _ in range(r.randint(0, 30)))
        assert base_spans(t) == brute(t)


def test_base_spans_are_linear():
    for t in ("a" * 10**6, "1" * 10**6, "a@" * 10**6, "+1" * 10**6, "1." * 10**6, "+1 " + "(" * 10**6):
        base_spans(t)


def test_table_has_base_spans_of_whole_texts(spark):
    texts = [*ODD_TEXTS, text(1) + " joe.x@mail.example.com, +1 (578) 555-6437 at 17.2.27.210 4111 1111 1111 1111.", "a@b.c " * 2000]
    got = {r["doc_id"]: r for r in with_digests(personal_data(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = brute(t or "")
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s[1] == n for s in want) for n in range(4)]
        assert got[i]["spans"] == ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
    assert personal_data(docs_of(spark, texts).limit(0)).count() == 0
    assert personal_data(docs_of(spark, ["a@b.c"]).unionAll(docs_of(spark, ["a@b.c"]))).count() == 2


def test_patterns_of_seeds_find_identifiers_that_no_shape_covers(spark):
    seeds = [f"{text(i, 8)} please call us +1 (578) 555-{6000 + i} soon {text(i + 90, 5)}" for i in range(12)]
    unseen = f"{text(77, 8)} please call us 578-555-7777 soon after"
    other = [f"{text(300 + i, 8)} order number {i}578-555-{7000 + i} today" for i in range(12)]
    texts = [*seeds, unseen, *other]
    found = {r["doc_id"]: r["found"] for r in personal_data(docs_of(spark, texts)).collect()}
    start = unseen.index("578-555")
    assert [(s["start"], s["kind"], s["end"]) for s in found[12]] == [(start, 3, start + 12)]
    assert not any(v for k, v in found.items() if k != 12)


def test_identifiers_written_in_groups_are_found_whole(spark):
    seeds = [f"{text(i, 8)} please call us +1 (578) 555-{6000 + i} soon {text(i + 90, 5)}" for i in range(40)]
    seeds += [f"{text(i, 8)} paid by card 4111 1111 1111 1111 yesterday {text(i + 40, 5)}" for i in range(1)]
    seeds += [f"{text(i, 8)} paid by card {n} yesterday" for i, n in enumerate(("5500 0000 0000 0004", "6011 0000 0000 0004", "3530 1113 3330 0000"))]
    grouped = ["(578) 555 6437", "030 901 820 55", "(578) 555-6437", "030 90182055", "578 - 555 - 6437"]
    unseen = [f"{text(77 + i, 8)} please call us {n} soon after" for i, n in enumerate(grouped)]
    unseen.append(f"{text(99, 8)} (please call us 578 555 7777), 2019 was {text(3, 4)}")
    unseen.append(f"{text(98, 8)} paid by card 4111 1111 1111 1112 yesterday")
    want = [*grouped, "578 555 7777", "4111 1111 1111 1112"]
    texts = [*seeds, *unseen]
    found = {r["doc_id"]: r["found"] for r in personal_data(docs_of(spark, texts)).collect()}
    for i, (t, n) in enumerate(zip(unseen, want, strict=True), len(seeds)):
        assert [(t[s["start"] : s["end"]], s["kind"]) for s in found[i]] == [(n, 2 if n.startswith("4111") else 3)]
    assert not any(found[i] for i in range(len(seeds)))


def test_runs_of_groups_end_with_lines_and_punctuation():
    got = [m["instance"] for m in mentions('a 12 34, 56 78\n90 12. 34 x "5 6" 7 (8)', []) if m["whole"]]
    assert got == ["12 34", "56 78", "90 12", "5 6", "7 (8)"]
    mentions("1 " * 200_000 + "( " * 200_000, [])
