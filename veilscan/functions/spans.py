"""Span columns: find, resolve, number and rewrite, all inside the row.

A finding is a struct; a row's findings are an array of it, so a scan stays a
chain of projections with no shuffle. Offsets count code points, half open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import RISK_RANK
from .lets import either, let, lookup
from .lists import empty, folded, parts
from .patterns import CLOSED_BY, WITH_LEAD

SPAN_TYPE = "array<struct<start:int,end:int,text:string>>"
FINDING_TYPE = (
    "struct<start:int,end:int,rule_id:string,source:string,label:string,risk_level:string,"
    "category:string,text:string,placeholder:string,message:string,confidence:double,id:string>"
)
FINDINGS_TYPE = f"array<{FINDING_TYPE}>"

# Two Unicode noncharacters mark the hits of one pattern inside a text.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
_SPARE = "\ufdd2\ufdd3"
CHUNK_CHARS = 4096
_FEW_PIECES = 8


def has_marks(text: Column) -> Column:
    return F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))


def without_marks(text: Column) -> Column:
    """The text to match against: equal in length, free of the two marks."""
    return F.when(has_marks(text), F.translate(text, OPEN + CLOSE, _SPARE)).otherwise(text)


def marked(text: Column, pattern: str) -> Column:
    """The text with marks around the leftmost, non-overlapping hits of a pattern. ``text`` must be free of marks."""
    hit = f"$1{OPEN}$2{CLOSE}" if pattern in WITH_LEAD else f"{OPEN}$0{CLOSE}"
    if pattern in CLOSED_BY:
        # An opening without its end would be followed to the end of the text, again and again.
        head = F.regexp_extract(text, f"(?s)^.*{CLOSED_BY[pattern]}", 0)
        rest = F.substring(text, F.char_length(head) + 1, F.char_length(text))
        return F.concat(F.regexp_replace(head, pattern, hit), rest)
    return F.regexp_replace(text, pattern, hit)


def pieces_of(marked: Column) -> Column:
    """A marked text cut up at its hits.

    Each piece is a hit, the closing mark, and the text up to the next hit; the first piece has an empty hit.
    """
    return F.split(F.concat(F.lit(CLOSE), marked), OPEN, -1)


def marked_pieces(text: Column, pattern: str) -> Column:
    """The text cut up at the leftmost, non-overlapping hits of a pattern, found in one pass of the regex."""
    return pieces_of(marked(text, pattern))


def spans_of_pieces(pieces: Column) -> Column:
    """Spans with offsets, from the lengths of the pieces. Empty hits do not count."""

    def span(pos: Column, piece: Column) -> Column:
        hit = F.substring_index(piece, CLOSE, 1)
        found = F.struct(pos.alias("start"), (pos + F.char_length(hit)).alias("end"), hit.alias("text"))
        return either(F.startswith(piece, F.lit(CLOSE)), empty(SPAN_TYPE), F.array(found))

    def after(pos: Column, piece: Column) -> Column:
        return pos + F.char_length(piece) - 1

    def few(pieces: Column) -> Column:
        at = lambda i: F.char_length(F.array_join(F.slice(pieces, 1, i + 1), "")) - i - 1
        return F.flatten(F.transform(F.slice(pieces, 2, _FEW_PIECES), lambda piece, i: span(at(i), piece)))

    # Most texts hold one hit of a pattern, or few: they need no fold.
    return let(
        pieces,
        lambda p: F.when(F.size(p) == 2, span(after(F.lit(0), F.get(p, 0)), F.get(p, 1)))
        .when(F.size(p).between(3, _FEW_PIECES), few(p))
        .otherwise(folded(p, F.lit(0), after, span, SPAN_TYPE)),
    )


def find_spans(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping, non-empty hits of a pattern with offsets."""
    return spans_of_pieces(marked_pieces(text, pattern))


def literal_pieces(text: Column, term: str | Column) -> Column:
    """The text cut up at a literal term, left to right without overlap."""
    if isinstance(term, str):
        quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    else:
        quoted = F.concat(
            F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
        )
    return F.split(text, quoted, -1)


def spans_between(pieces: Column, term: Column) -> Column:
    """Spans of the term between pieces; there is none after the last piece."""
    size = F.char_length(term)

    def span(pos: Column, piece: Column) -> Column:
        at = pos + F.char_length(piece)
        return F.array(F.struct(at.alias("start"), (at + size).alias("end"), term.alias("text")))

    inner = F.slice(pieces, 1, F.size(pieces) - 1)
    return folded(inner, F.lit(0), lambda pos, piece: pos + F.char_length(piece) + size, span, SPAN_TYPE)


def find_literal(text: Column, term: Column) -> Column:
    """Offsets of a literal term."""
    return spans_between(literal_pieces(text, term), term)


def risk_rank(level: Column) -> Column:
    return F.coalesce(lookup(RISK_RANK, level), F.lit(0))


def placeholder_base(placeholder: Column) -> Column:
    base = F.regexp_extract(placeholder, "^\\[([A-Z0-9_]+?)(?:_[0-9]+)?\\]\\z", 1)
    return let(base, lambda b: either(b == "", "MASK", b))


PLACE_TYPE = "array<struct<start:int,end:int,at:int>>"


def _is_free(taken: Column, place: Column) -> Column:
    """Whether a place overlaps none of those taken, which are sorted and apart: a binary search."""
    steps = F.sequence(F.lit(1), (F.ceil(F.log2(F.size(taken) + 1)) + 1).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        before = F.get(taken, mid)["start"] < place["end"]
        open_ = acc["low"] < acc["high"]
        return F.struct(
            either(open_ & before, mid + 1, acc["low"]).alias("low"), either(open_ & ~before, mid, acc["high"]).alias("high")
        )

    start = F.struct(F.lit(0).alias("low"), F.size(taken).alias("high"))
    return let(F.aggregate(steps, start, halve, lambda acc: acc["low"]), lambda n: (n == 0) | (F.get(taken, n - 1)["end"] <= place["start"]))


_FEW = 256


def _first_come(places: Column, sizes: tuple[int, ...] = (8192, _FEW)) -> Column:
    """Places in order of claim: each is taken if it overlaps none taken before. The result is sorted by position.

    Claims come in blocks of blocks. A block is first rid of what overlaps the places taken before it, by binary search; what is
    left of it is settled by itself, the smallest blocks pairwise.
    """
    if not sizes:
        return F.aggregate(
            places,
            empty(PLACE_TYPE),
            lambda taken, p: either(F.exists(taken, lambda k: (k["start"] < p["end"]) & (p["start"] < k["end"])), taken, F.array_append(taken, p)),
            lambda taken: F.sort_array(taken),
        )

    def step(taken: Column, block: Column) -> Column:
        free = either(F.size(taken) == 0, block, F.filter(block, lambda p: _is_free(taken, p)))
        return F.sort_array(F.concat(taken, _first_come(free, sizes[1:])))

    return F.aggregate(parts(places, sizes[0]), empty(PLACE_TYPE), step)


def _strongest(found: Column) -> Column:
    """Claims in order of strength: risk, then length, then position, then rule id."""
    ranked = F.sort_array(
        F.transform(
            found,
            lambda f: F.struct(
                (-risk_rank(f["risk_level"])).alias("risk"),
                (f["start"] - f["end"]).alias("length"),
                f["start"].alias("start"),
                f["rule_id"].alias("rule_id"),
                f.alias("finding"),
            ),
        )
    )

    def settle(ranked: Column) -> Column:
        places = F.transform(
            ranked, lambda r, i: F.struct(r["finding"]["start"].alias("start"), r["finding"]["end"].alias("end"), i.alias("at"))
        )
        taken = either(F.size(ranked) <= _FEW, _first_come(places, ()), _first_come(places))
        return F.transform(taken, lambda p: F.get(ranked, p["at"])["finding"])

    return let(ranked, settle)


def resolve_overlaps(findings: Column) -> Column:
    """Keep the strongest of overlapping findings, ordered by position."""
    valid = F.filter(findings, lambda f: (f["start"] >= 0) & (f["end"] > f["start"]))

    def settle(found: Column) -> Column:
        met = F.filter(found, lambda f, i: (i > 0) & (f["start"] < F.get(found, F.greatest(i - 1, F.lit(0)))["end"]))
        return either(F.size(met) == 0, found, _strongest(found))

    # In order of position, those that overlap none before them need no claims.
    return either(F.size(findings) < 2, valid, let(F.sort_array(valid), settle))


def number_placeholders(findings: Column) -> Column:
    """Number placeholders 1..n per prefix, in text order. ``findings`` is resolved."""
    def renamed(f: Column, base: Column, i: Column) -> Column:
        return f.withField("placeholder", F.concat(F.lit("["), base, F.lit("_"), (i + 1).cast("string"), F.lit("]"))).withField(
            "id",
            either(F.coalesce(f["id"], F.lit("")) == "", F.concat_ws(":", f["source"], f["rule_id"], f["start"].cast("string"), f["end"].cast("string")), f["id"]),
        )

    def numbered(bases: Column) -> Column:
        def by_base(based: Column) -> Column:
            def one_base(base: Column) -> Column:
                return F.transform(F.filter(based, lambda b: b["base"] == base), lambda b, i: renamed(b["finding"], base, i))

            return F.sort_array(F.flatten(F.transform(F.array_distinct(bases), one_base)))

        # Few findings are counted one by one, as they stand.
        before = lambda i: either(i == 0, 0, F.size(F.filter(F.slice(bases, 1, i), lambda b: b == F.get(bases, i))))
        few = (F.size(bases) <= 16) & ~F.exists(bases, lambda b: b.isNull())
        based = F.transform(findings, lambda f, i: F.struct(F.get(bases, i).alias("base"), f.alias("finding")))
        return either(few, F.transform(findings, lambda f, i: renamed(f, F.get(bases, i), before(i))), let(based, by_base))

    # The base of a placeholder takes a regex: it is read once per finding, not once per finding and base.
    return let(F.transform(findings, lambda f: placeholder_base(f["placeholder"])), numbered)


def text_chunks(text: Column) -> Column:
    """The text in pieces of a fixed number of characters.

    Cutting out a span then costs one or two pieces, not a walk from the start
    of the text, so rewriting is linear even for a very long text.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"[\\s\\S]{{1,{CHUNK_CHARS}}}"), F.lit(0))
    return F.when(F.char_length(text).between(1, CHUNK_CHARS), F.array(text)).otherwise(pieces)


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` out of :func:`text_chunks`."""
    first = F.floor(start / CHUNK_CHARS).cast("int")
    last = F.floor((end - 1) / CHUNK_CHARS).cast("int")
    joined = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    far = either(end > start, F.substring(joined, start - first * CHUNK_CHARS + 1, end - start), "")
    return either(F.size(chunks) == 1, F.substring(F.get(chunks, 0), start + 1, end - start), far)


def rewrite(chunks: Column, length: Column, findings: Column) -> Column:
    """Put each finding's placeholder in place of its span."""
    pieces = F.transform(
        findings,
        lambda f, i: F.concat(
            cut(
                chunks,
                either(i == 0, F.lit(0), F.get(findings, i - 1)["end"]),
                f["start"],
            ),
            f["placeholder"],
        ),
    )
    tail = cut(chunks, F.get(findings, F.size(findings) - 1)["end"], length)
    return either(F.size(findings) == 0, F.array_join(chunks, ""), F.concat(F.array_join(pieces, ""), tail))
