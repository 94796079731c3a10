"""Personal data by bootstrapped contextual extraction.

Shapes alone find the base entities: email, ip, card, phone. They are the seeds of a bootstrap:

* mentions are the base entities, all other identifier-like words (with a digit or ``@``) and the longest runs of neighbouring
  words of a line that are made of digits, brackets, dots, slashes and hyphens (``(578) 555 6437``); a run that is found
  takes the place of its words. Each mention stands in lexical patterns (its two words to the left; its left and right word) and is an instance (its text in lower case);
* Spark scores the graph of patterns and instances in rounds: a pattern's score for a kind is the share of its instances
  that are believed to be of that kind, an instance's belief is the noisy-or of its patterns' scores; seeds are believed.
  A pattern counts once it has ``SUPPORT`` believed instances and a score of ``PRECISE``;
* mentions that no base shape covers, that stand in a pattern that counts, are believed and have the kind's characters
  become further spans. Base spans stay as they are.

Graph rows are aggregated before each shuffle; a pattern of a third of all mentions is one row per task there.

Matching is linear in the text: e-mail runs are taken backwards from each ``@``, numbers from the start of their runs.
Defined results: null or empty text has no spans. Repeated rows are judged alike; a repeated text counts once as evidence,
since instances are counted distinctly. Offsets are code points. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, ship, stored, table_of

KINDS = ["email", "ip", "card", "phone"]
SUPPORT, PRECISE, ROUNDS = 3, 0.8, 3

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])([0-9]++)(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
EDGE = ".,;:!?\"'()[]{}<>"
#: A word of an identifier written in groups; quotes only before the first and punctuation only behind the last.
GROUP = re.compile(r"([\"'<{]*)([0-9()\[\]./+-]+)([,;:!?\"'>}]*)")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base shapes, in order."""
    out, free = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            at = m.start()
            low = max(free, text.rfind("@", free, at) + 1)
            if run := LOCAL.match(text[low:at][::-1]):
                out.append((at - run.end(), 0, m.end()))
                free = m.end()
    for m in IP.finditer(text):
        if all(len(p := part.lstrip(".0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _runs(text: str, words: list[tuple[int, int, str]], free: list[bool]) -> Iterator[tuple[int, int]]:
    """First and last word of the longest runs of at least two numeric groups."""
    first = last = None  # the last word with a digit
    before = 0  # end of the word before
    for i, (start, end, _) in enumerate(words):
        m = GROUP.fullmatch(text, start, end) if free[i] else None
        digit = m and re.search("[0-9]", m.group(2))
        if first is not None and (not m or m.group(1) or "\n" in text[before:start] or "\r" in text[before:start]):
            if last > first:
                yield first, last
            first = None
        if digit:
            first, last = (i if first is None else first), i
        if first is not None and m and (m.group(3) or (digit and m.group(2).endswith("."))):
            if last > first:
                yield first, last
            first = None
        before = end
    if first is not None and last > first:
        yield first, last


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without punctuation around, but with the bracket around an area code."""
    raw = text[start:end]
    low, high = start + len(raw) - len(raw.lstrip(EDGE)), start + len(raw.rstrip(EDGE))
    core = text[low:high]
    opened, closed = core.count("("), core.count(")")
    return low - (text[start:low].endswith("(") and closed > opened), high + (text[high:end].startswith(")") and opened > closed)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base entities, other identifier-like words and runs of numeric groups, each with its two patterns."""
    if not base and not re.search("[0-9@]", text):
        return []
    words = [(m.start(), m.end(), m.group().strip(EDGE).lower()) for m in WORD.finditer(text)]
    found, k = [], 0
    spans = [(s, e, kind) for s, kind, e in base]
    first, free = {}, []
    for i, (start, end, _) in enumerate(words):
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        j, covered = k, False
        while j < len(spans) and spans[j][0] < end:
            covered = covered or spans[j][1] > start
            first.setdefault(spans[j], [i, i])[1] = i
            j += 1
        free.append(not covered)
    run_of = {}
    for i, j in _runs(text, words, free):
        low, high = _trimmed(text, words[i][0], words[j][1])
        found.append((low, high, -1, i, j, low, True))
        run_of.update(dict.fromkeys(range(i, j + 1), low))
    for i, (start, end, word) in enumerate(words):
        if free[i] and len(word) >= 4 and re.search("[0-9@]", word):
            raw = text[start:end]
            low = start + len(raw) - len(raw.lstrip(EDGE))
            found.append((low, low + len(word), -1, i, i, run_of.get(i, low), i not in run_of))
    found += [(s, e, kind, i, j, s, True) for (s, e, kind), (i, j) in first.items()]

    def plain(i: int) -> str:
        """The word as patterns have it; a long one by its digest, so that different words stay different."""
        if not 0 <= i < len(words):
            return "^"
        word = re.sub("[0-9]", "0", words[i][2])
        return word if len(word) <= 40 else hashlib.sha256(word.encode("utf-8", "replace")).hexdigest()[:32]

    return [
        {
            "start": s, "end": e, "kind": kind, "instance": text[s:e].lower(), "run": run, "whole": whole,
            "patterns": [f"L {plain(i - 2)} {plain(i - 1)}", f"B {plain(i - 1)} {plain(j + 1)}"],
        }
        for s, e, kind, i, j, run, whole in found
    ]


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
MENTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()), ("run", pa.int64()), ("whole", pa.bool_()), ("patterns", pa.list_(pa.string()))])
FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("base", pa.list_(SPAN)), ("mentions", pa.list_(MENTION))])
SPAN_DDL = "struct<start: long, kind: int, end: long>"
FOUND_DDL = f"row long, doc_id long, base array<{SPAN_DDL}>, mentions array<struct<start: long, end: long, kind: int, instance: string, run: long, whole: boolean, patterns: array<string>>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        base, seen = [], []
        for raw in batch.column("text").to_pylist():
            text = (raw or b"").decode("utf-8", "replace")
            base.append(base_spans(text))
            seen.append(mentions(text, base[-1]))
        spans = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in b] for b in base]
        yield table_of(FOUND, batch.column("row"), batch.column("doc_id"), spans, seen)


def score_patterns(edges: DataFrame, support: int = SUPPORT, precise: float = PRECISE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``pattern, kind, score`` of the patterns that count and ``instance, kind, belief``; edges: pattern, instance, kind (-1: none)."""
    graph = stored(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "graph")
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = graph.where("kind >= 0").select("instance", "kind").distinct().withColumn("belief", F.lit(1.0))
    beliefs, links = seeds, graph.select("pattern", "instance")
    for _ in range(rounds):
        voted = links.join(beliefs, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("sum"), F.count_if(F.col("belief") >= precise).alias("sure"))
        patterns = stored(
            voted.where(F.col("sure") >= support).join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / F.col("n")).alias("score")).where(F.col("score") >= precise),
            "patterns",
        )
        drawn = links.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - 0.999 * F.col("score"))))).alias("belief"))
        beliefs = stored(drawn.unionByName(seeds).groupBy("instance", "kind").agg(F.max("belief").alias("belief")), "beliefs")
    return patterns, beliefs


def fits_kind(instance: Column, kind: Column) -> Column:
    """Whether an instance has the characters that its kind needs."""
    digits = F.regexp_count(instance, F.lit("[0-9]"))
    return F.when(kind == 0, F.contains(instance, F.lit("@"))).when(kind == 1, (digits >= 4) & F.regexp_like(instance, F.lit("^[0-9a-f.:]+$"))).otherwise(digits >= 7)


def shown(spans: Column) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, support: int = SUPPORT, precise: float = PRECISE, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, base, found``: arrays of spans per document."""
    ship(docs.sparkSession)
    scanned = stored(as_bytes(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_find, FOUND_DDL), "mentions")
    seen = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    patterns, beliefs = score_patterns(edges, support, precise, rounds)
    new = seen.where("kind < 0").select("row", "start", "end", "instance", "run", "whole", F.explode("patterns").alias("pattern")).join(patterns, "pattern")
    new = new.join(beliefs.where(F.col("belief") >= precise), ["instance", "kind"]).where(fits_kind(F.col("instance"), F.col("kind")))
    # Of a run and its words, the run if it is found.
    new = new.groupBy("row", "run").agg(F.collect_set(F.struct("start", "kind", "end", "whole")).alias("spans"), F.max("whole").alias("any_whole"))
    new = new.select("row", F.explode("spans").alias("s"), "any_whole").where("s.whole OR NOT any_whole").select("row", "s.*")
    spans = new.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("found"))
    return scanned.select("row", "doc_id", "base").join(spans, "row", "left").select("doc_id", "base", F.coalesce("found", F.array().cast(f"array<{SPAN_DDL}>")).alias("found"))


def with_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(count(k) for k in range(len(KINDS))), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_union("base", "found")).alias("spans"), F.size("found").alias("n_found"))
