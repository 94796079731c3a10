"""Line dedup: of units with equal normal form, the earliest in rank stays and the rest go.

A unit is a line (``unit="line"``), a paragraph, that is lines up to an empty one (``unit="paragraph"``), or a sentence, that is a part
of a line up to one of ``.!?。！？`` with white space after it (``unit="sentence"``). Its normal form has A-Z in lower case and runs of
white space as one space. Units of fewer than ``min_words`` words (1 at least) are counted and never removed: short lines and
phrases stand in many documents that share nothing else. Digests (128 bits) are
grouped over all documents; the rank is (doc_id, digest of the text, start), nulls last. Counts and the first rank per
digest are partial aggregates, so a line of a third of all documents is one row per task before the shuffle, and the join
back is a plain equi-join whose skewed side Spark splits.

Defined results: null or empty text has no units and an empty rest. Rows with one id and one text are one document and get
one result each. Offsets are code points of the original text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, ship, stored, table_of

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
BREAK = {
    "line": re.compile("\n"), "paragraph": re.compile("\n(?:[ \t\x0b\x0c\r]*\n)+"),
    "sentence": re.compile("(?<=[.!?。！？])[ \t\x0b\x0c\r]+|\n"),
}
UNITS = pa.schema([("doc_id", pa.int64()), ("text_md5", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary())])
UNITS_DDL = "doc_id long, text_md5 binary, start long, end long, digest binary"


def units_of(text: str, unit: str) -> list[tuple[int, int]]:
    """Places of the units, without their breaks."""
    out, at = [], 0
    for m in BREAK[unit].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))] if text else []


def normal(unit: str) -> bytes:
    return b" ".join(unit.encode().translate(LOWER).split())


def _digests(unit: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                key, text = hashlib.md5(raw or b"").digest(), (raw or b"").decode("utf-8", "replace")
                for start, end in units_of(text, unit):
                    form = normal(text[start:end])
                    if form and form.count(b" ") + 1 >= min_words:
                        rows.append((doc, key, start, end, hashlib.blake2b(form, digest_size=16).digest()))
            if rows:
                yield table_of(UNITS, *zip(*rows, strict=True))

    return run


KEPT = pa.schema([
    ("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_removed_chars", pa.int64()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("text", pa.string()),
])
KEPT_DDL = "doc_id long, n_units long, n_removed long, n_removed_chars long, removed array<struct<start: long, end: long>>, text string"


def _cut(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for doc, raw, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "removed")), strict=True):
                text, gone = (raw or b"").decode("utf-8", "replace"), gone or []
                places, starts = units_of(text, unit), {g["start"] for g in gone}
                rest = [k for k, (start, _) in enumerate(places) if start not in starts]
                # What stands between a kept unit and the next unit goes with the kept unit, but not at the end.
                parts = [text[places[k][0] : places[k][1] if k == rest[-1] else places[k + 1][0]] for k in rest]
                words = sum(1 for a, b in places if text[a:b].encode().split())
                rows.append((doc, words, len(gone), sum(g["end"] - g["start"] for g in gone), gone, "".join(parts)))
            yield table_of(KEPT, *zip(*rows, strict=True))

    return run


def dedup_units(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """Per document: numbers of units with a word, of units and characters removed, their places, and the rest of the text."""
    ship(docs.sparkSession)
    table = as_bytes(docs)
    units = stored(table.mapInArrow(_digests(unit, min_words), UNITS_DDL), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_md5", "start")
    firsts = units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = units.join(firsts, "digest").where(rank != F.col("first")).select("doc_id", "text_md5", "start", "end").distinct()
    gone = gone.groupBy(F.col("doc_id").alias("own_id"), F.col("text_md5").alias("own_md5")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed")
    )
    keyed = table.withColumn("text_md5", F.unhex(F.md5(F.coalesce("text", F.lit(b"")))))
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["own_id"]) & (keyed["text_md5"] == gone["own_md5"]), "left")
    return joined.select("doc_id", "text", "removed").mapInArrow(_cut(unit), KEPT_DDL)
