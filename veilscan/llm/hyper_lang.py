"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. The vector of three letters in a row binds the
letters' vectors, each permuted (rolled) by its place: ``roll(a, 2) * roll(b, 1) * c``. A text is the sum (bundle) of the vectors of
all its letter triples, a language the sum over its documents, each at equal length. A document gets the language whose
prototype has the largest cosine with it.

Letters are what Python calls alphabetic, in lower case; any run of other characters is one gap, which has a vector of its own
and also stands before and after the text. Texts are taken whole. In a task a batch of documents becomes counts of distinct triples,
and blocks of triples are multiplied with their vectors, so memory is bounded whatever the alphabet.

Spark adds the bundles of tasks per (language, dimension) before any shuffle; a language of a third of all documents is one
vector per task. Prototypes are as many as there are languages; blocks of ``LANGS`` of them are sent to the tasks, and each block
is one more narrow step over the documents, which keep their best so far.

Defined results: ``und`` and score 0 for a null text, one without letters, or if nothing was learned. A cosine below 0 counts
as 0. Ties go to the language first in byte order. Null ids are not held out. Rows with null lang are not learned from; a text without
letters adds nothing. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship, stored, table_of

SIZE, SEED = 1024, 12
BATCH_BYTES, TRIPLES, LANGS = 1 << 20, 4096, 512
UNKNOWN = "und"

SUMS = pa.schema([("lang", pa.string()), ("dim", pa.int32()), ("value", pa.float64())])
SUMS_DDL = "lang string, dim int, value double"
BEST = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("lang_pred", pa.string()), ("score", pa.float64())])
BEST_DDL = "doc_id long, text binary, lang_pred string, score double"

_ALPHA: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """By code point, whether it is alphabetic; made once per process."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


class Letters:
    """Vectors of letters, each made from its own code point when first met."""

    def __init__(self, size: int = SIZE, seed: int = SEED, most: int = 20_000):
        self.size, self.seed, self.most = size, seed, most
        self.known: dict[int, np.ndarray] = {}

    def __getitem__(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.size, dtype=np.int8)
            self.known[code] = bits * np.int8(2) - np.int8(1)
        return self.known[code]

    def triples(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of letter triples (rows of three code points)."""
        out = np.ones((len(codes), self.size), np.int8)
        for place in range(3):
            letters, which = np.unique(codes[:, place], return_inverse=True)
            out *= np.stack([np.roll(self[int(c)], 2 - place) for c in letters])[which]
        return out.astype(np.float32)


def triples_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letter triples of all texts: the text's number, and the three code points packed into 63 bits."""
    # A NUL before and after each text is a gap; two gaps in a row stand only between texts.
    codes = np.frombuffer(("\0" + "\0\0".join(t.lower() for t in texts) + "\0").encode("utf-32-le", "replace"), np.uint32)
    letter = is_letter()[codes]
    edge = np.cumsum([0, *(len(t.lower()) + 2 for t in texts)])
    owner = np.repeat(np.arange(len(texts)), np.diff(edge))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    code, owner = np.where(letter, codes, 0)[keep].astype(np.int64), owner[keep]
    whole = (owner[2:] == owner[:-2]) & (code[1:-1] + code[2:] > 0) & (code[:-2] + code[1:-1] > 0)
    packed = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
    return owner[2:][whole], packed[whole]


def bundles(owner: np.ndarray, packed: np.ndarray, n: int, letters: Letters) -> np.ndarray:
    """Sums of the triples' vectors per owner."""
    out = np.zeros((n, letters.size), np.float64)
    which, distinct = pd.factorize(packed)
    codes = np.stack([distinct >> 42, distinct >> 21 & 0x1FFFFF, distinct & 0x1FFFFF], axis=1)
    order = np.argsort(which // TRIPLES, kind="stable") if len(distinct) > TRIPLES else np.arange(len(which))
    owner, which = owner[order], which[order]
    ends = np.searchsorted(which // TRIPLES, np.arange(-(-len(distinct) // TRIPLES)), side="right")
    start = 0
    for block, end in enumerate(ends):
        first = block * TRIPLES
        width = min(TRIPLES, len(distinct) - first)
        counts = np.bincount(owner[start:end] * width + which[start:end] - first, minlength=n * width).reshape(n, width)
        out += counts.astype(np.float32) @ letters.triples(codes[first : first + width])
        start = end
    return out


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in batch.column("text").to_pylist()]


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def _learn(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(size, seed), {}
        for batch in chunks(batches, limit=BATCH_BYTES):
            langs = batch.column("lang").to_pylist()
            vectors = unit(bundles(*triples_of(_texts(batch)), batch.num_rows, letters))
            for lang in set(langs):
                own = vectors[[x == lang for x in langs]].sum(axis=0)
                sums[lang] = sums[lang] + own if lang in sums else own
            if len(sums) >= LANGS:  # however many languages a task meets
                yield _sums(sums, size)
                sums = {}
        if sums:
            yield _sums(sums, size)

    return run


def _sums(sums: dict[str, np.ndarray], size: int) -> pa.RecordBatch:
    return table_of(SUMS, np.repeat(np.array(list(sums), object), size), np.tile(np.arange(size), len(sums)), np.concatenate(list(sums.values())))


def _predict(langs: list[str], prototypes: np.ndarray, size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, names = Letters(size, seed), np.array(langs, object)
        for batch in chunks(batches, limit=BATCH_BYTES):
            vectors = unit(bundles(*triples_of(_texts(batch)), batch.num_rows, letters))
            cosines = np.clip(vectors @ prototypes.T, 0, 1)
            at = cosines.argmax(axis=1)  # the first in byte order of the largest
            score = cosines[np.arange(len(at)), at]
            old = batch.column("score").to_numpy(zero_copy_only=False)
            better = vectors.any(axis=1) & ((score > old) | (batch.column("lang_pred").to_numpy(zero_copy_only=False) == UNKNOWN))
            lang = np.where(better, names[at], batch.column("lang_pred").to_numpy(zero_copy_only=False))
            yield table_of(BEST, batch.column("doc_id"), batch.column("text"), lang, np.where(better, score, old))

    return run


def prototypes(docs: DataFrame, learn: Callable[[], Column] | Column | None = None, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """Per language of the documents to learn from, its bundle: one row per dimension."""
    ship(docs.sparkSession)
    chosen = F.col("lang").isNotNull() & (F.lit(True) if learn is None else learn)
    rows = docs.where(chosen).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_learn(size, seed), SUMS_DDL).groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def predicted(docs: DataFrame, sums: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred and score of every row, by its text alone."""
    ship(docs.sparkSession)
    best = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"),
        F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
    )
    learned = stored(sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).orderBy("lang"), "prototypes")
    block: list = []

    def with_block(best: DataFrame) -> DataFrame:
        vectors = unit(np.array([[x["value"] for x in r["v"]] for r in block], float))
        return best.mapInArrow(_predict([r["lang"] for r in block], vectors, size, seed), BEST_DDL)

    for row in learned.orderBy("lang").toLocalIterator():
        block.append(row)
        if len(block) == LANGS:
            best, block = with_block(best), []
    return (with_block(best) if block else best).drop("text")


def held_out() -> Column:
    """One third of the documents, by checksum of the id; none with a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, and predict all."""
    sums = prototypes(docs, ~held_out())
    out = predicted(docs, sums).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "lang_pred", F.round("score", 9).alias("score"))  # sums of tasks come in any order
