"""Vector best-fit packing of token sequences.

A document becomes its token ids and one end id; one longer than the sequence length is cut into full pieces and a rest.
Pieces are items with a vector of demands: tokens, one document, and attention cost (the square of the length). A sequence
(bin) has a capacity in each. Items are placed in falling size into the open bin that holds them under every constraint and
has, by choice, the least weighted norm of what would be left (``score="norm"``) or the largest weighted dot product of
demand and residual (``score="dot"``); if none holds the item, a bin is opened.

Only ids, lengths and checksums of pieces are shuffled, dealt round robin into groups of bounded size that are packed on
their own; each group leaves at most a few bins unfilled. Token ids are made once, by a narrow pass whose result is stored.

Defined results: null or empty text is the end id alone; repeated documents are packed once per row; ties go to the bin
opened first; null ids are kept; an empty table gives no rows; other columns are ignored. A piece over a capacity other
than tokens still gets a bin, of its own.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, ship, stored, table_of

CACHE_WORDS = 400_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
PLACED_DDL = PIECES_DDL + ", sequence_id long, offset long"


class WordIds(dict):
    """Ids of a stretch of text without spaces, as little-endian 32-bit bytes; encoded when first met.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its stretches in turn. A
    plain stretch (letters of ASCII or Latin-1, then punctuation) is two words to it, each looked up in its common form and
    given to the tokenizer's model as it is; every other stretch goes through the whole tokenizer.
    """

    PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?*#$%&()+=~^@/-]*)")

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.words = self.tokenizer.model, {"": b""}
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.form = {i: split(chr(i))[0][0] for i in range(0xC0, 0x100)}  # letters as the model has them

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if plain := self.PLAIN.fullmatch(stretch):
            ids = self._word(plain[1].lower()) + self._word(plain[2])
        else:
            ids = self._bytes(self.tokenizer.encode(stretch, add_special_tokens=False).ids)
        self[stretch] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE_WORDS:
                self.words = {"": b""}
            ids = self.words[word] = self._bytes([t.id for t in self.model.tokenize(word.translate(self.form))])
        return ids

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _pieces(path: str, end_id: int, length: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in chunks(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.encode((text or b"").decode("utf-8", "replace")) + end
                rows += [(doc, k, k * length, len(part) // 4, zlib.crc32(part)) for k, part in enumerate(ids[i : i + 4 * length] for i in range(0, len(ids), 4 * length))]
            yield table_of(PIECES, *zip(*rows, strict=True))

    return run


def place(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, score: str = "norm") -> np.ndarray:
    """Bin number per item (rows of ``demand``), items taken in falling size."""
    size = (demand / capacity) @ weights
    order = np.argsort(-size, kind="stable")
    demand, where = demand / capacity, np.empty(len(demand), np.int64)
    left, number, n, opened = np.empty((len(demand) + 1, len(capacity))), np.empty(len(demand) + 1, np.int64), 0, 0
    least = demand.min(axis=0) if len(demand) else capacity
    for i in order:
        d = demand[i]
        fits = np.flatnonzero((left[:n] >= d - 1e-12).all(axis=1))
        if fits.size:
            room = left[fits]
            value = -(((room - d) ** 2) @ weights) if score == "norm" else (room * d) @ weights
            at = fits[value.argmax()]
        else:
            at, n = n, n + 1
            left[at], number[at] = 1.0, opened
            opened += 1
        where[i] = number[at]
        left[at] -= d
        if (left[at] < least - 1e-12).any():  # holds nothing more
            left[at : n - 1], number[at : n - 1] = left[at + 1 : n], number[at + 1 : n]
            n -= 1
    return where


def _packed(capacity: tuple, weights: tuple, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        length = table.column("length").to_numpy()
        demand = np.stack([length, np.ones_like(length), length.astype(float) ** 2], axis=1).astype(float)
        where = place(demand, np.array(capacity, float), np.array(weights, float), score)
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(length[order])
        first = np.concatenate([[True], np.diff(where[order]) > 0])
        begin = (ends - length[order])[first]
        offset = ends - length[order] - np.repeat(begin, np.diff(np.append(np.flatnonzero(first), len(order))))
        base = TaskContext.get().partitionId() << 33
        table = table.take(pa.array(order))
        yield table_of(PLACED, *(c.combine_chunks() for c in table.columns), base + where[order], offset)

    return run


def pack(
    docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, max_docs: int | None = None, max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.5, 0.5), score: str = "norm", group: int = 20_000,
) -> DataFrame:
    """One row per piece with its place.

    ``weights`` are those of tokens, documents and attention cost in the score. Without ``max_docs`` and ``max_cost`` the capacities
    of the latter two bind no more than the tokens do; they still have their part in the choice of the bin.
    """
    spark = docs.sparkSession
    ship(spark)
    capacity = (length, max_docs or length, max_cost or length * length)
    pieces = stored(as_bytes(docs).mapInArrow(_pieces(tokenizer, end_id, length), PIECES_DDL), "pieces")
    groups = max(1, -(-pieces.count() // group))
    return pieces.repartition(groups).mapInArrow(_packed(capacity, weights, score), PLACED_DDL)
