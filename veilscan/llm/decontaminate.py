"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are brought to one form, `` w1 w2 ... wn `` (lower-case words between single spaces), so that a window of item
words is a byte string that occurs exactly where its words do. Per class of windows of like length:

* the shift table tells, for the hash of the block that ends the current window of ``m`` bytes (``m``: the shortest
  string of the class), how far the window may move without missing any string;
* where the shift is 0, the bucket of that suffix hash gives the strings to test, pruned by their first bytes;
* a direct comparison confirms each occurrence.

Many stretches ("lanes") of a buffer of texts are searched at once, each jumping by its own shifts.

Benchmark words are taken in blocks of bounded size (``block_bytes``); each block is broadcast and searched in a pass
over the documents, and passes are merged. No more than ``AT_ONCE`` blocks are on the driver and in a task at once, so no
benchmark is too large for either; a large one takes more passes.

Defined results: null or empty text has no words and no hits; null item texts have no windows; a null item id counts as
the item ``null``; repeated items with one id count once; repeated documents give one row each; other columns of either
table are ignored; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, ship, stored, table_of

#: Lower-cases A-Z and turns every other byte outside words into a space.
FORM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
MIX = np.uint64(0x9E3779B97F4A7C15)
LANE = 1024
#: Blocks of item words that the driver and a task hold at once.
AT_ONCE = 4


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FORM).split()


class Strings:
    """Wu-Manber tables over byte strings of at least ``m`` bytes each."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.m = int(self.lengths.min())
        self.block = min(8, self.m)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        reach = self.m - self.block + 1
        head = np.frombuffer(b"".join(s[: self.m] for s in strings), np.uint8).reshape(len(strings), self.m)
        self.bits = int(np.clip(np.ceil(np.log2(len(strings) * reach + 1)) + 4, 12, 24))
        self.shift = np.full(1 << self.bits, reach, np.int32)
        for at in range(reach):  # later blocks overwrite with smaller shifts
            self.shift[self._hash(self._blocks(head[:, at : at + self.block]))] = reach - 1 - at
        suffix = self._hash(self._blocks(head[:, self.m - self.block :]))
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.first = self._blocks(head[:, : self.block])[self.order]

    def _blocks(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, : self.block] = rows
        return wide.view("<u8")[:, 0]

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * MIX) >> np.uint64(64 - self.bits)

    def search(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start offsets and string numbers of all occurrences."""
        n = len(buffer)
        if n < self.m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        padded = buffer + b"\0" * 8
        words = np.ndarray((n,), "<u8", padded, strides=(1,))
        at = np.arange(self.m - 1, n, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, n)
        found = []
        while at.size:
            step = self.shift[self._hash(words[at - (self.block - 1)] & self.mask)]
            if (zero := step == 0).any():
                found.append(at[zero] - (self.m - 1))
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start = np.concatenate(found)
        suffix = self._hash(words[start + (self.m - self.block)] & self.mask)
        low, high = np.searchsorted(self.suffix, suffix), np.searchsorted(self.suffix, suffix, side="right")
        count = high - low
        start = np.repeat(start, count)
        slot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        same = (words[start] & self.mask) == self.first[slot]
        start, string = start[same], self.order[slot[same]]
        sure = np.fromiter(
            (buffer.startswith(self.strings[s], p) for p, s in zip(start.tolist(), string.tolist(), strict=True)), bool, len(start)
        )
        return start[sure], string[sure]


class Windows:
    """All windows of some item texts, in classes of like length."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            words = text.split(b" ")
            for i in range(max(1, len(words) - size + 1)):
                owners.setdefault(b" " + b" ".join(words[i : i + size]) + b" ", set()).add(item)
        classes: dict[int, list[bytes]] = {}
        for string in owners:
            n_words = string.count(b" ") - 1
            classes.setdefault(0 if n_words == size and len(string) >= 24 else len(string).bit_length(), []).append(string)
        self.classes = [Strings(sorted(strings)) for strings in classes.values()]
        self.n_words = [np.array([s.count(b" ") - 1 for s in c.strings], np.int64) for c in self.classes]
        self.owners = [[sorted(owners[s]) for s in c.strings] for c in self.classes]

    def find(self, texts: list[list[bytes]]) -> tuple[list[list[int]], list[list[str]]]:
        """Per text: numbers of the words hit, and items with occurring windows."""
        parts = [b" " + b" ".join(t) + b" \n" for t in texts]
        begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        buffer = b"".join(parts)
        spaces = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
        first = np.searchsorted(spaces, begin)
        edge = np.zeros(len(spaces) + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        for strings, n_words, owners in zip(self.classes, self.n_words, self.owners, strict=True):
            start, string = strings.search(buffer)
            if not start.size:
                continue
            slot = np.searchsorted(spaces, start)
            np.add.at(edge, slot, 1)
            np.add.at(edge, slot + n_words[string], -1)
            pairs = np.unique(np.stack([np.searchsorted(begin, start, side="right") - 1, string]), axis=1)
            for doc, s in pairs.T.tolist():
                items[doc].update(owners[s])
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        cut = np.searchsorted(hit, first)
        return [(hit[cut[i] : cut[i + 1]] - first[i]).tolist() for i in range(len(texts))], [sorted(x) for x in items]


_TABLES: dict[str, Windows] = {}

FOUND = pa.schema(
    [("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
)
FOUND_DDL = "doc_id long, digest binary, n_words long, hit_words array<int>, items array<string>"
SEGMENT_WORDS = 20_000


def _segments(size: int):
    schema = pa.schema([("item", pa.string()), ("part", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text or b"")
                last = max(1, len(words) - size + 1)
                rows += [(item, k, b" ".join(words[i : i + SEGMENT_WORDS + size - 1])) for k, i in enumerate(range(0, last, SEGMENT_WORDS)) if words]
            yield table_of(schema, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])

    return run


def _tables(name: str, block, size: int) -> Windows:
    """Tables of a broadcast block, built once per worker; a worker holds one block at a time."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Windows(block.value, size)
    return _TABLES[name]


def _search(name: str, block, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(name, block, size)
        for batch in chunks(batches):
            texts = [words_of(t or b"") for t in batch.column("text").to_pylist()]
            hit, items = tables.find(texts)
            yield table_of(FOUND, batch.column("doc_id"), batch.column("digest"), [len(t) for t in texts], hit, items)

    return run


def _keep(name: str, block, size: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(name, block, size)
        for batch in batches:
            clean = []
            for part in chunks([batch], text):
                hit, _ = tables.find([words_of(t or b"") for t in part.column(text).cast(pa.binary()).to_pylist()])
                clean += [not h for h in hit]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def _item_blocks(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[list[tuple[str, object]]]:
    """The item words in named broadcasts of about ``block_bytes`` each, ``AT_ONCE`` at a time; one empty block if there are none.

    The driver fetches a block when its turn comes. Broadcasts of one list are gone when the next list is asked for.
    """
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").cast("binary").alias("text")
    )
    segments = stored(items.mapInArrow(_segments(size), "item string, part int, words binary").distinct(), "benchmark")
    total = segments.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    numbered = segments.withColumn("block", F.pmod(F.xxhash64("item", "part", "words"), F.lit(n_blocks)))
    if n_blocks > AT_ONCE:
        numbered = stored(numbered.repartitionByRange("block"), "blocks")
    for start in range(0, n_blocks, AT_ONCE):
        some = []
        for b in range(start, min(start + AT_ONCE, n_blocks)):
            rows = numbered.where(F.col("block") == b).select("item", "words").collect()
            some.append((uuid.uuid4().hex, spark.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in rows])))
        yield some
        if start + AT_ONCE < n_blocks:
            for _, block in some:
                block.destroy()


def contaminated_words(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """``doc_id, n_words, hit_words, items`` per document: words inside occurrences of item windows of ``size`` words.

    A benchmark of more than ``AT_ONCE`` blocks is searched in several jobs, each written down before the next blocks come.
    """
    table = as_bytes(docs)
    blocks = _item_blocks(benchmark, size, block_bytes)
    passes, last = [], next(blocks)
    table = table.withColumn("digest", F.unhex(F.md5("text")) if len(last) > 1 else F.lit(None).cast("binary"))

    def search(some: list[tuple[str, object]]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [table.mapInArrow(_search(name, block, size), FOUND_DDL) for name, block in some])

    n_blocks = len(last)
    while len(last) == AT_ONCE:
        found = search(last)
        # Asking for the next blocks ends these, so their result is written first.
        written = stored(found, "hits")
        passes.append(written)
        last = next(blocks, [])
        n_blocks += len(last)
    if last:
        passes.append(search(last))
    merged = functools.reduce(DataFrame.unionByName, passes)
    if n_blocks == 1:
        return merged.drop("digest")
    # Rows of one id and text have one result; their number comes back at the end.
    merged = merged.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / F.lit(n_blocks)).cast("int").alias("copies"),
    )
    return merged.select("doc_id", "n_words", "hit_words", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def decontamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """Counts, item digest and verdict per document, with the hit words and items themselves."""
    found = contaminated_words(docs, benchmark, size, block_bytes)
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
        "hit_words", "items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """The rows of ``docs`` without any occurrence of an item window, all columns unchanged."""
    blocks = _item_blocks(benchmark, size, block_bytes)
    some = next(blocks)
    while some:
        for name, block in some:
            docs = docs.mapInArrow(_keep(name, block, size, "text"), docs.schema)
        if len(some) == AT_ONCE:  # written before the next blocks come
            docs = stored(docs, "clean")
        some = next(blocks, None) if len(some) == AT_ONCE else None
    return docs
