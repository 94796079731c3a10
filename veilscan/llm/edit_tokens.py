"""Token counts under edits: a segment tree of pre-token blocks per document.

A byte-level BPE tokenizer cuts a text into pre-tokens by a pattern and encodes each on its own. A document's tree has a
leaf for every ``LEAF`` pre-tokens with the leaf's characters and tokens, and their sums above; it is two long arrays in
heap order (node k over nodes 2k and 2k + 1). For an edit the tree gives the leaves it touches in a logarithmic number of
steps; those, one leaf before (the pattern looks ahead by at most three characters) and as many after as it takes for the
cut to fall on an old leaf's end again are cut and encoded anew, and the sums above them are updated. All other leaves keep
their counts.

Trees are columns: ``with_trees`` builds them, ``apply_edits`` takes and returns them. Both are narrow passes.

Edits are an array of ``(start, end, text)`` in code points of the text as it is. They are taken in order of start, then of
place in the array; places beyond the text are moved to its end, a null text is empty, and an edit that begins before the
end of one already taken is left out and counted as skipped. Null text is empty; null or empty edits change nothing; an
empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship, table_of

LEAF = 8
CACHE = 400_000
AHEAD = 3


class Counter(dict):
    """Tokens of a pre-token, encoded when first met."""

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves of a text."""
        parts = self.cut(text)
        chars, tokens = list(map(len, parts)), list(map(self.__getitem__, parts))
        return [sum(chars[i : i + LEAF]) for i in range(0, len(parts), LEAF)], [sum(tokens[i : i + LEAF]) for i in range(0, len(parts), LEAF)]


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(ranks_path: str, pattern: str) -> Counter:
    if (ranks_path, pattern) not in _COUNTERS:
        _COUNTERS[ranks_path, pattern] = Counter(ranks_path, pattern)
    return _COUNTERS[ranks_path, pattern]


class Tree:
    """Sums over leaves in heap order; the leaves stand in the second half."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.half = len(chars) // 2

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        half = 1 << max(0, len(chars) - 1).bit_length()
        heap = np.zeros((2, 2 * half), np.int64)
        heap[0, half : half + len(chars)], heap[1, half : half + len(tokens)] = chars, tokens
        level = half
        while level > 1:
            heap[:, level // 2 : level] = heap[:, level : 2 * level].reshape(2, -1, 2).sum(axis=2)
            level //= 2
        return cls(heap[0], heap[1])

    def leaf_at(self, place: int) -> int:
        """The leaf that holds the character at ``place``, the last one for the end of the text."""
        node, place = 1, min(place, int(self.chars[1]) - 1)
        while node < self.half:
            node *= 2
            if place >= self.chars[node]:
                place -= int(self.chars[node])
                node += 1
        return node - self.half

    def start(self, leaf: int) -> int:
        node, total = leaf + self.half, 0
        while node > 1:
            if node & 1:
                total += int(self.chars[node - 1])
            node >>= 1
        return total

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.half
        more, add = chars - self.chars[node], tokens - self.tokens[node]
        while node and (more or add):
            self.chars[node] += more
            self.tokens[node] += add
            node >>= 1


def edit(counts: Counter, text: str, tree: Tree, start: int, end: int, new: str) -> tuple[str, Tree, int]:
    """Text and tree after one edit, and the number of characters encoded anew."""
    after = text[:start] + new + text[end:]
    if not text:
        return after, Tree.of(*counts.leaves(after)), len(after)
    first, last = tree.leaf_at(start), tree.leaf_at(max(start, end - 1))
    first = max(0, first - 1)
    while first and start - tree.start(first) < AHEAD:
        first -= 1
    begin, shift = tree.start(first), len(new) - (end - start)
    # Cut anew until a pre-token ends where an old leaf, beyond the edit, ends.
    last = min(last + 1, tree.half - 1)
    while True:
        stop = tree.start(last) + int(tree.chars[last + tree.half]) + shift
        at_end = stop >= len(after)
        parts, at, done = counts.cut(after[begin : stop + AHEAD]), begin, 0
        for k, part in enumerate(parts):
            at += len(part)
            if at == stop:
                done = k + 1
                break
        if done or at_end:
            parts = parts[:done] if done else parts
            break
        last = min(tree.half - 1, last + max(1, last - first))
    chars, tokens = sum(map(len, parts)), sum(map(counts.__getitem__, parts))
    if chars > 64 * LEAF * (last - first + 1):  # a long insertion gets leaves of its own; all others keep their counts
        used = int(np.flatnonzero(tree.chars[tree.half :]).max(initial=last)) + 1
        old = tree.chars[tree.half :][:used].tolist(), tree.tokens[tree.half :][:used].tolist()
        groups = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)]
        new = [sum(map(len, g)) for g in groups], [sum(map(counts.__getitem__, g)) for g in groups]
        return after, Tree.of(*(o[:first] + n + o[last + 1 :] for o, n in zip(old, new, strict=True))), chars
    width = last - first + 1
    share = -(-len(parts) // width)
    for i in range(width):
        own = parts[i * share : (i + 1) * share]
        tree.put(first + i, sum(map(len, own)), sum(map(counts.__getitem__, own)))
    return after, tree, chars


TREES = [("tree_chars", pa.list_(pa.int64())), ("tree_tokens", pa.list_(pa.int64()))]
TREES_DDL = "tree_chars array<long>, tree_tokens array<long>"


def _build(ranks_path: str, pattern: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *TREES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(ranks_path, pattern)
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            trees = [Tree.of(*counts.leaves(t)) for t in texts]
            yield table_of(schema, batch.column("doc_id"), texts, [t.chars for t in trees], [t.tokens for t in trees])

    return run


def with_trees(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, text, tree_chars, tree_tokens`` per document."""
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_build(ranks_path, pattern), f"doc_id long, text string, {TREES_DDL}")


EDITED = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.string()), *TREES, ("n_edits", pa.int64()), ("n_skipped", pa.int64()),
    ("n_tokens_before", pa.int64()), ("n_tokens", pa.int64()), ("n_chars_encoded", pa.int64()),
])
EDITED_DDL = f"doc_id long, text string, {TREES_DDL}, n_edits long, n_skipped long, n_tokens_before long, n_tokens long, n_chars_encoded long"


def _edit(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(ranks_path, pattern)
        for batch in chunks(batches):
            rows = []
            for doc, text, chars, tokens, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = Tree(np.array(chars, np.int64), np.array(tokens, np.int64))
                before, taken, skipped, free, encoded = int(tree.tokens[1]), [], 0, 0, 0
                for e in sorted((e for e in edits or [] if e), key=lambda e: e["start"] or 0):
                    start = min(max(0, e["start"] or 0), len(text))
                    end = min(max(start, e["end"] or 0), len(text))
                    if start < free:
                        skipped += 1
                        continue
                    taken.append((start, end, e["text"] or ""))
                    free = end
                for start, end, new in reversed(taken):  # from the right, so that places to the left stay
                    text, tree, n = edit(counts, text, tree, start, end, new)
                    encoded += n
                rows.append((doc, text, tree.chars, tree.tokens, len(taken), skipped, before, int(tree.tokens[1]), encoded))
            if rows:
                yield table_of(EDITED, *zip(*rows, strict=True))

    return run


def apply_edits(trees: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Text, tree and counts after the edits in the column ``edits`` (array of start, end, text)."""
    ship(trees.sparkSession)
    slim = trees.select("doc_id", "text", "tree_chars", "tree_tokens", F.col("edits").cast("array<struct<start: long, end: long, text: string>>"))
    return slim.mapInArrow(_edit(ranks_path, pattern), EDITED_DDL)
