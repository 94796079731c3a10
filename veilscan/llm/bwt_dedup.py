"""Removal of repeated byte strings, by merged Burrows-Wheeler shards over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere. Sorting all suffixes of the corpus is
beyond any budget in this setting, so suffixes are sampled by content: each window of ``length`` bytes is represented by its
anchor, the leftmost least hash among its first ``SPAN`` blocks of ``BLOCK`` bytes. Equal windows have equal anchors at
equal distances, so windows are equal only if their anchors share the ``length - SPAN + 1`` bytes that follow; anchors
without a partner by the hash of those bytes are dropped, which loses nothing.

For the rest, each anchor's suffix and the bytes before it go to the anchor's bucket, and large buckets to several shards of
it. Buckets are settled by merging Burrows-Wheeler transforms:

* each ``PART`` suffixes of a bucket get a transform: their order, the common prefix of neighbours, and the bytes before them;
* transforms are merged in pairs. The interleave of two starts as one source after the other and is refined by ``WORD`` bytes a
  round, in those intervals only that hold suffixes of both: each source's common prefixes tell where its next bytes change, so
  just the first suffix of each run is read, and whole runs are woven. No suffix is sorted again. Where neighbours part, their
  common prefix is known; an interval of one source keeps what that source knew;
* then the order is extended to the left as by the last-to-first mapping: the preceding byte (the transform's symbol) of
  every suffix refines the classes of equal left contexts by one byte a round. A window ``t`` bytes to the left of its
  anchor is repeated if another suffix has the same ``t`` symbols and a common prefix of ``length - t`` or more.

A bucket beyond ``SHARD`` suffixes is dealt to several tasks, so that none holds an unbounded bucket; what their merged
transforms leave open is settled by digests of their distinct windows. Windows go back to their texts as runs of starts.

Defined results: null text is empty; texts shorter than ``length`` stay whole; matches never cross documents; equal texts
are kept once as evidence and, from ``length`` bytes on, wholly removed. Other columns are ignored. An empty table gives no
rows. Texts are known by their 128-bit MD5, as two numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, ship, stored, table_of

LENGTH, SPAN, BLOCK = 200, 120, 24
SEGMENT = 1 << 20
SHARD, PART = 65_536, 4096
WORD = 8
TOGETHER = 16_384
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], length: int, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """Text number, anchor, first and last window start, and hash of the bytes that follow, per anchor that stands for windows."""
    empty = np.zeros(0, np.int64)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buffer)
    ends = np.cumsum([len(t) for t in texts]) if texts else empty
    begins = ends - np.array([len(t) for t in texts], np.int64) if texts else empty
    if n < length:
        return empty, empty, empty, empty, empty
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    blocks = mix((total[BLOCK:] - total[:-BLOCK]) * down[: n - BLOCK + 1])
    value = (blocks & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(blocks), dtype=np.uint64)
    owner = (least_of(value, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)[: n - length + 1]
    start = np.arange(len(owner))
    text = np.searchsorted(ends, start, side="right")
    valid = start + length <= ends[np.minimum(text, len(ends) - 1)]
    start, owner, text = start[valid], owner[valid], text[valid]
    if not start.size:
        return empty, empty, empty, empty, empty
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    a, own = owner[new], text[new]
    key = empty
    if hashed:
        key = mix((total[a + (length - SPAN + 1)] - total[a]) * down[a]).view(np.int64)
    return own, a - begins[own], start[new] - begins[own], start[last] - begins[own], key


def segments(text: bytes, length: int) -> list[tuple[int, bytes]]:
    """Stretches of a text such that each window lies in exactly one of them."""
    return [(i, text[i : i + SEGMENT + length - 1]) for i in range(0, max(1, len(text) - length + 1), SEGMENT)]


PLACES = pa.schema([("tid", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("key", pa.int64())])
PLACES_DDL = "tid long, n long, anchor long, first long, last long, key long"


def _places(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            tid, n = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("tid", "n"))
            parts = [(k, i, part) for k, text in enumerate(batch.column("text").to_pylist()) for i, part in segments(text or b"", length)]
            at = 0
            while at < len(parts):  # a long text comes in several calls
                stop, size = at, 0
                while stop < len(parts) and (stop == at or size + len(parts[stop][2]) <= SEGMENT + length):
                    size += len(parts[stop][2])
                    stop += 1
                own, a, first, last, key = anchors([p[2] for p in parts[at:stop]], length)
                row, base = (np.array([p[c] for p in parts[at:stop]], np.int64)[own] for c in (0, 1))
                yield table_of(PLACES, tid[row], n[row], a + base, first + base, last + base, key)
                at = stop

    return run


CONTEXTS = pa.schema([
    ("key", pa.int64()), ("shard", pa.int64()), ("shards", pa.int64()), ("tid", pa.int64()), ("n", pa.int64()), ("first", pa.int64()),
    ("left", pa.int32()), ("context", pa.binary()),
])
CONTEXTS_DDL = "key long, shard long, shards long, tid long, n long, first long, left int, context binary"


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20):
            rows = []
            for tid, n, text, live in zip(*(batch.column(c).to_pylist() for c in ("tid", "n", "text", "live")), strict=True):
                for x in live:
                    first, a = x["first"], x["anchor"]
                    rows.append((x["key"], (tid ^ a) % x["shards"], x["shards"], tid, n, first, a - first, text[first : x["last"] + length]))
            if rows:
                yield table_of(CONTEXTS, *zip(*rows, strict=True))

    return run


def _matrix(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Row i: ``size[i]`` bytes from ``begin[i]`` on, forwards or backwards, then zeros."""
    column = np.arange(width)
    out = flat[np.clip(begin[:, None] + step * column, 0, len(flat) - 1)]
    out[column >= size[:, None]] = 0
    return out


def _words(right: np.ndarray) -> np.ndarray:
    """The bytes of each row in words that compare as the bytes do."""
    m, width = right.shape
    padded = np.zeros((m, -(-width // WORD) * WORD), np.uint8)
    padded[:, :width] = right
    return padded.view(">u8").astype(np.uint64)


def _parted(value: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many bytes of two words agree, from the first on."""
    return ((value ^ other).astype(">u8").view(np.uint8).reshape(-1, WORD) != 0).argmax(axis=1)


def transform(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by group and bytes, and each one's common prefix with the one before it (-1 between groups)."""
    order = np.argsort(group, kind="stable")
    head = np.concatenate([[True], group[order][1:] != group[order][:-1]])  # first of an interval
    common = np.where(head, -1, words.shape[1] * WORD)
    for b in range(words.shape[1]):
        interval = np.cumsum(head) - 1
        at = np.flatnonzero(np.bincount(interval)[interval] > 1)
        if not at.size:
            break
        value = words[order[at], b]
        local = np.lexsort((value, interval[at]))
        order[at], value = order[at[local]], value[local]
        differs = np.zeros(len(at), bool)
        differs[1:] = ~head[at[1:]] & (value[1:] != value[:-1])  # intervals keep their places
        k = np.flatnonzero(differs)
        common[at[k]] = WORD * b + _parted(value[k], value[k - 1])
        head[at[k]] = True
    return order, common


def interleave(pair: np.ndarray, source: np.ndarray, words: np.ndarray, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the two transforms of each pair: ``order`` has their suffixes one source after the other, ``common`` each source's prefixes."""
    full = words.shape[1] * WORD
    order, own = order.copy(), common.copy()
    head = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
    common = np.where(head, -1, full)
    for b in range(words.shape[1] + 1):
        interval = np.cumsum(head) - 1
        second = np.bincount(interval, weights=source[order])[interval]
        mixed = (second > 0) & (second < np.bincount(interval)[interval])
        at = np.flatnonzero(mixed)
        if b == words.shape[1] or not at.size:
            break
        # Runs: suffixes of one source and interval whose next word is the same, as the source's own prefixes tell.
        side, place = source[order[at]], interval[at]
        first = (own[at] < WORD * (b + 1)) | head[at]
        first[1:] |= side[1:] != side[:-1]
        run = np.flatnonzero(first)
        size = np.diff(np.append(run, len(at)))
        value, place = words[order[at[run]], b], place[run]
        woven = np.lexsort((side[run], value, place))
        size, value, place, run = size[woven], value[woven], place[woven], run[woven]
        begin = np.cumsum(size) - size
        moved = np.arange(len(at)) + np.repeat(run - begin, size)
        order[at], own[at] = order[at[moved]], own[at[moved]]
        k = np.flatnonzero((place[1:] == place[:-1]) & (value[1:] != value[:-1])) + 1
        common[at[begin[k]]] = WORD * b + _parted(value[k], value[k - 1])
        head[at[begin[k]]] = True
    return order, np.where(head | mixed, common, own)


def merged(group: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of each group's suffixes, from transforms of ``PART`` suffixes merged in pairs."""
    words = _words(right)
    by_group = np.argsort(group, kind="stable")
    new = np.concatenate([[True], group[by_group][1:] != group[by_group][:-1]])
    part = np.empty(len(group), np.int64)
    part[by_group] = (np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))) // PART
    wide = int(part.max()) + 1
    order, common = transform(group * wide + part, words)
    while part.any():
        source, part = part & 1, part >> 1
        order, common = interleave(group * wide + part, source, words, order, common)
    return order, np.minimum(common, right.shape[1])


def repeated(group: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix and distance ``t``: whether its window is there, and whether another suffix of the group has it too.

    ``left`` has the bytes before the anchor, nearest first.
    """
    m = len(group)
    order, common = merged(group, right)
    group, left, n_left, n_right = group[order], left[order], n_left[order], n_right[order]
    twice = np.zeros((m, SPAN), bool)
    symbols = np.unique(group, return_inverse=True)[1].astype(np.int64)
    live = np.arange(m)
    column = np.arange(SPAN)
    there = (column <= n_left[:, None]) & (length - column <= n_right[:, None])
    for t in range(SPAN):
        if t:
            longer = n_left[live] >= t
            live, symbols = live[longer], symbols[longer]
            if not live.size:
                break
            symbols = np.unique(symbols * 256 + left[live, t - 1], return_inverse=True)[1]
        prefix = np.cumsum(common < length - t)[live]
        ok = there[live, t]
        pair = symbols[ok] * (m + 1) + prefix[ok]
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        twice[live[ok], t] = count[inverse] > 1
        partner = np.bincount(symbols)[symbols] > 1  # a suffix alone in its left class has no partner further left
        live, symbols = live[partner], symbols[partner]
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)
    return there[back], twice[back]


FOUND = pa.schema([("tid", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("digest", pa.binary()), ("sure", pa.bool_())])
FOUND_DDL = "tid long, n long, first long, last long, digest binary, sure boolean"


def _settle(table: pa.Table, length: int) -> pa.RecordBatch:
    key, shard, shards, tid, n, first, n_left = (table.column(c).to_numpy() for c in ("key", "shard", "shards", "tid", "n", "first", "left"))
    texts = table.column("context").to_pylist()
    flat = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    n_left = n_left.astype(np.int64)
    group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])]))
    right = _matrix(flat, begin + n_left, size - n_left, length, 1)
    left = _matrix(flat, begin + n_left - 1, n_left, SPAN, -1)
    there, twice = repeated(group, left, n_left, right, size - n_left, length)
    # Runs of starts: start = first + n_left - t, so falling t is rising start.
    run = np.zeros((len(twice), SPAN + 2), np.int8)
    run[:, 1:-1] = twice[:, ::-1]
    edge = np.diff(run, axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    base = first[row] + n_left[row] - (SPAN - 1)
    out = [tid[row], n[row], base + low, base + high, [None] * len(row), np.ones(len(row), bool)]
    row, t = np.nonzero(there & (shards[:, None] > 1))
    if row.size:
        seen, more = set(), []
        for i, d in zip(row.tolist(), t.tolist(), strict=True):
            at = int(n_left[i]) - d
            digest = hashlib.blake2b(texts[i][at : at + length], digest_size=16).digest()
            sure = bool(twice[i, d])
            if sure and (group[i], digest) in seen:
                continue
            seen.add((group[i], digest))
            more.append((tid[i], n[i], int(first[i]) + at, int(first[i]) + at, digest, sure))
        out = [[*a, *b] for a, b in zip(out, zip(*more, strict=True), strict=True)]
    return table_of(FOUND, *out)


def _merge(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < TOGETHER:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, shard = table.column("key").to_numpy(), table.column("shard").to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (shard[1:] != shard[:-1])) + 1
            if cut.size:  # the last group may go on
                yield _settle(table.slice(0, cut[-1]), length)
                table = table.slice(cut[-1])
            held = table.to_batches()
        if sum(b.num_rows for b in held):
            yield _settle(pa.Table.from_batches(held).combine_chunks(), length)

    return run


KEPT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
])
KEPT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>, kept binary"


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for doc, text, copies, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copies", "runs")), strict=True):
                text, spans = text or b"", []
                if copies > 1 and len(text) >= length:
                    spans = [(0, len(text))]
                else:
                    for r in sorted(runs or [], key=lambda r: r["first"]):
                        if spans and r["first"] <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], r["last"] + length))
                        else:
                            spans.append((r["first"], r["last"] + length))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                places = [{"start": a, "end": b} for a, b in spans]
                rows.append((doc, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), places, rest if with_text else None))
            yield table_of(KEPT, *zip(*rows, strict=True))

    return run


def _half(start: int) -> Column:
    """Half of the text's MD5 as a signed number."""
    return F.conv(F.substring(F.md5("text"), start, 16), 16, -10).cast("long")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """Per document: bytes, bytes and runs removed, digest of the rest, the runs, and the rest itself unless ``with_text`` is off."""
    if length < SPAN + BLOCK:
        raise ValueError(f"length must be at least {SPAN + BLOCK}")
    ship(docs.sparkSession)
    table = as_bytes(docs).withColumn("text", F.coalesce("text", F.lit(b"")))
    table = table.select("doc_id", "text", _half(1).alias("tid"), _half(17).alias("n"))
    places = stored(table.select("tid", "n", "text").mapInArrow(_places(length), PLACES_DDL), "places")
    keys = places.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    keys = keys.select("key", F.ceil(F.col("size") / SHARD).alias("shards"))
    live = places.join(keys, "key").groupBy("tid", "n").agg(F.collect_set(F.struct("key", "shards", "anchor", "first", "last")).alias("live"))
    copies = table.groupBy("tid", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"))
    known = stored(copies.join(live, ["tid", "n"], "left"), "live")
    speakers = table.join(known.where("live IS NOT NULL"), ["tid", "n"]).where(F.col("doc_id").eqNullSafe(F.col("one")))
    contexts = speakers.select("tid", "n", "text", "live").mapInArrow(_contexts(length), CONTEXTS_DDL)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(partitions, "key", "shard").sortWithinPartitions("key", "shard")
    found = stored(dealt.mapInArrow(_merge(length), FOUND_DDL), "found")
    across = found.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("seen")).where("seen > 1").select("digest")
    merged = found.where("digest IS NOT NULL AND NOT sure").join(across, "digest").select("tid", "n", "first", "last")
    runs = found.where("digest IS NULL").select("tid", "n", "first", "last").unionByName(merged)
    runs = runs.groupBy("tid", "n").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    result = table.join(known.select("tid", "n", "copies").join(runs, ["tid", "n"], "left"), ["tid", "n"])
    return result.select("doc_id", "text", "copies", "runs").mapInArrow(_cut(length, with_text), KEPT_DDL)
