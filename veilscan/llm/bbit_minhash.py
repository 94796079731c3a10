"""Near duplicates by b-bit MinHash.

A text's set holds the 64-bit codes of its distinct shingles of five lower-case words. Each of 128 hash functions gives a
minimum. Rows of four minima make the keys of 28 bands; texts that share a band key are candidates (a pair at similarity
0.75 is missed with a chance of 2e-5). Of every minimum only its low 4 bits are kept, 16 in a long, so a signature takes
64 bytes; equal fields are counted with bit operations and the share is corrected for chance collisions (2 ** -4). Pairs
whose estimate is five deviations below the threshold go no further; all others are confirmed on the full sets.

Texts with equal sets form a class and are not paired at all. In a bucket of many classes not all pairs are made:

1. each class meets the least and the greatest class of its buckets; its most similar one is tested first;
2. of the other such pairs only those between different components are tested;
3. what is left are buckets of four or more classes with several components: there, classes of different components meet
   in pairs of blocks, each a small matrix of estimates. There the estimate is followed by a bound from the
   classes' shingle codes cut to 32 bits (cutting can only merge codes, and how many is known), so that hardly any pair
   leaves the blocks that is not a link; these are tested like all others.

After that, any two classes that share a bucket are in one component or have been tested, so nothing is lost to a cap.
Components are found by alternating large and small stars over the links, in rounds stored below the checkpoint folder.

Defined results: null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component. Fewer than five words are one shingle. Rows with one id and text are one document and share their fate. A null
doc_id never is the smallest id; a component of such rows only has a null id, and its rows are kept. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, free_name, ship, stored, table_of

SHINGLE, HASHES, BITS, ROWS, BANDS = 5, 128, 4, 4, 28
THRESHOLD, MARGIN = (75, 100), 0.2
BLOCK = 1024
TOGETHER = 1 << 20  # text bytes hashed at a time
NIBBLES = 0x1111111111111111

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20)
FLIP = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64)
TIMES = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)

SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("text_md5", pa.binary()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
    ("signature", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())),
])
SIGNED_DDL = "doc_id long, text_md5 binary, n_shingles long, digest binary, signature array<long>, bands array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle codes per text."""
    buffer = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)] if texts else np.zeros(0, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~SPACE[buffer]
    start = np.flatnonzero(inside & np.append(True, ~inside[:-1])[: len(inside)])
    length = np.flatnonzero(inside & np.append(~inside[1:], True)) + 1 - start
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    power = np.cumprod(np.full(int(length.max(initial=0)) + 1, BASE, np.uint64))
    value = power[place] * (buffer[inside].astype(np.uint64) + np.uint64(1))
    word = mix(np.add.reduceat(value, np.cumsum(length) - length) if len(length) else np.zeros(0, np.uint64))
    word ^= length.astype(np.uint64) * BASE
    cut = np.concatenate([[0], np.searchsorted(start, ends)])
    code = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        code = code * BASE + word[k : k + len(code)]
    code = mix(code)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(code[a : b - SHINGLE + 1]))
        else:
            few = np.zeros(min(1, b - a), np.uint64)
            for k in range(a, b):
                few = few * BASE + word[k] + np.uint64(1)
            out.append(mix(few))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima per set; none of the sets may be empty."""
    codes, begin = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint64)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((codes ^ FLIP[j]) * TIMES[j], begin)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of minima, 16 to a long."""
    bits = ((low ^ (low >> np.uint64(32))) & np.uint64((1 << BITS) - 1)).reshape(len(low), -1, 64 // BITS)
    return (bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * BASE + rows[:, :, r])
    return key.view(np.int64)


def _lists(rows: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width, dtype=np.int32)), pa.array(rows.reshape(-1)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=TOGETHER):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        sets = shingle_sets(texts)
        full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
        low = np.zeros((len(sets), HASHES), np.uint64)
        if full.size:
            low[full] = minima([sets[i] for i in full])
        yield table_of(
            SIGNED, batch.column("doc_id"), [hashlib.md5(t).digest() for t in texts], [len(s) for s in sets],
            [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            _lists(packed(low), HASHES * BITS // 64), _lists(band_keys(low), BANDS),
        )


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, digest of the set, packed signature and band keys per document."""
    ship(docs.sparkSession)
    return as_bytes(docs).mapInArrow(_sign, SIGNED_DDL)


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from two packed signatures, corrected for fields that are equal by chance."""
    differing = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(NIBBLES)))
    chance = 2.0**-BITS
    return (1 - differing / F.lit(float(HASHES)) - chance) / (1 - chance)


def _close(a: str, b: str) -> Column:
    """Whether a pair may reach the threshold, by set sizes and estimate."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = F.least(n, m) * THRESHOLD[1] >= F.greatest(n, m) * THRESHOLD[0]
    return sizes & (estimate(F.col(f"{a}.signature"), F.col(f"{b}.signature")) >= THRESHOLD[0] / THRESHOLD[1] - MARGIN)


LINKED = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text_b", TOGETHER):
        a, b, left = (batch.column(c).to_pylist() for c in ("a", "b", "text_a"))
        unlike = list(dict.fromkeys(a))
        sets = dict(zip(unlike, shingle_sets([left[a.index(x)] for x in unlike]), strict=True))
        linked = []
        for x, y, other in zip(a, b, shingle_sets(batch.column("text_b").to_pylist()), strict=True):
            both = len(np.intersect1d(sets[x], other, assume_unique=True))
            if both * THRESHOLD[1] >= (len(sets[x]) + len(other) - both) * THRESHOLD[0]:
                linked.append((x, y))
        yield table_of(LINKED, [x for x, _ in linked], [y for _, y in linked])


CODES = pa.schema([("cid", pa.binary()), ("codes", pa.list_(pa.int32()))])


def _short_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = shingle_sets(batch.column("text").to_pylist())
        yield table_of(CODES, batch.column("cid"), [np.unique((s >> np.uint64(32)).astype(np.uint32).view(np.int32)) for s in sets])


def _block_pairs(rows: pa.Table) -> list[tuple[bytes, bytes]]:
    """Pairs of different components in one block pair of a bucket that may be links."""
    key, i, j = (rows.column(c)[0].as_py() for c in ("key", "i", "j"))
    block, n = (rows.column(c).to_numpy() for c in ("block", "n"))
    wide = lambda c: rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    signature, bands = wide("signature").view(np.uint64), wide("bands")
    cids, root = rows.column("cid").to_pylist(), np.unique(np.array(rows.column("root").to_pylist(), object), return_inverse=True)[1]
    left = np.flatnonzero(block == i)
    right = np.flatnonzero(block == j)
    unlike = np.zeros((len(left), len(right)), np.int16)
    for k in range(signature.shape[1]):
        x = signature[left, k, None] ^ signature[None, right, k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        unlike += np.bitwise_count(x & np.uint64(NIBBLES))
    chance = 2.0**-BITS
    like = (1 - unlike / HASHES - chance) / (1 - chance) >= THRESHOLD[0] / THRESHOLD[1] - MARGIN
    small, large = np.minimum(n[left, None], n[None, right]), np.maximum(n[left, None], n[None, right])
    like &= (root[left, None] != root[None, right]) & (small * THRESHOLD[1] >= large * THRESHOLD[0])
    a, b = np.nonzero(np.triu(like, 1) if i == j else like)
    a, b = left[a], right[b]
    shared = bands[a] == bands[b]  # a pair is looked at in its first common bucket only
    here = bands[a, shared.argmax(axis=1)] == key
    codes = rows.column("codes").to_pylist()
    sets: dict[int, frozenset] = {}
    out = []
    for x, y in zip(a[here].tolist(), b[here].tolist(), strict=True):
        for z in (x, y):
            if z not in sets:
                sets[z] = frozenset(codes[z])
        most = len(sets[x] & sets[y]) + min(n[x] - len(sets[x]), n[y] - len(sets[y]))
        if most * THRESHOLD[1] >= (n[x] + n[y] - most) * THRESHOLD[0]:
            out.append((cids[x], cids[y]))
    return out


def _test_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, i and j; a group has at most about two blocks."""
    held: list[pa.RecordBatch] = []

    def groups(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()]
        if last:
            cut.append(len(key))
        pairs = [p for x, y in zip(cut[:-1], cut[1:], strict=True) for p in _block_pairs(table.slice(x, y - x))]
        held = [] if last else table.slice(cut[-1]).to_batches()
        yield table_of(LINKED, [x for x, _ in pairs], [y for _, y in pairs])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from groups(False)
    if sum(b.num_rows for b in held):
        yield from groups(True)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    return stored(pairs.select("a", "b").join(right, "b").join(left, "a").mapInArrow(_confirm, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links but the roots themselves; the root is the least node."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")

    def stars(links: DataFrame) -> bool:
        """Whether each node has one root and no root is a node: then there is one star per component, around its least node."""
        twofold = links.groupBy("u").count().where("count > 1").select("u")
        return twofold.unionByName(links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")).isEmpty()

    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(own, end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_md5, n_shingles, class_id, component_id, kept`` per document."""
    signed = stored(signatures(docs), "signatures")
    classes = stored(
        signed.where("n_shingles > 0").groupBy(F.col("digest").alias("cid")).agg(
            F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"),
            F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "text_md5")).alias("source"),
        ), "classes",
    )
    keyed = classes.select("cid", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("cid").alias("low"), F.max("cid").alias("high")).where("size > 1")
    members = stored(keyed.join(buckets, "key"), "members")
    ends = classes.select("cid", F.struct("n", "signature").alias("own"))
    stars = members.select(F.explode(F.array("low", "high")).alias("a"), F.col("cid").alias("b")).where("a <> b").distinct()
    stars = stars.join(ends.select(F.col("cid").alias("a"), F.col("own").alias("left")), "a").join(
        ends.select(F.col("cid").alias("b"), F.col("own").alias("right")), "b"
    )
    stars = stored(
        stars.where(_close("left", "right")).select("a", "b", estimate(F.col("left.signature"), F.col("right.signature")).alias("like")), "pairs"
    )
    # Texts of the classes in buckets, one each.
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "source.*")
    whole = as_bytes(docs).withColumn("text_md5", F.unhex(F.md5("text")))
    own = wanted.select("cid", F.col("doc_id").alias("own_id"), F.col("text_md5").alias("own_md5"))
    texts = stored(
        whole.join(own, whole["doc_id"].eqNullSafe(own["own_id"]) & (whole["text_md5"] == own["own_md5"]))
        .groupBy("cid").agg(F.first("text").alias("text")), "texts",
    )

    first = stars.groupBy("b").agg(F.max_by("a", F.struct("like", "a")).alias("a")).select("a", "b")
    links = confirmed(first, texts)
    roots = components(links)
    rest = _apart(stars.join(first, ["a", "b"], "left_anti"), roots)
    roots = components(_as_links(roots).unionByName(confirmed(rest, texts)))

    crowd = members.where("size > 3").select("key", "cid", "size").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    crowd = crowd.select("key", "cid", "size", F.coalesce("root", "cid").alias("root"))
    mixed = crowd.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    crowd = stored(crowd.join(mixed, "key"), "crowd")
    short = texts.join(crowd.select("cid").distinct(), "cid", "left_semi").mapInArrow(_short_codes, "cid binary, codes array<int>")
    full = stored(classes.join(short, "cid").select("cid", F.struct("n", "signature", "bands", "codes").alias("own")), "codes")
    crowd = crowd.join(full, "cid")
    blocks = F.ceil(F.col("size") / BLOCK)
    crowd = crowd.withColumn("block", F.pmod(F.xxhash64("cid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    crowd = crowd.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "root", "own.n", "own.signature",
        "own.bands", "own.codes",
    )
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = crowd.repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    last = dealt.mapInArrow(_test_blocks, "a binary, b binary").distinct()
    tested = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = confirmed(last.join(tested, ["a", "b"], "left_anti"), texts)
    roots = components(_as_links(roots).unionByName(more))

    owner = classes.select("cid", "doc").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "cid", "doc", F.coalesce("root", "cid").alias("root")
    )
    heads = owner.groupBy("root").agg(F.min("doc").alias("head"))
    owner = stored(owner.join(heads, "root").select(F.col("cid").alias("digest"), "head"), "components")
    head = F.when(F.col("n_shingles") > 0, F.col("head")).otherwise(F.col("doc_id"))
    return signed.select("doc_id", "text_md5", "n_shingles", "digest").join(owner, "digest", "left").select(
        "doc_id", "text_md5", "n_shingles", F.lower(F.hex("digest")).alias("class_id"), head.alias("component_id"),
        F.col("doc_id").eqNullSafe(head).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of each component one row of the document with the smallest id."""
    row = free_name(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    first = rows.groupBy(F.col("doc_id").cast("long").alias("_id"), digest.alias("_md5")).agg(F.min(row).alias(row))
    gone = near_duplicates(rows).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_md5").alias("_gone_md5")).distinct()
    stay = first.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_md5") == F.col("_gone_md5")), "left_anti")
    return rows.join(stay.select(row), row, "left_semi").select(*docs.columns)
