"""Merkle manifest of a table, with retained hash states: a changed row is folded to the root without its left siblings.

Rows are leaves, grouped by a column; each group is a tree over its leaves in rank order, and the groups' roots are the
leaves of one more tree. A parent is the digest of its children's digests, ``fanout`` at a time, and keeps a copy of its hash
state before each child slot. Folding takes up the state of the slot that the path goes through, adds the replaced digest
and the siblings to its right, and so on upwards; what stands to the left is in the state already.

Spark ranks all leaves by range partitions (numbers inside a partition, plus what the partitions before hold of the group),
so no group is ever in one task. Levels are built block by block (at most ``BLOCK`` neighbours of one level), each round
shrinks every group by that factor, and paths are handed down the same blocks: a block gets the path above it once, and its
nodes share it. All levels are small tables, written below the checkpoint folder.

Defined results: a null field is ``-``, any other its UTF-8 byte count, ``:`` and its value. Null ids rank first; equal ids
rank by leaf, and rows equal in both are interchangeable. A null group is a group of its own and ranks first. Empty texts
count 0 bytes. An empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored
from .sha_states import absorb, finish, fresh

BLOCK = 4096
DIGEST, FOLD = "binary", "array<struct<state: binary, count: int, rights: binary>>"
FOLD_TYPE = pa.list_(pa.struct([("state", pa.binary()), ("count", pa.int32()), ("rights", pa.binary())]))
NODES = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("hash", pa.binary())])
NODES_DDL = "grp string, idx long, n long, hash binary"
PATHS = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("subroot", pa.binary()), ("tail", pa.binary()), ("fold", FOLD_TYPE)])
PATHS_DDL = f"grp string, idx long, subroot binary, tail binary, fold {FOLD}"
FOLDED = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])
FOLDED_DDL = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def _local_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a sorted partition inside each group."""
    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        grp = np.array(batch.column("grp").to_pylist(), object)
        new = np.concatenate([[grp[0] != last], grp[1:] != grp[:-1]])
        starts = np.flatnonzero(new)
        at = np.arange(len(grp))
        local = at - np.where(starts.size, starts[np.maximum(np.cumsum(new) - 1, 0)] if starts.size else 0, 0)
        first = starts[0] if starts.size else len(grp)
        local[:first] = held + at[:first]
        last, held = grp[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(grp), part), pa.int32()), pa.array(local, pa.int64())], names=[*batch.schema.names, "part", "local"]
        )


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with a string ``grp`` that is never null) plus ``idx``, the rank in the group, and ``n``, the group's size."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", part int, local long"
    # Rows alike in all of these would share one range: their place in the input, a written table, sets them apart.
    spread = rows.withColumn("_place", F.monotonically_increasing_id())
    keys = ["grp", *order, "_place"]
    placed = stored(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place").mapInArrow(_local_numbers, ddl), name)
    before = Window.partitionBy("grp").orderBy("part")
    offsets = placed.groupBy("grp", "part").agg(F.count("*").alias("held")).select(
        "grp", "part", (F.sum("held").over(before) - F.col("held")).alias("offset"), F.sum("held").over(Window.partitionBy("grp")).alias("n")
    )
    return placed.join(offsets, ["grp", "part"]).withColumn("idx", F.col("offset") + F.col("local")).drop("part", "local", "offset")


def levels_in_block(fanout: int) -> int:
    return max(1, next(k for k in range(64) if fanout ** (k + 1) > BLOCK))


def height(n: int, fanout: int) -> int:
    return next(k for k in range(64) if fanout**k >= n)


class Tree:
    """All levels of one block: digests, and per parent the number of children and the state before each slot."""

    def __init__(self, leaves: np.ndarray, levels: int, fanout: int):
        self.fanout, self.digests, self.states, self.counts = fanout, [leaves], [], []
        for _ in range(levels):
            children = self.digests[-1]
            n = -(-len(children) // fanout)
            counts = np.full(n, fanout)
            counts[-1] = len(children) - fanout * (n - 1)
            slots = [fresh(n)]
            for j in range(fanout):
                own = children[j::fanout]
                after = slots[-1].copy()
                after[: len(own)] = absorb(after[: len(own)], own)
                slots.append(after)
            self.states.append(slots[:-1])
            self.counts.append(counts)
            self.digests.append(finish(slots[-1], counts))

    def tails(self, above: bytes) -> list[bytes]:
        """Per leaf, the siblings on its way up as hexadecimal text, and then ``above``."""
        out = [above]
        for children in reversed(self.digests[:-1]):
            text, f = [d.tobytes().hex().encode() for d in children], self.fanout
            out = [b"".join(text[i - i % f : i] + text[i + 1 : i - i % f + f]) + out[i // f] for i in range(len(text))]
        return out

    def folds(self, above: list[dict]) -> list[list[dict]]:
        """Per leaf, the steps on its way up: state before its slot, the parent's number of children, right siblings."""
        out = [above]
        for level in range(len(self.states) - 1, -1, -1):
            children, f, rows = self.digests[level], self.fanout, []
            for i in range(len(children)):
                p, slot = divmod(i, f)
                step = {
                    "state": self.states[level][slot][p].tobytes(), "count": int(self.counts[level][p]),
                    "rights": children[i + 1 : (p + 1) * f].tobytes(),
                }
                rows.append([step, *out[p]])
            out = rows
        return out

    def folded(self, leaves: np.ndarray) -> np.ndarray:
        """The block's root, per leaf, with that leaf in place of its own."""
        value, at, f = leaves, np.arange(len(leaves)), self.fanout
        for level, states in enumerate(self.states):
            parent, slot = np.divmod(at, f)
            children, counts = self.digests[level], self.counts[level][parent]
            state = np.stack(states)[slot, parent]
            state = absorb(state, value)
            for j in range(1, f):
                right = (slot < j) & (j < counts)
                state[right] = absorb(state[right], children[parent[right] * f + j])
            value, at = finish(state, counts), parent
        return value


def fold_on(values: np.ndarray, steps: list[dict]) -> np.ndarray:
    """Resume the states of a path that all rows share."""
    for step in steps:
        state = absorb(np.tile(np.frombuffer(step["state"], np.uint32), (len(values), 1)), values)
        for right in np.frombuffer(step["rights"], np.uint8).reshape(-1, 32):
            state = absorb(state, np.broadcast_to(right, values.shape))
        values = finish(state, np.full(len(values), step["count"]))
    return values


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _tree(table: pa.Table, fanout: int, most: int) -> tuple[pa.Table, Tree]:
    table = table.sort_by("idx")
    levels = min(most, height(table.column("n")[0].as_py(), fanout))
    return table, Tree(_digests(table.column("hash")), levels, fanout)


def _up(fanout: int, most: int):
    span = fanout**most

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        _, tree = _tree(table, fanout, most)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [-(-n // span)], [tree.digests[-1][0].tobytes()]], schema=NODES)

    return run


def _down(fanout: int, most: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, above: pa.Table) -> pa.Table:
        table, tree = _tree(table, fanout, most)
        top = {c: above.column(c)[0].as_py() for c in ("subroot", "tail", "fold")}
        n = table.num_rows
        return pa.table(
            [[key[0].as_py()] * n, table.column("idx"), [top["subroot"]] * n, tree.tails(top["tail"]), tree.folds(top["fold"])], schema=PATHS
        )

    return run


def _finish(fanout: int, most: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, above: pa.Table) -> pa.Table:
        table, tree = _tree(table, fanout, most)
        top = {c: above.column(c)[0].as_py() for c in ("subroot", "tail", "fold")}
        value = fold_on(tree.folded(_digests(table.column("changed"))), top["fold"])
        n = table.num_rows
        return pa.table(
            [
                table.column("doc_id"), [d.hex() for d in table.column("hash").to_pylist()], [top["subroot"].hex()] * n,
                [hashlib.sha256(tail).hexdigest() for tail in tree.tails(top["tail"])], [v.tobytes().hex() for v in value],
            ],
            schema=FOLDED,
        )

    return run


class Forest:
    """The levels of the trees of all groups: ``levels[0]`` are the leaves, ``levels[-1]`` the roots."""

    def __init__(self, leaves: DataFrame, fanout: int, name: str):
        self.shape, self.name = (fanout, levels_in_block(fanout)), name
        self.span = fanout ** self.shape[1]
        self.levels = [leaves.select("grp", "idx", "n", "hash")]
        largest = leaves.agg(F.max("n")).first()[0] or 1
        while largest > 1:
            blocks = self.blocks(self.levels[-1]).groupBy("grp", "block").applyInArrow(_up(*self.shape), NODES_DDL)
            self.levels.append(stored(blocks, f"{name}-level"))
            largest = -(-largest // self.span)

    def blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("idx") / self.span).cast("long"))

    def handed_down(self, nodes: DataFrame, paths: DataFrame, step, ddl: str) -> DataFrame:
        above = paths.withColumnRenamed("idx", "block").groupBy("grp", "block")
        return self.blocks(nodes).groupBy("grp", "block").cogroup(above).applyInArrow(step, ddl)

    def paths(self, roots: DataFrame, down_to: int) -> DataFrame:
        """Paths of the nodes of a level, from those of the roots."""
        for level in range(len(self.levels) - 2, down_to - 1, -1):
            roots = stored(self.handed_down(self.levels[level], roots, _down(*self.shape), PATHS_DDL), f"{self.name}-paths")
        return roots


def folded_manifest(leaves: DataFrame, fanout: int = 2) -> DataFrame:
    """Per leaf (``grp``, ``doc_id``, ``hash``, and ``changed``, the digest that takes its place): its digest, its group's root, the
    root of all, the digest of its proof, and the root that folding the changed digest gives."""
    spark = leaves.sparkSession
    ship(spark)
    placed = stored(ranked(leaves, ["doc_id", "hash"], "leaves-sorted"), "leaves")
    groups = Forest(placed, fanout, "leaves")
    subroots = ranked(groups.levels[-1].select("grp", "hash").withColumns({"name": F.col("grp"), "grp": F.lit("")}), ["name"], "groups-sorted")
    subroots = stored(subroots, "groups")
    top = Forest(subroots, fanout, "groups")
    root = next((r["hash"] for r in top.levels[-1].select("hash").collect()), None)  # one row at most
    start = top.levels[-1].select("grp", "idx", F.col("hash").alias("subroot"), F.lit(b"").alias("tail"), F.expr(f"CAST(array() AS {FOLD})").alias("fold"))
    above = top.paths(start, 0).drop("subroot", "grp").join(subroots.select("idx", "name", F.col("hash").alias("subroot")), "idx")
    above = above.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "subroot", "tail", "fold")
    above = groups.paths(above, 1)
    if len(groups.levels) == 1:  # every group is one leaf
        last = placed.withColumn("block", F.col("idx")).groupBy("grp", "block").cogroup(above.withColumnRenamed("idx", "block").groupBy("grp", "block"))
        out = last.applyInArrow(_finish(*groups.shape), FOLDED_DDL)
    else:
        out = groups.handed_down(placed, above, _finish(*groups.shape), FOLDED_DDL)
    root_text = F.lit(root.hex() if root is not None else None).cast("string")
    return out.withColumn("root", root_text).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """Manifest of documents (doc_id, source, lang, n_chars, text; trees by lang), folded with some columns changed."""
    columns = {
        "doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"),
        "n_chars": F.col("n_chars").cast("long"), "text": F.col("text").cast("string"),
    }
    new = columns | (changed or {})
    same = F.lit(True)
    for name in columns:
        same = same & columns[name].eqNullSafe(new[name]) if new[name] is not columns[name] else same
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), columns["lang"]), F.lit("")).alias("grp"), columns["doc_id"].alias("doc_id"),
        row_digest(*columns.values()).alias("hash"), F.when(~same, row_digest(*new.values())).alias("changed"),
    )
    leaves = stored(leaves, "row-digests").withColumn("changed", F.coalesce("changed", "hash"))
    return folded_manifest(leaves, fanout)


def tampered() -> dict[str, Column]:
    """One more character claimed, where 7 divides the checksum of the id; the largest long and null stay as they are."""
    n, key = F.col("n_chars").cast("long"), F.col("doc_id").cast("long").cast("string")
    hit = F.coalesce(F.crc32(key.cast("binary")) % 7 == 0, F.lit(False))
    return {"n_chars": F.when(hit, F.coalesce(F.try_add(n, F.lit(1)), n)).otherwise(n)}
