"""Folds over long arrays, and membership, without a copy or a search of everything per element.

Spark copies the state of a fold after every element, so a fold that appends to an array costs the square of its length. Here a
fold runs in blocks of blocks: the inner state holds the output of a short block, and whole blocks are joined in few steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import either, let

BLOCK = 64


def empty(array_type: str) -> Column:
    return F.array().cast(array_type)


def parts(values: Column, size: int) -> Column:
    """The array cut into pieces of ``size``; one empty piece if it is empty."""
    starts = lambda v: F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(size))
    return let(values, lambda v: F.transform(starts(v), lambda i: F.slice(v, i + 1, size)))


def folded(
    values: Column, state: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], array_type: str, levels: int = 2
) -> Column:
    """Go through the array with a small state; ``emit(state, value)`` gives an array of outputs, and all of them come in one.

    ``step(state, value)`` is the next state. The type of the state must not change.
    """

    def run(values: Column, state: Column, level: int) -> Column:
        start = F.struct(state.alias("state"), empty(array_type).alias("out"))
        if level == 0:
            return F.aggregate(
                values,
                start,
                lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], emit(acc["state"], x)).alias("out")),
            )
        return F.aggregate(
            parts(values, BLOCK**level),
            start,
            lambda acc, block: let(
                run(block, acc["state"], level - 1),
                lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")),
            ),
        )

    # Most arrays are shorter than one block: they need no blocks around it.
    return let(values, lambda v: F.when(F.size(v) <= BLOCK, run(v, state, 0)["out"]).otherwise(run(v, state, levels)["out"]))


_FEW = 32


def is_in(keys: Column, wanted: Column) -> Column:
    """Per key (string), whether it is one of the wanted. A null key is not.

    Few are compared one by one; with more, both sides are sorted once and merged.
    """
    sides = F.sort_array(
        F.concat(
            F.transform(wanted, lambda w: F.struct(w.alias("key"), F.lit(0).alias("mine"), F.lit(-1).alias("at"))),
            F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.lit(1).alias("mine"), i.alias("at"))),
        )
    )
    hits = "array<struct<at:int,hit:boolean>>"
    found = folded(
        sides,
        F.lit(None).cast("string"),
        lambda last, s: either(s["mine"] == 0, s["key"], last),
        lambda last, s: either(s["mine"] == 0, empty(hits), F.array(F.struct(s["at"].alias("at"), F.coalesce(s["key"] == last, F.lit(False)).alias("hit")))),
        hits,
    )
    few = F.transform(keys, lambda k: F.coalesce(F.array_contains(wanted, k), F.lit(False)))
    return either((F.size(keys) <= _FEW) & (F.size(wanted) <= _FEW), few, F.transform(F.sort_array(found), lambda h: h["hit"]))


def first_of_each(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key (a string made by ``key``), in their order: one sort, no pairwise test."""
    keyed = F.sort_array(F.transform(values, lambda v, i: F.struct(key(v).alias("key"), i.alias("at"), v.alias("value"))))
    firsts = let(
        keyed,
        lambda k: F.filter(k, lambda x, i: (i == 0) | ~F.get(k, F.greatest(i - 1, F.lit(0)))["key"].eqNullSafe(x["key"])),
    )
    return F.transform(F.sort_array(F.transform(firsts, lambda x: F.struct(x["at"], x["value"]))), lambda x: x["value"])
