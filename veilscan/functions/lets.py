"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SP, SPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def either(test: Column, yes: Column, no: Column | None = None) -> Column:
    """``yes`` where the test holds, else ``no``: a plain branch, which costs less inside arrays than a CASE of one case."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.call_function("if", test, as_column(yes), as_column(no))


def sql_text(value: str) -> str:
    """A string literal for a SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_value(value: str | int | float | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return sql_text(value) if isinstance(value, str) else f"{value!r}{'D' if isinstance(value, float) else ''}"


def literal_array(values: list) -> Column:
    """A constant array, spelled as one SQL expression rather than call by call."""
    return F.expr(f"array({', '.join(_sql_value(v) for v in values)})")


def literal_map(table: dict) -> Column:
    return F.expr(f"map({', '.join(f'{_sql_value(k)}, {_sql_value(v)}' for k, v in table.items())})")


def lookup(table: dict, key: Column) -> Column:
    """Value of a constant table, null where the key is missing."""
    return F.element_at(literal_map(table), key)


def fixed(value: Column) -> Column:
    """A column the optimizer must compute where it stands; for the top of a projection, once in each.

    Filters on a costly column would otherwise be pushed below it with the whole expression copied into them, and explode
    adds such a filter by itself. As the only element of an exploded array the value comes out of a generator: filters on
    it stay above, and filters on the input's columns still pass through to the source. The outer form adds no filter.
    """
    return F.explode_outer(F.array(value))


def strip(text: Column) -> Column:
    """Trim with the full white-space class."""
    left = F.regexp_replace(text, f"^[{SPACE}]++", "")
    return F.regexp_replace(left, f"(?<![{SPACE}])[{SPACE}]++\\z", "")


def padded(text: Column) -> Column:
    """Whether white space stands at an end, so that there is something to strip."""
    return F.substring(text, 1, 1).rlike(SP) | F.substring(text, -1, 1).rlike(SP)


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(text, F.lit(word))
    return out


def distinct_sorted_by_length(items: Column, text_field: str) -> Column:
    """Distinct structs, longest text first, ties in first-seen order."""
    ranked = F.sort_array(
        F.transform(
            F.array_distinct(items),
            lambda x, i: F.struct((-F.char_length(x[text_field])).alias("n"), i.alias("i"), x.alias("x")),
        )
    )
    return F.transform(ranked, lambda r: r["x"])
