"""Spans that come as rows: interval join, and overlap resolution for texts with more spans than one row should hold.

Positions are cut into buckets of a fixed width, and a span stands in each bucket it touches, so an overlap is an equi-join on (text,
bucket). A pair is reported in one bucket only: that of the later of both starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.lets import fixed
from ..functions.spans import risk_rank
from ..session import stored

WIDTH = 32
#: Spans of one text that are settled within one row.
FEW = 256


def in_buckets(spans: DataFrame, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """A row per span and bucket it touches."""
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    return spans.withColumn("_bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _met(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, DataFrame, Column]:
    others = [c for c in right.columns if c not in keys]
    a = in_buckets(left, width).alias("a")
    b = in_buckets(right.select(*keys, *[F.col(c).alias(f"other_{c}") for c in others]), width, "other_start", "other_end").alias("b")
    met = F.col("a._bucket") == F.col("b._bucket")
    for key in keys:
        met = met & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    return a, b, met & (F.col("a.start") < F.col("other_end")) & (F.col("other_start") < F.col("a.end"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """Pairs of overlapping spans of one text; columns of ``right`` other than ``keys`` get the prefix ``other_``.

    Both sides have ``start`` and ``end`` (half open, not empty). The output holds every overlapping pair, so one side should be
    free of overlaps in itself where texts may be crowded. A null key is a key like any other.
    """
    a, b, overlap = _met(left, right, keys, width)
    here = F.floor(F.greatest("a.start", "other_start") / width) == F.col("a._bucket")
    names = [c for c in right.columns if c not in keys]
    return a.join(b, overlap & here).select(*[F.col(f"a.{c}") for c in left.columns], *[f"other_{c}" for c in names])


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], span_id: str, width: int = WIDTH) -> DataFrame:
    """Ids of the spans of ``left`` that overlap any of ``right``, perhaps more than once each."""
    a, b, overlap = _met(left, right, keys, width)
    return a.join(b, overlap, "left_semi").select(span_id)


def strength() -> Column:
    """Sorts the stronger finding first: risk, then length, then position, then rule id."""
    return F.struct(
        (-risk_rank(F.col("risk_level"))).alias("risk"), (F.col("start") - F.col("end")).alias("length"), F.col("start").alias("start"),
        F.col("rule_id").alias("rule_id"), F.col("span_id").alias("span_id"),
    )


def _settled(ranked: Column, array_type: DataType) -> Column:
    """Of the spans of one text, the strongest first, those that overlap none taken before."""
    return F.aggregate(
        ranked,
        F.array().cast(array_type),
        lambda taken, s: F.when(F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), taken).otherwise(
            F.concat(taken, F.array(s))
        ),
    )


def _in_rounds(left: DataFrame, keys: list[str], columns: list[str], width: int) -> DataFrame:
    kept = left.limit(0)
    while not left.isEmpty():
        placed = in_buckets(left, width).withColumn("_rank", strength())
        leaders = placed.groupBy(*keys, "_bucket").agg(F.min("_rank")["span_id"].alias("span_id"))
        led = leaders.groupBy("span_id").agg(F.count("*").alias("_led"))
        n_buckets = F.floor((F.col("end") - 1) / width) - F.floor(F.col("start") / width) + 1
        marked = left.join(led, "span_id", "left").withColumn("_keep", F.coalesce(F.col("_led") == n_buckets, F.lit(False)))
        marked = stored(marked.select(*columns, "_keep"), "marked-spans")
        new, rest = marked.where("_keep").drop("_keep"), marked.where("NOT _keep").drop("_keep")
        gone = overlapping(rest, new.select(*keys, "start", "end"), keys, "span_id", width)
        left = stored(rest.join(gone, "span_id", "left_anti").select(*columns), "open-spans")
        kept = kept.unionByName(new)
        width = max(1, width // 2)
    return kept


def resolve_span_rows(spans: DataFrame, keys: list[str], width: int = WIDTH, few: int = FEW) -> DataFrame:
    """The strongest of overlapping spans, as :func:`functions.spans.resolve_overlaps` keeps them, for spans that come as rows.

    ``spans`` has ``keys``, ``start``, ``end``, ``rule_id``, ``risk_level`` and ``span_id``, unique in the table, which also orders
    what is equal otherwise. The spans of a text with at most ``few`` of them are gathered and settled in one step. Texts with more
    go through rounds: in each, the strongest open span of every bucket is found by an aggregate; one that leads all its buckets is
    kept, and what overlaps it goes by an interval join. Kept spans do not overlap, so a bucket row meets few of a round. Buckets
    get narrower by half each round, down to single characters, where a span waits only for stronger ones that truly overlap it. No
    such text is in one task: its buckets are spread. Rounds end when nothing is open; each is written to the work folder. A text
    that holds a ``span_id`` twice takes the rounds too, where rows of one id stay or go together.
    """
    columns = [*keys, "start", "end", "rule_id", "risk_level", "span_id"]
    valid = stored(spans.where("start >= 0 AND end > start").select(*columns), "open-spans")
    crowded = stored(valid.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > few), "crowded-texts")
    crowded = crowded.select(*[F.col(key).alias(f"_{i}") for i, key in enumerate(keys)])
    own = F.lit(True)
    for i, key in enumerate(keys):
        own = own & valid[key].eqNullSafe(crowded[f"_{i}"])
    ranked = F.struct(*[strength()[c].alias(c) for c in ("risk", "length", "start", "rule_id", "span_id")], "end", "risk_level")
    texts = valid.join(crowded, own, "left_anti").groupBy(*keys).agg(F.sort_array(F.collect_list(ranked)).alias("_spans"))
    twice = F.size("_spans") > F.size(F.array_distinct(F.transform("_spans", lambda s: s["span_id"])))
    settled = F.when(twice, F.col("_spans")).otherwise(_settled(F.col("_spans"), texts.schema["_spans"].dataType))
    texts = texts.select(*keys, twice.alias("_twice"), fixed(settled).alias("_spans"))
    rows = stored(texts.select(*keys, "_twice", F.explode("_spans").alias("_s")).select("_twice", *keys, *[f"_s.{c}" for c in columns[len(keys) :]]), "settled-spans")
    left = stored(valid.join(crowded, own, "left_semi").unionByName(rows.where("_twice").drop("_twice")), "open-spans")
    return rows.where("NOT _twice").drop("_twice").unionByName(_in_rounds(left, keys, columns, width))
