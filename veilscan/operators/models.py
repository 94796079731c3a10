"""Operators over model output tables: entity tokens and segment embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import context_fixed as C
from ..functions.lets import fixed, let, lookup, strip
from ..functions.patterns import SPACE
from ..session import stored


def segments(
    text: Column,
    max_input_chars: int | None = None,
    max_segments: int | None = None,
    max_segment_chars: int | None = None,
    min_segment_chars: int = 1,
) -> Column:
    """Distinct sentences of a text. The limits of a small model can be given; there are none of the engine's own."""
    head = text if max_input_chars is None else F.substring(text, 1, max_input_chars)
    found = F.regexp_extract_all(head, F.lit("(?<![^\\n。！？])[^\\n。！？]++(?:[。！？]|\\z)"), F.lit(0))
    whole = F.transform(found, strip)
    cut = whole if max_segment_chars is None else F.transform(whole, lambda s: F.substring(s, 1, max_segment_chars))
    kept = F.array_distinct(F.filter(cut, lambda s: F.char_length(s) >= min_segment_chars))
    return kept if max_segments is None else F.slice(kept, 1, max_segments)


def prototype_texts(spark) -> DataFrame:
    rows = [(i, p[0], C.TOPIC_PREFIX + p[4]) for i, p in enumerate(C.PROTOTYPES)]
    return spark.createDataFrame(rows, "position int, category string, text string")


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x))
    return F.when((norm == 0) | F.isnan(norm) | (norm == F.lit(float("inf"))), F.transform(v, lambda x: F.lit(0.0))).otherwise(
        F.transform(v, lambda x: x / norm)
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


BEST_TYPE = "struct<similarity:double,position:int,category:string,next:double>"


def _better(sim: Column, p: Column, best: Column) -> Column:
    """Larger similarity, then earlier position, then category."""
    same = sim == best["similarity"]
    return (
        best["position"].isNull()
        | (sim > best["similarity"])
        | (same & (p["position"] < best["position"]))
        | (same & (p["position"] == best["position"]) & (p["category"] < best["category"]))
    )


def _best_of(unit: Column, prototypes: Column, start: Column) -> Column:
    """Best prototype, and the largest similarity among those of any other category: one pass, nothing is sorted."""

    def step(best: Column, p: Column) -> Column:
        # An empty vector has no size in common with any.
        sim = F.when(F.size(p["unit"]) != F.size(unit), F.lit(-1.0)).otherwise(_dot(unit, p["unit"]))

        def against(sim: Column) -> Column:
            other = ~p["category"].eqNullSafe(best["category"])
            first = best["position"].isNull()
            return F.when(
                _better(sim, p, best),
                F.struct(
                    sim.alias("similarity"),
                    p["position"].alias("position"),
                    p["category"].alias("category"),
                    F.when(other & ~first, best["similarity"]).otherwise(best["next"]).alias("next"),
                ),
            ).otherwise(
                F.struct(
                    best["similarity"].alias("similarity"),
                    best["position"].alias("position"),
                    best["category"].alias("category"),
                    F.when(other, F.greatest(best["next"], sim)).otherwise(best["next"]).alias("next"),
                )
            )

        return let(sim, against)

    return F.aggregate(prototypes, start, step)


def nearest_prototype(
    vectors: DataFrame,
    prototypes: DataFrame,
    embedding: str = "embedding",
    min_similarity: float = C.MIN_SIMILARITY,
    min_margin: float = C.MIN_SIMILARITY_MARGIN,
    block: int = 2_000,
) -> DataFrame:
    """Closest prototype per vector, with the margin to the next category and a confidence.

    ``prototypes`` has ``position``, ``category`` and ``embedding``, any number of rows, any number per category. They come in as
    arrays of about ``block`` by scalar subqueries, with no join; each block goes on from the best of the blocks before, so a row
    carries no more than that.
    """
    unit = _unit(F.col("embedding").cast("array<double>")).alias("unit")
    known = prototypes.select(F.col("position").cast("int").alias("position"), "category", unit)
    n_blocks = max(1, -(-prototypes.count() // block))
    if n_blocks > 1:
        known = stored(known, "prototypes")
    staged = vectors.withColumn("_unit", _unit(F.col(embedding).cast("array<double>"))).withColumn(
        "_best", F.lit(None).cast(BEST_TYPE)
    )
    nothing = F.struct(
        F.lit(-1.0).alias("similarity"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("category"), F.lit(-1.0).alias("next")
    )
    for k in range(n_blocks):
        own = known.where(F.pmod(F.xxhash64("position", "category"), F.lit(n_blocks)) == k) if n_blocks > 1 else known
        packed = own.agg(F.collect_list(F.struct("position", "category", "unit")).alias("packed"))
        best = _best_of(F.col("_unit"), F.col("_packed"), F.coalesce("_best", nothing))
        staged = staged.withColumn("_packed", packed.scalar()).withColumn("_best", fixed(F.when(F.size("_unit") > 0, best))).drop("_packed")
    best = F.col("_best")
    similarity_best = F.greatest(best["similarity"], F.lit(-1.0))
    similarity_next = F.coalesce(F.greatest(best["next"], F.lit(-1.0)), F.lit(-1.0))
    scaled = F.lit(0.7) + ((similarity_best - min_similarity) / max(1 - min_similarity, 0.01)) * F.lit(0.25)
    return (
        staged.withColumn("category", best["category"])
        .withColumn("similarity", similarity_best)
        .withColumn("margin", similarity_best - similarity_next)
        .withColumn(
            "accepted",
            F.coalesce(
                (similarity_best > -1)
                & (similarity_best >= min_similarity)
                & (similarity_best - similarity_next >= min_margin),
                F.lit(False),
            ),
        )
        .withColumn("confidence", F.greatest(F.lit(0.7), F.least(F.lit(0.95), scaled)))
        .drop("_unit", "_best")
    )


def semantic_candidates(classified: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Accepted segments as candidates, numbered per category in segment order.

    Needs ``position`` and ``surface`` of each segment; windows hold the segments of one text. A category without words of
    its own is named by itself.
    """
    table = {p[0]: p for p in C.PROTOTYPES}
    per_category = Window.partitionBy(*keys, "category").orderBy("position")
    per_text = Window.partitionBy(*keys).orderBy("position")
    own = lambda k: lookup({c: v[k] for c, v in table.items()}, F.col("category"))
    prefix = F.coalesce(own(3), F.upper("category"))
    numbered = (
        classified.where("accepted")
        .withColumn("_n", F.row_number().over(per_category).cast("string"))
        .withColumn("_rank", F.row_number().over(per_text))
    )
    if limit is not None:
        numbered = numbered.where(F.col("_rank") <= limit)
    return numbered.select(
        *keys,
        F.col("_rank").alias("position"),
        F.concat(F.lit("wasm-context-"), F.col("category"), F.lit("-"), F.col("_n")).alias("id"),
        "category",
        "surface",
        F.coalesce(own(1), F.col("category")).alias("label"),
        F.concat(F.coalesce(own(2), F.col("category")), F.lit(C.SEMANTIC_REASON_TAIL)).alias("reason"),
        F.lit("medium").alias("risk_level"),
        F.concat(F.lit("["), prefix, F.lit("_"), F.col("_n"), F.lit("]")).alias("suggested_placeholder"),
        "confidence",
        F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("end"),
    )


def entity_candidates(
    tokens: DataFrame,
    texts: DataFrame,
    key: str,
    text: str = "text",
    min_score: float = C.MIN_TOKEN_SCORE,
    limit: int | None = None,
    max_input_chars: int | None = None,
) -> DataFrame:
    """Join neighbouring tokens of one label into entity spans.

    Tokens carry ``key, index, entity, score, start, end``. A token takes from its text no more than the character before
    it; texts come back per span. Tokens beyond the text (or beyond ``max_input_chars``) are not valid.
    """
    whole_text = texts.select(key, F.col(text).alias("_text"))
    label = F.regexp_replace("entity", "^[BI]-", "")
    valid = (
        tokens.where((F.col("entity") != "O") & (F.col("score") >= min_score))
        .where(F.col("start").isNotNull() & F.col("end").isNotNull())
        .where((F.col("start") >= 0) & (F.col("end") > F.col("start")))
        .withColumn("_label", label)
        .where(F.col("_label").isin(list(C.ENTITY_TYPES)))
        .join(whole_text, key)
        .where(F.col("end") <= F.char_length("_text"))
        .select(key, "index", "_label", "score", "start", "end", F.substring(F.col("_text"), F.col("start"), F.lit(1)).alias("_before"))
    )
    if max_input_chars is not None:
        valid = valid.where(F.col("end") <= max_input_chars)
    by_text = Window.partitionBy(key).orderBy("index")
    joins = (
        (F.col("_prev_label") == F.col("_label"))
        & (F.col("start") >= F.col("_prev_end"))
        & (F.col("start") - F.col("_prev_end") <= 1)
        & ((F.col("start") == F.col("_prev_end")) | F.rlike("_before", F.lit(f"^[{SPACE}]\\z")))
    )
    islands = (
        valid.withColumn("_prev_label", F.lag("_label").over(by_text))
        .withColumn("_prev_end", F.lag("end").over(by_text))
        .withColumn("_break", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
        .withColumn("_island", F.sum("_break").over(by_text))
    )
    spans = islands.groupBy(key, "_island").agg(
        F.min_by("start", "index").alias("_from"),
        F.max_by("end", "index").alias("_to"),
        F.first("_label").alias("_label"),
        F.avg("score").alias("confidence"),
    )
    surface = F.substring(F.col("_text"), F.col("_from") + 1, F.col("_to") - F.col("_from"))
    spans = spans.join(whole_text, key).withColumn("_whole", surface).drop("_text")
    whole = F.col("_whole")
    lead = F.char_length(F.regexp_extract(whole, f"^[{SPACE}]*", 0))
    trimmed = (
        spans.withColumn("surface", strip(whole))
        .withColumn("start", F.col("_from") + lead)
        .withColumn("end", F.col("start") + F.char_length("surface"))
        .where(F.col("surface") != "")
        .withColumn("category", lookup({k: v[0] for k, v in C.ENTITY_TYPES.items()}, F.col("_label")))
    )
    same_span = Window.partitionBy(key, "category", "start", "end").orderBy("_island")
    in_text = Window.partitionBy(key).orderBy("_island")
    prefix = lookup({k: v[3] for k, v in C.ENTITY_TYPES.items()}, F.col("_label"))
    ranked = (
        trimmed.withColumn("_copy", F.row_number().over(same_span))
        .where(F.col("_copy") == 1)
        .withColumn("_rank", F.row_number().over(in_text))
        .withColumn("_prefix", prefix)
        .withColumn("_n", F.row_number().over(Window.partitionBy(key, "_prefix").orderBy("_rank")).cast("string"))
    )
    if limit is not None:  # numbers of a prefix run in rank order, so a cut leaves them as they are
        ranked = ranked.where(F.col("_rank") <= limit)
    table = C.ENTITY_TYPES
    return ranked.select(
        key,
        F.col("_rank").alias("position"),
        F.concat(F.lit("ner-"), F.col("category"), F.lit("-"), F.col("_n")).alias("id"),
        "category",
        "surface",
        lookup({k: v[1] for k, v in table.items()}, F.col("_label")).alias("label"),
        F.concat(lookup({k: v[2] for k, v in table.items()}, F.col("_label")), F.lit(C.ENTITY_REASON_TAIL)).alias("reason"),
        lookup({k: v[4] for k, v in table.items()}, F.col("_label")).alias("risk_level"),
        F.concat(F.lit("["), F.col("_prefix"), F.lit("_"), F.col("_n"), F.lit("]")).alias("suggested_placeholder"),
        "confidence",
        "start",
        "end",
    )


def gather_candidates(candidates: DataFrame, keys: list[str], out: str = "candidates") -> DataFrame:
    """Candidate rows as one array per text, as large as the text has candidates."""
    fields = [
        "id", "category", "surface", "label", "reason", "risk_level", "suggested_placeholder", "confidence", "start", "end",
    ]
    packed = F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("c"))))
    return candidates.groupBy(*keys).agg(packed.alias("_p")).select(
        *keys, F.transform("_p", lambda p: p["c"]).alias(out)
    )
