"""Context candidates: residual terms, merging with model candidates, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import context_fixed as C
from ..functions.lets import contains_any, distinct_sorted_by_length, fixed, let, lookup, strip
from ..functions.patterns import EDGE, NOT_AFTER_WORD, SP, SPACE
from ..functions.lists import first_of_each, folded
from ..functions.spans import FINDINGS_TYPE, SPAN_TYPE, empty, find_literal

TERM_TYPE = (
    "array<struct<surface:string,prefix:string,category:string,label:string,reason:string,"
    "risk_level:string,confidence:double>>"
)
CANDIDATE_TYPE = (
    "array<struct<id:string,category:string,surface:string,label:string,reason:string,risk_level:string,"
    "suggested_placeholder:string,confidence:double,start:int,end:int>>"
)

# --- fixed values: name and organization patterns --------------------------
_NAME = "[\\p{IsHan}々〆ヵヶ]{2,6}"
_ORG = "[\\p{IsHan}\\p{IsKatakana}A-Za-zＡ-Ｚａ-ｚ0-9０-９・ー]"
_AFTER_ORG = f"(?=向け|宛て|との|への|へ|の|に|です|、|。|{SP}|\\z)"
_SELF_INTRODUCTION = f"(?:^|[\\n。！？])({_NAME})です(?:。|、|{SP}|\\z)"
_LABELLED = f"(?:{C.PERSON_LABEL_WORDS}){SP}*+(?:[:：]{SP}*+)?({_NAME})(?=\\z|[、。]|{SP})"
_CUSTOMER = "[A-ZＡ-Ｚ][A-ZＡ-Ｚ0-9０-９]{0,3}社(?=向け|宛て|への|へ|との|には|に|の)"
_CORPORATE_PREFIXED = f"(?:{C.CORPORATE_PREFIXES}){_ORG}{{2,24}}?{_AFTER_ORG}"
_CORPORATE_SUFFIXED = f"{_ORG}{{2,24}}?(?:{C.CORPORATE_SUFFIXES}){_AFTER_ORG}"
_PROJECT = f"{NOT_AFTER_WORD}Project{SP}+[A-Z][A-Za-z0-9-]*(?:{SP}+[A-Z][A-Za-z0-9-]*){{1,5}}{EDGE}"
# All capitals that begin a part of one run reach the same end, so a run is entered once, at the first of them; parts before it
# are passed over. A run is entered at its start, behind an underscore, or where the hit before has ended.
_ENTER_RUN = "(?:(?<![A-Za-z0-9_-])|(?<=_)[A-Za-z0-9]*+(?=-)|\\G(?<=[A-Za-z0-9])[A-Za-z0-9]*+)(?:[a-z0-9][A-Za-z0-9]*+|-)*+"
_PROJECT_SPACED = (
    f"{_ENTER_RUN}([A-Z][A-Za-z0-9-]*(?:{SP}+[A-Z][A-Za-z0-9-]*){{0,5}}(?:{C.PROJECT_SUFFIXES}))"
)
_PROJECT_JOINED = f"{_ORG}{{2,30}}(?:{C.PROJECT_SUFFIXES})"
# definition, pattern, group, words one of which a hit needs
_ENTITY_PATTERNS = [
    (C.PERSON, C.HONORIFIC_NAME, 0, ["様", "さん", "氏", "先生", "くん", "ちゃん"]),
    (C.PERSON, _SELF_INTRODUCTION, 1, ["です"]),
    (C.PERSON, _LABELLED, 1, C.PERSON_LABEL_WORDS.split("|")),
    (C.CUSTOMER, _CUSTOMER, 0, ["社"]),
    (C.COMPANY, _CORPORATE_PREFIXED, 0, C.CORPORATE_PREFIXES.split("|")),
    (C.COMPANY, _CORPORATE_SUFFIXED, 0, C.CORPORATE_SUFFIXES.split("|")),
    (C.PROJECT, _PROJECT, 0, ["Project"]),
    (C.PROJECT, _PROJECT_SPACED, 1, C.PROJECT_SUFFIXES.split("|")),
    (C.PROJECT, _PROJECT_JOINED, 0, C.PROJECT_SUFFIXES.split("|")),
]


def _term(surface: Column, kind: C.Residual) -> Column:
    return F.struct(
        surface.alias("surface"),
        F.lit(kind.prefix).alias("prefix"),
        F.lit(kind.category).alias("category"),
        F.lit(kind.label).alias("label"),
        F.lit(kind.reason).alias("reason"),
        F.lit("medium").alias("risk_level"),
        F.lit(kind.confidence).alias("confidence"),
    )


def _terms(surfaces: Column, kind: C.Residual) -> Column:
    return F.transform(surfaces, lambda s: _term(s, kind))


def residual_entity_terms(text: Column) -> Column:
    """Names of people, customers, companies and projects by their form."""
    parts = []
    for kind, pattern, group, needs in _ENTITY_PATTERNS:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        parts.append(F.when(contains_any(text, needs), _terms(found, kind)).otherwise(empty(TERM_TYPE)))
    return F.concat(*parts)


def residual_business_terms(text: Column) -> Column:
    """Business terms that occur in the text, one entry per term."""
    entries = [
        F.when(F.contains(text, F.lit(surface)), _term(F.lit(surface), kind))
        for kind, surfaces in C.BUSINESS_TERMS
        for surface in surfaces
    ]
    return F.array_compact(F.array(*entries))


def residual_terms(text: Column) -> Column:
    """All residual terms, distinct, longest first."""
    return distinct_sorted_by_length(
        F.concat(residual_entity_terms(text), residual_business_terms(text)), "surface"
    )


_GAP = "\x01"  # stands between surfaces, and is taken out of them


def _bare(surface: Column) -> Column:
    return F.lower(F.regexp_replace(surface, f"[{SPACE}{_GAP}]+", ""))




def _kind(category: Column) -> Column:
    """Categories that may name the same thing share a kind."""
    return F.when(category.isin("company_name", "customer_name"), "organization").otherwise(F.coalesce(category, F.lit("")))


def merge_residual(candidates: Column, terms: Column, max_candidates: int | None = None) -> Column:
    """Model candidates first, then residual terms they do not cover, up to a limit if one is given.

    A business-context candidate that spans a specific term gives way to it. A term is covered by a candidate of its kind (or a
    term taken before) if one contains the other, without regard to case and white space. Terms come longest first, as
    :func:`residual_terms` gives them. Surfaces are normalised once. What contains a term is found by one byte search in the joined
    surfaces of its kind; a term can itself contain only model candidates and such earlier terms as lost white space.
    """
    bare_terms = F.transform(terms, lambda t: F.struct(t.alias("term"), _bare(t["surface"]).alias("bare"), _kind(t["category"]).alias("kind")))
    bare_candidates = F.transform(candidates, lambda c: F.struct(c.alias("c"), _bare(c["surface"]).alias("bare"), _kind(c["category"]).alias("kind")))

    def merged(both: Column) -> Column:
        business = F.filter(both["terms"], lambda t: t["term"]["category"].isin(C.BUSINESS_CATEGORIES))
        return let(
            F.filter(
                both["candidates"],
                lambda c: ~(c["c"]["category"].isin(C.BUSINESS_CATEGORIES) & F.exists(business, lambda t: F.contains(c["bare"], t["bare"]))),
            ),
            lambda kept: added(kept, both["terms"]),
        )

    def added(kept: Column, terms: Column) -> Column:
        kinds = F.array_distinct(F.concat(F.transform(kept, lambda c: c["kind"]), F.transform(terms, lambda t: t["kind"])))
        prefixes = F.array_distinct(F.transform(terms, lambda t: t["term"]["prefix"]))
        of_kind = lambda k: F.transform(F.filter(kept, lambda c: c["kind"] == k), lambda c: c["bare"])
        count = lambda p: F.size(F.filter(kept, lambda c: lookup(C.CANDIDATE_PREFIX, c["c"]["category"]) == p))
        given = F.transform(kinds, lambda k: F.struct(k.alias("kind"), of_kind(k).alias("bare")))
        return F.concat(
            F.transform(kept, lambda c: c["c"]).cast(CANDIDATE_TYPE),
            let(
                F.struct(given.alias("given"), F.transform(prefixes, lambda p: F.struct(p.alias("prefix"), count(p).alias("n"))).alias("counts")),
                lambda known: new_terms(known["given"], known["counts"], F.size(kept), terms),
            ),
        )

    def new_terms(given: Column, counts: Column, n_kept: Column, terms: Column) -> Column:
        # Per kind, what has been taken: joined, for a search of what contains a term; and earlier terms that lost white space.
        pools = F.transform(
            given,
            lambda g: F.struct(
                g["kind"].alias("kind"),
                F.array_join(F.transform(g["bare"], lambda b: F.concat(F.lit(_GAP), b)), "").alias("pool"),
                empty("array<string>").alias("spaced"),
            ),
        )
        start = F.struct(n_kept.alias("n"), pools.alias("pools"), counts.alias("counts"))
        of = lambda rows, name, value: F.element_at(F.filter(rows, lambda r: r[name] == value), 1)

        def is_new(state: Column, t: Column) -> Column:
            pool = of(state["pools"], "kind", t["kind"])
            within = (pool["pool"] != "") & F.contains(pool["pool"], t["bare"])
            contains = lambda o: F.contains(t["bare"], o)
            full = F.lit(False) if max_candidates is None else state["n"] >= max_candidates
            return ~(full | within | F.exists(pool["spaced"], contains) | F.exists(of(given, "kind", t["kind"])["bare"], contains))

        def step(state: Column, t: Column) -> Column:
            spaced = F.char_length(t["bare"]) < F.char_length(t["term"]["surface"])
            longer = F.struct(
                (state["n"] + 1).alias("n"),
                F.transform(
                    state["pools"],
                    lambda p: F.when(p["kind"] != t["kind"], p).otherwise(
                        F.struct(
                            p["kind"].alias("kind"),
                            F.concat(p["pool"], F.lit(_GAP), t["bare"]).alias("pool"),
                            F.when(spaced, F.concat(p["spaced"], F.array(t["bare"]))).otherwise(p["spaced"]).alias("spaced"),
                        )
                    ),
                ).alias("pools"),
                F.transform(
                    state["counts"], lambda c: F.struct(c["prefix"].alias("prefix"), (c["n"] + (c["prefix"] == t["term"]["prefix"]).cast("int")).alias("n"))
                ).alias("counts"),
            )
            return F.when(is_new(state, t), longer).otherwise(state)

        def emit(state: Column, t: Column) -> Column:
            term = t["term"]
            number = (of(state["counts"], "prefix", term["prefix"])["n"] + 1).cast("string")
            entry = F.struct(
                F.concat(F.lit("local-context-"), term["category"], F.lit("-"), number).alias("id"),
                term["category"].alias("category"),
                term["surface"].alias("surface"),
                term["label"].alias("label"),
                term["reason"].alias("reason"),
                term["risk_level"].alias("risk_level"),
                F.concat(F.lit("["), term["prefix"], F.lit("_"), number, F.lit("]")).alias("suggested_placeholder"),
                term["confidence"].alias("confidence"),
                F.lit(None).cast("int").alias("start"),
                F.lit(None).cast("int").alias("end"),
            )
            return F.when(is_new(state, t), F.array(entry).cast(CANDIDATE_TYPE)).otherwise(empty(CANDIDATE_TYPE))

        return folded(terms, start, step, emit, CANDIDATE_TYPE)

    all_kinds = let(F.struct(bare_candidates.alias("candidates"), bare_terms.alias("terms")), merged)
    # Without a term nothing gives way and nothing is added.
    return F.when(F.size(terms) == 0, candidates.cast(CANDIDATE_TYPE)).otherwise(all_kinds)


def distinct_candidates(candidates: Column, limit: int | None = None) -> Column:
    """First candidate per category, span and surface, then the first ``limit`` of them if one is given."""
    part = lambda c: F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    def key(c: Column) -> Column:
        return F.concat(part(c["category"]), part(c["start"].cast("string")), part(c["end"].cast("string")), part(c["surface"]))

    firsts = first_of_each(candidates, key)
    return firsts if limit is None else F.slice(firsts, 1, limit)


def preselected(candidates: Column, min_confidence: float = C.PRESELECT_CONFIDENCE) -> Column:
    """Ids of candidates confident enough to be selected from the start."""
    return F.transform(F.filter(candidates, lambda c: c["confidence"] >= min_confidence), lambda c: c["id"])


def occurrences(text: Column, candidate: Column, every: bool = True) -> Column:
    """The candidate's own span if the text agrees with it, else literal hits."""
    own = (
        candidate["start"].isNotNull()
        & candidate["end"].isNotNull()
        & (candidate["start"] >= 0)
        & (candidate["end"] > candidate["start"])
        & (candidate["end"] <= F.char_length(text))
        & (
            F.substring(text, candidate["start"] + 1, candidate["end"] - candidate["start"])
            == candidate["surface"]
        )
    )
    given = F.array(
        F.struct(
            candidate["start"].alias("start"), candidate["end"].alias("end"), candidate["surface"].alias("text")
        )
    )
    hits = F.when(F.contains(text, candidate["surface"]), find_literal(text, candidate["surface"])).otherwise(
        empty(SPAN_TYPE)
    )
    return F.when(F.coalesce(own, F.lit(False)), given).otherwise(hits if every else F.slice(hits, 1, 1))


def with_candidate_findings(
    df: DataFrame,
    text: str,
    candidates: str,
    out: str = "candidate_findings",
    min_confidence: float = C.MIN_CANDIDATE_CONFIDENCE,
    every: bool = True,
    max_surface_chars: int | None = None,
) -> DataFrame:
    """Candidates as findings; weak, empty and generic ones are left out, and long ones if a length is given."""
    short = (lambda n: n >= 1) if max_surface_chars is None else (lambda n: n.between(1, max_surface_chars))
    body = F.col(text)
    usable = F.filter(
        F.col(candidates),
        lambda c: (c["confidence"] >= min_confidence)
        & short(F.char_length(c["surface"]))
        & ~(
            c["category"].isin(C.GENERIC_NOUN_CATEGORIES) & strip(c["surface"]).isin(C.GENERIC_NOUNS)
        ),
    )
    spread = F.flatten(
        F.transform(
            usable,
            lambda c: F.transform(
                occurrences(body, c, every),
                lambda o: F.struct(
                    c.alias("c"),
                    o["start"].alias("start"),
                    o["end"].alias("end"),
                    o["text"].alias("text"),
                    lookup(C.CANDIDATE_PREFIX, c["category"]).alias("prefix"),
                ),
            ),
        )
    )
    staged = df.withColumn("_spread", fixed(F.transform(spread, lambda s, i: s.withField("seq", i))))
    prefixes = F.array_distinct(F.transform(F.col("_spread"), lambda s: s["prefix"]))

    def finding(s: Column, number: Column) -> Column:
        n = number.cast("string")
        return F.struct(
            s["seq"].alias("seq"),
            F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.concat(F.lit("llm:"), s["c"]["category"]).alias("rule_id"),
                F.lit("llm").alias("source"),
                s["c"]["label"].alias("label"),
                s["c"]["risk_level"].alias("risk_level"),
                F.lit(None).cast("string").alias("category"),
                s["text"].alias("text"),
                F.concat(F.lit("["), s["prefix"], F.lit("_"), n, F.lit("]")).alias("placeholder"),
                s["c"]["reason"].alias("message"),
                s["c"]["confidence"].alias("confidence"),
                F.concat_ws(
                    ":", F.lit("llm"), s["c"]["category"], s["start"].cast("string"), s["end"].cast("string"), n
                ).alias("id"),
            ).alias("f"),
        )

    numbered = F.flatten(
        F.transform(
            prefixes,
            lambda p: F.transform(
                F.filter(F.col("_spread"), lambda s: s["prefix"] == p), lambda s, i: finding(s, i + 1)
            ),
        )
    )
    return staged.withColumn(
        out, fixed(F.transform(F.sort_array(numbered), lambda n: n["f"]).cast(FINDINGS_TYPE))
    ).drop("_spread")


def result_message(candidates: Column) -> Column:
    return F.when(F.size(candidates) > 0, C.FOUND_MESSAGE).otherwise(C.NONE_MESSAGE)


def with_context_analysis(
    df: DataFrame,
    text: str,
    entity: str,
    semantic: str,
    out: str = "analysis",
    max_input_chars: int | None = None,
    max_candidates: int | None = None,
) -> DataFrame:
    """Merge both model outputs with residual terms; a null input is a failed model.

    With one model missing the other still counts and a warning is kept. With
    both missing only the residual terms of the whole text are left.
    """
    failed = F.col(entity).isNull() & F.col(semantic).isNull()
    nothing = empty(CANDIDATE_TYPE)
    model = F.concat(
        F.coalesce(F.col(entity).cast(CANDIDATE_TYPE), nothing), F.coalesce(F.col(semantic).cast(CANDIDATE_TYPE), nothing)
    )
    staged = (
        df.withColumn(
            "_terms",
            fixed(
                let(
                    F.col(text)
                    if max_input_chars is None
                    else F.when(failed, F.col(text)).otherwise(F.substring(F.col(text), 1, max_input_chars)),
                    residual_terms,
                )
            ),
        )
        .withColumn("_model", fixed(distinct_candidates(model, max_candidates)))
        .withColumn("_all", fixed(merge_residual(F.col("_model"), F.col("_terms"), max_candidates)))
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col(entity).isNull(), C.ENTITY_STAGE_WARNING),
            F.when(F.col(semantic).isNull(), C.SEMANTIC_STAGE_WARNING),
        )
    )
    summary = (
        F.when(failed, C.ANALYSIS_FAILED)
        .when(F.size(warnings) > 0, C.PARTIAL_SUMMARY)
        .when(F.size(F.col("_all")) > 0, C.FOUND_SUMMARY)
        .otherwise(C.NONE_SUMMARY)
    )
    return staged.withColumn(
        out,
        F.struct(
            F.col("_all").alias("candidates"),
            summary.alias("summary"),
            F.when(failed, C.ANALYSIS_FAILED).alias("error"),
            F.when(failed, F.array().cast("array<string>")).otherwise(warnings).alias("warnings"),
        ),
    ).drop("_terms", "_model", "_all")
