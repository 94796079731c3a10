"""Quality rules under weak supervision.

Rules vote good (1), bad (0) or abstain (-1) on each document. Nobody tells which rule is right: expectation-maximisation
over the votes estimates, per rule, how often it votes each way on good and on bad documents (what it says when it does not
abstain); the share of good documents overall (``prior``) is given. A document is kept if its posterior probability of being good is at least
``keep_from``; no single rule has to pass.

Votes depend on the documents only by their pattern, so one aggregation of the table to pattern counts (at most 3 to the
number of rules, whatever the table's size) is all that expectation-maximisation needs. Posteriors come back as a sum of
log odds, a column expression. Text statistics are made once, in a narrow pass, and stored.

Defined results: null or empty text has no words, so the base rule fails it. Very long texts are counted whole. Repeated
documents are judged alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, chunks, free_name, ship, stored, table_of

WINDOW = 8
TOGETHER = 1 << 20  # text bytes counted at a time; the arrays take some fifty times that
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stops", "n_odd", "n_same", "n_distinct",
]
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
DDL = ", ".join(f"{c} long" for c in ["doc_id", *COUNTS])


def _flags(members) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(members)] = 1
    return out


SYMBOL = _flags(b"#*$%&|<>")
UPPER, LETTER = _flags(range(65, 91)), _flags([*range(65, 91), *range(97, 123)])
SPACES = _flags(b" \t\n\x0b\x0c\r")
CHAR = _flags(b for b in range(256) if not 0x80 <= b < 0xC0 and not SPACES[b])
STOP = _flags(b".,;:!?")
#: Bytes that words of running text do not hold.
ODD = _flags(b for b in range(33, 127) if not LETTER[b] and b not in b".,;:!?'\"()-")


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.cumsum(flags)[ends - 1], prepend=0)


def _repeats(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words inside windows of ``WINDOW`` words that are found twice or more in their text, per text."""
    n = len(ids)
    if n < WINDOW:
        return np.zeros(len(ends), np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    code = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        code = code * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - WINDOW + 1 + k]
    code ^= code >> np.uint64(29)
    at = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    code = code[at] * np.uint64(0xBF58476D1CE4E5B9) + text[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(code)
    same = np.concatenate([[False], code[order][1:] == code[order][:-1]])
    if not same.any():
        return np.zeros(len(ends), np.int64)
    pair = np.flatnonzero(same)
    left, right = at[order[pair - 1]], at[order[pair]]
    for k in range(WINDOW):  # the words themselves, and the text
        keep = (ids[left + k] == ids[right + k]) & (text[left] == text[right])
        left, right = left[keep], right[keep]
    edge = np.zeros(n + 1, np.int64)
    start = np.unique(np.concatenate([left, right]))
    np.add.at(edge, start, 1)
    np.add.at(edge, start + WINDOW, -1)
    return np.bincount(text, weights=np.cumsum(edge[:-1]) > 0, minlength=len(ends)).astype(np.int64)


def statistics(texts: list[bytes]) -> list[np.ndarray]:
    """The ``COUNTS`` of some texts."""
    if not texts:
        return [np.zeros(0, np.int64) for _ in COUNTS]
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = SPACES[buffer].astype(bool)
    last = ~space & np.append(space[1:], True)
    word = np.cumsum(last) - last  # number of the word that a byte belongs to
    odd = np.flatnonzero(ODD[buffer])
    first_odd = np.zeros(len(buffer), np.int64)
    first_odd[odd[np.diff(word[odd], prepend=-1) > 0]] = 1
    split = [t.split() for t in texts]
    flat = [w for words in split for w in words]
    word_ends = np.cumsum([len(w) for w in split])
    ids = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    text = np.repeat(np.arange(len(texts)), np.diff(word_ends, prepend=0))
    same = np.zeros(len(flat), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts]
    return [
        np.array([len(w) for w in split], np.int64), _per_text(CHAR[buffer], ends), _per_text(SYMBOL[buffer], ends),
        np.array([len(x) - len(set(x)) for x in lines], np.int64), _repeats(ids, word_ends), np.array([len(x) for x in lines], np.int64),
        _per_text(UPPER[buffer], ends), _per_text(LETTER[buffer], ends), _per_text(STOP[buffer] * last, ends), _per_text(first_odd, ends),
        np.bincount(text, weights=same, minlength=len(texts)).astype(np.int64), np.array([len(set(w)) for w in split], np.int64),
    ]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=TOGETHER):
        yield table_of(SCHEMA, batch.column("doc_id"), *statistics([t or b"" for t in batch.column("text").to_pylist()]))


def text_statistics(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return as_bytes(docs).mapInArrow(_count, DDL)


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, 0)
    return (vote if good is None else vote.when(good, 1)).otherwise(-1)


def votes(at: str = "") -> dict[str, Column]:
    """The rules, over the columns of ``text_statistics``, whose names may have a prefix.

    Lack of a fault is no sign of quality, so most rules vote bad or abstain; short texts make several abstain.
    """
    share = lambda a, b: F.col(at + a) / F.greatest(F.col(at + b), F.lit(1))
    words, length, stops = F.col(f"{at}n_words"), share("word_chars", "n_words"), share("n_stops", "n_words")
    odd, distinct = share("n_odd", "n_words"), share("n_distinct", "n_words")
    return {
        "few_symbols": _vote(share("n_symbols", "n_words") > 0.1),
        "plain_words": _vote(odd > 0.3, odd < 0.1),
        "few_repeats": _vote(share("n_repeat_words", "n_words") > 0.15),
        "own_lines": _vote((F.col(f"{at}n_lines") >= 4) & (share("n_dup_lines", "n_lines") > 0.3)),
        "word_length": _vote((length < 2) | (length > 14), (length >= 3) & (length <= 10)),
        "lower_case": _vote(share("n_upper", "n_letters") > 0.35),
        "no_stutter": _vote(share("n_same", "n_words") > 0.1),
        "rich_words": _vote((words >= 40) & (words < 2000) & (distinct < 0.25)),
        "punctuation": _vote((words >= 60) & (stops < 0.005), (stops > 0.02) & (stops < 0.4)),
    }


class VoteModel:
    """Two classes, bad and good; per rule and class the chance of a good vote, given that the rule votes."""

    def __init__(self, prior: float, good: np.ndarray):
        self.prior, self.good = prior, good

    def log_odds(self, pattern: np.ndarray) -> np.ndarray:
        up, down = np.log(self.good[:, 1] / self.good[:, 0]), np.log((1 - self.good[:, 1]) / (1 - self.good[:, 0]))
        return math.log(self.prior / (1 - self.prior)) + (pattern == 1) @ up + (pattern == 0) @ down

    def column(self, rules: list[Column]) -> Column:
        """Posterior probability of being good, from the rules' votes."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, (bad, good) in zip(rules, self.good.tolist(), strict=True):
            total = total + F.when(vote == 1, math.log(good / bad)).when(vote == 0, math.log((1 - good) / (1 - bad))).otherwise(0.0)
        return F.lit(1.0) / (1 + F.exp(-total))


def fit_votes(
    pattern: np.ndarray, count: np.ndarray, prior: float = 0.9, rounds: int = 200, smooth: float = 2.0, least: float = 0.8, most: float = 0.6
) -> VoteModel:
    """Expectation-maximisation over vote patterns and their counts.

    It starts from "any bad vote is a sign of a bad text". Rules are taken to be better than chance: on good texts a vote
    is right at least ``least`` of the time, and on bad texts it is good at most ``most`` of the time. Without these, rules
    that share one kind of fault would take all other faults for the habit of good texts. ``smooth`` pseudo-votes keep
    chances off 0 and 1.
    """
    n_rules, count = pattern.shape[1], count.astype(float)
    good = np.tile([0.5, 0.95], (n_rules, 1))
    model = VoteModel(prior, good)
    after = np.where((pattern == 0).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        weight = np.stack([count * (1 - after), count * after], axis=1)
        up, said = (pattern == 1).T @ weight, (pattern >= 0).T @ weight
        new = (up + smooth * np.array([0.5, 0.95])) / (said + smooth)
        new = np.clip(new, [1e-4, least], [most, 1 - 1e-4])
        model = VoteModel(prior, new)
        now = 1 / (1 + np.exp(-model.log_odds(pattern)))
        done = np.abs(now - after).max(initial=0) < 1e-9
        after = now
        if done:
            break
    return model


def fit_rules(counts: DataFrame, prior: float = 0.9) -> VoteModel:
    """The vote model of a table of text statistics; only counts of vote patterns come to the driver."""
    names = list(votes())
    voted = counts.where("n_words > 0").select(*(v.alias(n) for n, v in votes().items()))
    rows = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(names)
    pattern = np.array([[r[n] for n in names] for r in rows], np.int64).reshape(len(rows), len(names))
    return fit_votes(pattern, np.array([r["n"] for r in rows]), prior)


def _verdict(model: VoteModel, at: str, keep_from: float, min_words: int, most_repeats: int) -> tuple[Column, Column, Column]:
    words = F.col(f"{at}n_words")
    failed = (words < min_words) | (100 * F.col(f"{at}n_repeat_words") > most_repeats * words)
    posterior = F.when(words > 0, model.column(list(votes(at).values()))).otherwise(0.0)
    return failed, posterior, ~failed & (posterior >= keep_from)


def judged(docs: DataFrame, keep_from: float = 0.5, min_words: int = 20, most_repeats: int = 30, prior: float = 0.9) -> DataFrame:
    """Counts, votes, posterior and verdict per document."""
    counts = stored(text_statistics(docs), "statistics")
    failed, posterior, kept = _verdict(fit_rules(counts, prior), "", keep_from, min_words, most_repeats)
    return counts.select("*", *(v.alias(n) for n, v in votes().items()), failed.alias("base_failed"), posterior.alias("posterior"), kept.alias("kept"))


def _annotate(names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], text, TOGETHER):
                counts = statistics([t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in counts)], names=[*part.schema.names, *names])

    return run


def keep_good(docs: DataFrame, text: str = "text", keep_from: float = 0.5, min_words: int = 20, most_repeats: int = 30, prior: float = 0.9) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged. Two narrow passes, no join."""
    model = fit_rules(stored(text_statistics(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"))), "statistics"), prior)
    at = free_name(docs, "_quality_")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(at + c, T.LongType()) for c in COUNTS)])
    counted = docs.mapInArrow(_annotate([at + c for c in COUNTS], text), schema)
    _, _, kept = _verdict(model, at, keep_from, min_words, most_repeats)
    return counted.where(kept).select(*docs.columns)
