"""Secret scans: candidate runs, and a random forest that removes false positives.

A candidate is a run of at least ``MIN_LENGTH`` characters of ``[A-Za-z0-9+/_-]`` (and closing ``=``) that holds a digit, a
known shape, with or without a digit, or a value of any length and characters behind a key name and ``=`` or ``:`` or
between a url's user and its host. A value in quotes is taken up to the closing quote, another one up to white space.
Its features are columns: length and kinds of characters, transitions between kinds of characters, share covered by the
corpus's frequent words, signs of a path, and neighbouring words. A random forest is trained on labelled findings; it is
then spelled out as one column expression (a CASE per tree), so that scoring is a projection without a shuffle, over rows of
findings and inside an array column alike. Everything is DataFrame or SQL operations.

Labels: ``seed_label`` marks findings whose shape or surroundings leave no doubt; others are unlabelled and judged by the
forest alone. Callers with reviewed findings pass their own column. Training counts
equal labelled findings as one with a weight and takes at most ``SAMPLE_ROWS`` / 2 distinct ones of each label (drawn by
hash, frequent ones first); the dictionary is counted over all texts.

Defined results: null or empty text has no findings and stays as it is. Repeated rows are scanned alike. If the labels
lack one class (as with empty tables), no forest can be trained and the labels themselves decide. Other columns stay
untouched. Texts are scanned whole, one pass, linear in their length; running offsets are summed in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lets import let
from .common import stored

MIN_LENGTH = 16
SAMPLE_ROWS = 20_000
DICTIONARY_WORDS = 400
TREES, DEPTH = 15, 5
BLOCK = 256

RUN = "[A-Za-z0-9+/_-]"
#: ``=`` closes a run only where no value follows.
CLOSED = f"(?:={{1,2}}(?![\"']?[=A-Za-z0-9+/_$-]))?+"
KNOWN = (
    "(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}+"
    "|xox[baprs]-[A-Za-z0-9-]{10,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+)"
)
#: What stands before a value: a key name and = or :, perhaps a quote or a scheme; or the user of a url. At most 64 characters.
KEY_NAME = (
    "(?:(?<![A-Za-z])(?i:key|pass)|(?<=[a-z])Key|(?i:(?:api|access|private|secret|account|master|shared)key"
    "|token|secret|passw(?:or[dt]|d)?|passphrase|passcode|pwd|auth(?:orization)?|bearer|credential))"
    "(?i:s)?(?:[0-9_.-][A-Za-z0-9_.-]{0,24}|(?<=[a-z])[A-Z][A-Za-z0-9_.-]{0,24})?"
)
KEYED = f"{KEY_NAME}[\"']?[ \\t]{{0,4}}(?:=>|:=|==?|:)[ \\t]{{0,4}}(?:[\"']|(?i:bearer|basic|token) )?"
USER = "://[^\\s/:@?#\"'<>]{0,60}:"
#: A keyed value: all up to the quote that closes it, or up to white space, a closing quote or the next ``&name=``, without closing punctuation.
QUOTED = "(?<=\")(?:[^\"\\\\\\r\\n]|\\\\[^\\r\\n])++(?=\")|(?<=')(?:[^'\\\\\\r\\n]|\\\\[^\\r\\n])++(?=')"
BARE = "(?![=>:\"']|//|(?i:bearer|basic|token) )(?:(?![.,;:)\\]}]{1,3}(?:\\s|\\z)|&[A-Za-z_][A-Za-z0-9_.-]{0,40}=)(?:[^\\s\"']|[\"'](?=[A-Za-z0-9])))++"
#: The first two tests are cheap and spare the third at most places.
VALUE = f"(?<=[=:>\"' \\t])(?<=[=:>][ \\t]{{0,4}}(?:[\"']|(?i:bearer|basic|token) )?)(?<={KEYED})(?:{QUOTED}|{BARE})|(?<=:)(?<={USER})[^\\s/\"'<>]+(?=@)"
PIECE = f"(?s)(.*?)({VALUE}|{KNOWN}|(?<!{RUN}){RUN}{{{MIN_LENGTH},}}+{CLOSED}|\\z)"
HAS_PIECE = f"[=:]|{RUN}{{15}}"
#: Characters before and after a run that its features see; a piece and its gap have ``SHORTEST`` characters at least.
BEFORE, AFTER, SHORTEST = 40, 20, 5
#: Characters before a run that decide whether it is keyed.
CONTEXT = 64
KEY_WORDS = "key|token|secret|passw|pwd|auth|bearer|credential|akia|asia"
PLAIN_WORDS = "sha1|sha256|md5|hash|digest|commit|checksum|uuid|guid|order|invoice|phone|card|isbn|page"
PATH_WORDS = "test|example|sample|fixture|mock|docs?"


def pieces(text: Column) -> Column:
    """The text as structs of a gap and the run that ends it; the last run is empty."""
    cut = lambda k: F.regexp_extract_all(text, F.lit(PIECE), F.lit(k))
    parts = F.arrays_zip(cut(1).alias("gap"), cut(2).alias("run"))
    return F.when(F.regexp_like(text, F.lit(HAS_PIECE)), parts)


def running(lengths: Column) -> Column:
    """Sum of the lengths before each element: sums of blocks, sums before blocks, rest within the block."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def of(lengths: Column) -> Column:
        n_blocks = F.greatest(F.ceil(F.size(lengths) / BLOCK).cast("int"), F.lit(1))
        sums = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: add(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(sums, lambda sums: F.transform(sums, lambda _, b: add(F.slice(sums, F.lit(1), b))))
        return let(before, lambda before: F.transform(
            lengths, lambda _, i: F.get(before, (i / BLOCK).cast("int")) + add(F.slice(lengths, (i - i % BLOCK) + 1, i % BLOCK))
        ))

    return let(lengths, of)


def candidates(parts: Column) -> Column:
    """Start, end, run, text before and after of each piece. ``parts`` must be bound (by ``let``): it is used many times.

    The text around a run is joined from the ends of as many pieces as it can span.
    """
    ends = lambda cut, n: F.transform(parts, lambda p: F.concat(cut(p["gap"], F.lit(n)), cut(p["run"], F.lit(n))))
    n_before, n_after = -(-CONTEXT // SHORTEST), -(-AFTER // SHORTEST)
    lengths = F.transform(parts, lambda p: (F.char_length(p["gap"]) + F.char_length(p["run"])).cast("long"))

    def with_starts(starts: Column, tails: Column, heads: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            start = F.get(starts, i) + F.char_length(p["gap"])
            earlier = F.array_join(F.slice(tails, F.greatest(i - n_before, F.lit(0)) + 1, F.least(i, F.lit(n_before))), "")
            later = F.array_join(F.slice(heads, i + 2, F.lit(n_after)), "")
            context = F.right(F.concat(earlier, F.right(p["gap"], F.lit(CONTEXT))), F.lit(CONTEXT))
            return let(context, lambda context: F.struct(
                start.alias("start"), (start + F.char_length(p["run"])).alias("end"), p["run"].alias("run"),
                F.right(context, F.lit(BEFORE)).alias("before"), F.left(later, F.lit(AFTER)).alias("after"),
                F.regexp_like(context, F.lit(f"(?:{KEYED}|{USER})\\z")).alias("keyed"),
            ))

        return F.transform(parts, one)

    return let(running(lengths), lambda starts: let(ends(F.right, CONTEXT), lambda tails: let(ends(F.left, AFTER), lambda heads: with_starts(starts, tails, heads))))


def is_candidate(c: Column) -> Column:
    """Runs with a digit, known shapes and keyed values; the forest tells the false ones apart."""
    return (F.char_length(c["run"]) > 0) & (c["keyed"] | F.regexp_like(c["run"], F.lit(f"[0-9]|{KNOWN}")))


def features(c: Column, words: list[str], path: Column | None = None) -> dict[str, Column]:
    run, n = c["run"], F.greatest(F.char_length(c["run"]), F.lit(1)).cast("double")
    share = lambda p: F.regexp_count(run, F.lit(p)) / n
    near = lambda s, p: F.regexp_like(F.lower(s), F.lit(p)).cast("double")
    covered = (n - F.char_length(F.regexp_replace(F.lower(run), "|".join(words), ""))) / n if words else F.lit(0.0)
    return {
        "length": n,
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "others": share("[+/_=-]"), "symbols": share("[^A-Za-z0-9+/_=-]"),
        "kind_changes": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"), "case_changes": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "vowel_changes": share("(?i)(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]"), "repeats": share("(.)\\1"),
        "hex_only": F.regexp_like(run, F.lit("^[0-9a-f]+$|^[0-9A-F]+$")).cast("double"),
        "dictionary": covered,
        "path_signs": (F.regexp_count(run, F.lit("/")) + F.regexp_count(c["before"], F.lit("://|/$|\\.$"))).cast("double"),
        "path_words": near(F.coalesce(path, F.lit("")) if path is not None else F.lit(""), f"\\b({PATH_WORDS})\\b"),
        "key_before": near(c["before"], f"({KEY_WORDS})[^ ]{{0,12}} ?[=:]? ?[\"']?$"), "key_near": near(c["before"], KEY_WORDS),
        "assigned": near(c["before"], "[=:] ?[\"']?$"), "quoted": near(c["before"], "[\"']$"),
        "plain_before": near(c["before"], f"({PLAIN_WORDS})[^ ]{{0,8}}[ =:#]*$"), "linked_after": near(c["after"], "^[.@:]"),
        "keyed": c["keyed"].cast("double"), "known": F.regexp_like(run, F.lit(KNOWN)).cast("double"),
    }


def seed_label(c: Column) -> Column:
    """1 for known shapes and assigned keys, 0 for plain numbers, digests named as such, paths and placeholders, else null.

    Keyed values that are short or hold other characters count as assigned with eight characters, a letter and something
    else; plain words are left to the forest.
    """
    run, before = c["run"], F.lower(c["before"])
    known = F.regexp_like(run, F.lit(f"^{KNOWN}$"))
    is_run = F.regexp_like(run, F.lit(f"^{RUN}{{{MIN_LENGTH},}}+=*$"))
    strong = F.regexp_like(run, F.lit("^(?=.*[A-Za-z])(?=.*[^A-Za-z \\t])[^ \\t]{8,}$"))
    assigned = F.regexp_like(before, F.lit(f"({KEY_WORDS})[a-z_]*[\"']? ?[=:] ?[\"']?$")) & F.regexp_like(run, F.lit("[A-Za-z]")) & is_run & F.regexp_like(run, F.lit("[0-9]"))
    assigned = assigned | (c["keyed"] & ~F.contains(run, F.lit("://")) & F.when(is_run, F.regexp_like(run, F.lit("[A-Za-z].*[0-9]|[0-9].*[A-Za-z]"))).otherwise(strong))
    empty = F.regexp_like(run, F.lit("^(?:\\$\\{.*|\\$\\(.*|\\$[A-Z_]+|\\{\\{.*|<.*>|%[A-Za-z_]+%|[*x.]+|(?i:true|false|null|none|nil|undefined))$"))
    plain = F.regexp_like(run, F.lit("^[0-9_/+-]+=*$|^(19|20)[0-9]{2}[-/][0-9]{2}[-/]")) | F.regexp_like(before, F.lit(f"({PLAIN_WORDS})[^ ]{{0,8}}[ =:#]*$"))
    path = F.regexp_like(before, F.lit("://[^ ]*$")) | (F.regexp_count(run, F.lit("/")) >= 2)
    user = F.regexp_like(before, F.lit(f"{USER}\\z")) & c["keyed"] & F.regexp_like(c["after"], F.lit("^@"))
    return F.when(known | user, 1.0).when(empty, 0.0).when(assigned & ~plain, 1.0).when((plain & ~c["keyed"]) | (plain & is_run) | (path & ~c["keyed"]), 0.0)


def frequent_words(docs: DataFrame, size: int = DICTIONARY_WORDS, text: str = "text") -> list[str]:
    """The corpus's most frequent words of four to twelve ASCII letters, counted over all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text).cast("string")), "[^a-z]+")).alias("word"))
    counted = words.where(F.char_length("word").between(4, 12)).groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


class Forest:
    """Trees as nested tuples of (feature, order, bound, then, else), with a vote at the leaves."""

    def __init__(self, trees: list, names: list[str]):
        self.trees, self.names = trees, names

    def score(self, at: Callable[[str], Column]) -> Column:
        """Share of trees that vote secret; ``at`` gives the column of a feature."""

        def spelled(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            feature, order, bound, yes, no = tree
            value = at(self.names[feature])
            return F.when(value <= bound if order == "<=" else value > bound, spelled(yes)).otherwise(spelled(no))

        total = spelled(self.trees[0])
        for tree in self.trees[1:]:
            total = total + spelled(tree)
        return total / float(len(self.trees))


def _tree(lines: list[str]):
    """One tree of MLlib's printed form: If / Else / Predict, nested by order."""
    head = lines.pop(0)
    if head.startswith("Predict"):
        return float(head.split()[1])
    feature, order, bound = re.match(r"If \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)", head).groups()
    yes = _tree(lines)
    lines.pop(0)  # Else
    return int(feature), order, float(bound), yes, _tree(lines)


def train_forest(labelled: DataFrame, names: list[str], sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """A forest from the columns ``names`` and ``label``; None only if a class is missing in all labelled rows.

    ``n`` equal rows count as 1 + floor(log2(n)), and both labels weigh the same in total, so that neither a hot vector
    nor a frequent label hides the others. At most ``sample_rows`` / 2 distinct rows of each label are used,
    drawn by hash with chances that grow with their copies.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    equal = labelled.where("label IS NOT NULL").groupBy(*names, F.col("label").cast("double").alias("label"))
    hashed = (F.pmod(F.xxhash64(*names), F.lit(1 << 31)) + 1) / (1 << 31)
    rows = stored(equal.agg(F.count("*").alias("n")).withColumn("draw", -F.log(hashed) / F.col("n")), "labelled")
    labels = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]
    if len(labels) < 2:
        return None
    least = lambda x: rows.where(F.col("label") == x).orderBy("draw", *names).limit(max(1, sample_rows // len(labels)))
    # As rows, not as weights: each tree draws rows, and a hot vector is not to miss in many of them.
    copies = F.explode(F.sequence(F.lit(0), F.floor(F.log2("n")).cast("int")))
    sample = stored(reduce(DataFrame.unionByName, map(least, labels)).select(*names, "label", copies.alias("copy")), "sample")
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    share = reduce(lambda c, x: c.when(F.col("label") == x, sum(total.values()) / len(total) / total[x]), labels, F)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(sample.withColumn("weight", share))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, labelCol="label", weightCol="weight").fit(data)
    trees = re.split(r"^\s*Tree \d+.*$", model.toDebugString, flags=re.M)[1:]
    return Forest([_tree([x.strip() for x in t.splitlines() if x.strip()]) for t in trees], names)


def candidate_rows(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per candidate: place, run, surroundings, features and seed label."""
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), (F.col(path) if path else F.lit("")).alias("path"))
    # Outer, then filtered: explode alone would have the optimizer compute the whole array a second time in a filter.
    found = F.filter(let(pieces(F.col("text")), candidates), is_candidate)
    rows = slim.select("doc_id", "path", F.explode_outer(found).alias("c")).where("c IS NOT NULL")
    named = features(F.col("c"), words, F.col("path"))
    return rows.select("doc_id", "c.start", "c.end", "c.run", "c.before", "c.after", *(v.alias(k) for k, v in named.items()), seed_label(F.col("c")).alias("label"))


def secret_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, keep_from: float = 0.5) -> tuple[DataFrame, Forest | None, list[str]]:
    """All candidates with score and verdict; the forest and the dictionary come along for ``redact``."""
    words = frequent_words(docs, text=text)
    rows = stored(candidate_rows(docs, words, key, text, path), "candidates")
    names = list(features(F.struct(F.lit("").alias("run"), F.lit("").alias("before"), F.lit("").alias("after"), F.lit(False).alias("keyed")), words))
    forest = train_forest(rows, names)
    score = forest.score(F.col) if forest else F.coalesce(F.col("label"), F.lit(0.0))
    return rows.withColumn("score", score).withColumn("secret", F.col("score") >= keep_from), forest, words


def redact(docs: DataFrame, forest: Forest | None, words: list[str], text: str = "text", path: str | None = None, mark: str = "[SECRET]", keep_from: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; a narrow pass."""
    where = F.col(path) if path else F.lit("")
    named = lambda c: F.struct(*(v.alias(k) for k, v in features(c, words, where).items()))
    score = (lambda f, c: forest.score(lambda name: f[name])) if forest else (lambda f, c: F.coalesce(seed_label(c), F.lit(0.0)))

    def cleaned(parts: Column) -> Column:
        def one(p: Column, c: Column) -> Column:
            secret = let(named(c), lambda f: score(f, c) >= keep_from)
            return F.concat(p["gap"], F.when(is_candidate(c) & secret, F.lit(mark)).otherwise(p["run"]))

        return F.array_join(F.zip_with(parts, candidates(parts), one), "")

    whole = F.col(text)
    return docs.withColumn(text, F.when(F.regexp_like(whole, F.lit(HAS_PIECE)), let(pieces(whole), cleaned)).otherwise(whole))
