"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bbit_minhash import near_duplicates
from .best_fit import pack
from .bwt_dedup import dedup_bytes
from .common import read
from .decontaminate import decontamination
from .edit_tokens import apply_edits, with_trees
from .hyper_lang import languages
from .jacobi_whitening import whitened
from .merkle import manifest, tampered
from .pii_bootstrap import personal_data, with_digests
from .secret_forest import secret_findings
from .unit_dedup import dedup_units
from .url_filter import url_verdicts
from .weak_quality import judged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark, folder):
    found = decontamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.drop("hit_words", "items")


@query
def op2_weak_quality(spark, folder):
    return judged(read(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


@query
def op3_url_filter(spark, folder):
    values = ", ".join(f"('{rule}', '{action}')" for rule, action in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules (rule, action)")
    return url_verdicts(read(spark, folder, "pages"), rules)


@query
def op4_bwt_dedup(spark, folder):
    found = dedup_bytes(read(spark, folder, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Three edits of each document, made from its own id and text: a cut, an insertion and a replacement.
EDITS_SQL = """array(
  named_struct('start', pmod(xxhash64(doc_id, 1), char_length(text) + 1), 'end', pmod(xxhash64(doc_id, 1), char_length(text) + 1) + 17, 'text', ''),
  named_struct('start', pmod(xxhash64(doc_id, 2), char_length(text) + 1), 'end', 0L, 'text', concat(' revision ', doc_id, '\n')),
  named_struct('start', pmod(xxhash64(doc_id, 3), char_length(text) + 1), 'end', pmod(xxhash64(doc_id, 3), char_length(text) + 1) + 40, 'text', right(text, 60)))"""


@query
def op5_edit_tokens(spark, folder):
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = with_trees(read(spark, folder, "documents"), ranks, pattern).withColumn("edits", F.expr(EDITS_SQL))
    return apply_edits(trees, ranks, pattern).select(
        "doc_id", "n_edits", "n_skipped", "n_tokens_before", "n_tokens", "n_chars_encoded",
        F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


@query
def op6_secret_forest(spark, folder):
    found, _, _ = secret_findings(read(spark, folder, "documents"), path="source")
    return found.select("doc_id", "start", "end", F.col("run").alias("candidate"), "label", "score", "secret")


@query
def op7_pii_bootstrap(spark, folder):
    return with_digests(personal_data(read(spark, folder, "documents")))


@query
def op8_unit_dedup(spark, folder):
    return dedup_units(read(spark, folder, "documents"), "sentence", min_words=12).select(
        "doc_id", "n_units", "n_removed", "n_removed_chars", F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",").alias("removed"),
        F.md5("text").alias("kept_md5"),
    )


@query
def op9_best_fit(spark, folder):
    import public_tokenizers

    return pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_bbit_minhash(spark, folder):
    return near_duplicates(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op11_jacobi_whitening(spark, folder):
    return whitened(read(spark, folder, "embeddings"))


@query
def op12_hyper_language(spark, folder):
    return languages(read(spark, folder, "documents"))


@query
def op13_merkle_manifest(spark, folder):
    return manifest(read(spark, folder, "documents"), tampered()).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
