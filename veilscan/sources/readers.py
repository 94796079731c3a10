"""Sources and the safe-file sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import TEXT_EXTENSIONS
from ..functions.lets import let
from ..operators.files import file_kind, safe_name
from ..operators.scan import resolve_mode, with_findings, with_rewritten
from .schemas import FIXTURE_SCHEMA


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Inspectable text files as rows of ``path``, ``name`` and ``text``.

    The filter is on file metadata, so other files are dropped when the listing
    is planned and never opened.
    """
    name = F.col("_metadata.file_name")
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .where(F.lower(F.substring_index(name, ".", -1)).isin(TEXT_EXTENSIONS) & F.contains(name, F.lit(".")))
        .select(F.col("_metadata.file_path").alias("path"), name.alias("name"), F.col("value").alias("text"))
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file with its preflight class; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), "length").withColumn("kind", file_kind(F.col("name")))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXTURE_SCHEMA).json(path, multiLine=True)


def _file_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_signed_bundles(spark: SparkSession, path: str) -> DataFrame:
    return _file_texts(spark, path).select(parse_signed_bundles(F.col("value")).alias("b")).select("b.*")


def read_bundle_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Unsigned payload files, one ``payload`` struct per file."""
    return _file_texts(spark, path).select(let(F.try_variant_get(F.try_parse_json("value"), "$", _PAYLOAD_TYPE), _payload).alias("payload"))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _typed(field: Column, kinds: tuple[str, ...], out: str) -> Column:
    """A variant as a value if its JSON type fits, else null: a number is no text and a text no number."""
    kind = _kind(field)
    fits = F.startswith(kind, F.lit(kinds[0]))
    for other in kinds[1:]:
        fits = fits | F.startswith(kind, F.lit(other))
    return F.when(fits, F.try_variant_get(field, "$", out))


_TEXT, _NUMBER, _FLAG = ("STRING",), ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), ("BOOLEAN",)
_RULE_TEXTS = ("id", "label", "riskLevel", "category", "placeholderPrefix", "pattern", "flags", "message")
_PAYLOAD_FIELDS = ("schemaVersion", "version", "generatedAt", "expiresAt", "deliveryStatus", "minExtensionVersion")


def _fields(*names: str) -> str:
    return ", ".join(f"{name}: variant" for name in names)


# All fields come out of the variant in one walk, as variants that still know their JSON type. A part that is no object is null.
_PAYLOAD_TYPE = f"struct<{_fields(*_PAYLOAD_FIELDS)}, rules: array<struct<{_fields(*_RULE_TEXTS, 'confidence', 'enabled')}>>>"
_BUNDLE_TYPE = f"struct<{_fields('alg', 'keyId', 'signature')}, payload: {_PAYLOAD_TYPE}>"


def _rule(rule: Column) -> Column:
    return F.struct(
        *(_typed(rule[name], _TEXT, "string").alias(name) for name in _RULE_TEXTS),
        _typed(rule["confidence"], _NUMBER, "double").alias("confidence"), _typed(rule["enabled"], _FLAG, "boolean").alias("enabled"),
    )


def _payload(fields: Column) -> Column:
    text = lambda name: _typed(fields[name], _TEXT, "string").alias(name)
    version = _typed(fields["schemaVersion"], _NUMBER, "double")
    # A delivery status of another type is no valid status; JSON null counts as absent.
    status = F.when(~_kind(fields["deliveryStatus"]).isin("", "VOID"), F.coalesce(text("deliveryStatus"), F.lit("")))
    return F.struct(
        let(version, lambda v: F.when(v == F.floor(v), v.cast("int"))).alias("schemaVersion"), text("version"), text("generatedAt"),
        text("expiresAt"), status.alias("deliveryStatus"), text("minExtensionVersion"), F.transform(fields["rules"], _rule).alias("rules"),
    )


def parse_signed_bundles(json: Column) -> Column:
    """A bundle out of a JSON string column, types checked: a field of the wrong type is null, as if it were absent.

    ``well_formed`` tells whether the text is a JSON object at all.
    """

    def bundle(fields: Column) -> Column:
        formed = fields.isNotNull()
        return F.struct(
            _typed(fields["alg"], _TEXT, "string").alias("alg"), _typed(fields["keyId"], _TEXT, "string").alias("keyId"),
            F.when(formed, _payload(fields["payload"])).alias("payload"), _typed(fields["signature"], _TEXT, "string").alias("signature"),
            formed.alias("well_formed"),
        )

    return let(F.try_variant_get(F.try_parse_json(json), "$", _BUNDLE_TYPE), bundle)


def safe_files(files: DataFrame, mode: str = "mask") -> DataFrame:
    """Files as they may be passed on: risky ones rewritten and renamed, clean ones as they are."""
    resolve_mode(mode)
    found = with_findings(files, "text")
    rewritten = with_rewritten(found, "text", "findings", mode, "_safe")
    risky = F.size("findings") > 0
    return rewritten.select(
        *[c for c in files.columns if c not in ("name", "text")],
        F.when(risky, safe_name(F.col("name"))).otherwise(F.col("name")).alias("name"),
        F.when(risky, F.col("_safe")).otherwise(F.col("text")).alias("text"),
        risky.alias("rewritten"),
    )


def write_safe_files(files: DataFrame, target: str, mode: str = "mask") -> None:
    """Write the safe form of files as a table keyed by safe name."""
    safe_files(files, mode).write.mode("overwrite").parquet(target)
