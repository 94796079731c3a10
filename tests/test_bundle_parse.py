"""A signed bundle out of JSON: types of fields, parts that are no objects, and one walk for all fields."""

import json

from pyspark.sql import functions as F

from veilscan.sources.readers import parse_signed_bundles

RULE = {"id": "r", "label": 5, "riskLevel": "high", "category": None, "pattern": {"x": 1}, "flags": "g", "confidence": 1, "enabled": "yes", "more": [1]}
PAYLOAD = {"schemaVersion": 1.0, "version": 7, "generatedAt": "g", "expiresAt": None, "deliveryStatus": "paused", "rules": [RULE, 3, None, {"confidence": 0.5, "enabled": False}]}
SIGNED = {"alg": "a", "keyId": True, "payload": PAYLOAD, "signature": "s"}


def parsed(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    return df.select("i", parse_signed_bundles(F.col("value")).alias("b"))


def test_fields_of_a_wrong_type_are_null(spark):
    kinds = [5, None, {"a": "b"}, "active"]
    values = [json.dumps(SIGNED), None, "no json", "[1]", "null", "{}", '{"alg":"a","alg":"b"}', json.dumps({"payload": 3, "alg": "x"}), json.dumps({"payload": {"rules": {"id": "r"}, "schemaVersion": 1.5}})]
    values += [json.dumps({"payload": {"deliveryStatus": k}}) for k in kinds]
    rows = [r["b"].asDict(recursive=True) for r in parsed(spark, values).orderBy("i").collect()]
    none = dict.fromkeys(("id", "label", "riskLevel", "category", "placeholderPrefix", "pattern", "flags", "message", "confidence", "enabled"))
    empty = dict.fromkeys(("schemaVersion", "version", "generatedAt", "expiresAt", "deliveryStatus", "minExtensionVersion", "rules"))
    no = {"alg": None, "keyId": None, "payload": None, "signature": None, "well_formed": False}
    rules = [none | {"id": "r", "riskLevel": "high", "flags": "g", "confidence": 1.0}, none, none, none | {"confidence": 0.5, "enabled": False}]
    payload = empty | {"schemaVersion": 1, "generatedAt": "g", "deliveryStatus": "paused", "rules": rules}
    assert rows[0] == {"alg": "a", "keyId": None, "payload": payload, "signature": "s", "well_formed": True}
    assert rows[1:5] == [no] * 4 and rows[6] == no
    assert rows[5] == no | {"payload": empty, "well_formed": True}
    assert rows[7] == no | {"alg": "x", "payload": empty, "well_formed": True}
    assert rows[8]["payload"] == empty
    assert [r["payload"]["deliveryStatus"] for r in rows[9:]] == ["", None, "", "active"]


def test_one_walk_for_all_fields(spark):
    plan = parsed(spark, ["{}"])._jdf.queryExecution().analyzed().toString()
    assert "try_variant_get" in plan and "$." not in plan
