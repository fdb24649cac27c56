"""Canonical JSON and its hashes against Python's own."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from lexiloom.functions import canonical
from lexiloom.functions.answers import json_value


def value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind == 0:
        return rng.choice([0, -1, 7, 10**6, 2**40, -(2**62), 10**25])
    if kind == 1:
        return rng.choice([0.5, -1.25, 2.0, 1e-3, 1.5e-4, 2.5e-5, 1e7, 12345678.5, 1e15, 1e16, 1.5e300, -3e-12, 0.1, 100.0])
    if kind == 2:
        return rng.choice([True, False, None])
    if kind < 6:
        return "".join(rng.choice('ab"\\/\n\t\x01\x1fé日😀 {}[]:,') for _ in range(rng.randrange(8)))
    if kind < 7:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choice("abzé😀￿ Z_1") for _ in range(rng.randrange(1, 4))): value(rng, depth - 1) for _ in range(rng.randrange(5))}


def test_canonical_text_is_pythons(spark):
    rng = random.Random(11)
    values = [value(rng, 4) for _ in range(600)] + [{}, [], {"a": {}}, [[]], "", {"b": 1, "a": [1, {"d": 2.0, "c": None}]}]
    d = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=bool(i % 2))) for i, v in enumerate(values)], "i long, j string")
    v = json_value(F.col("j"))
    got = {r["i"]: r for r in d.select("i", canonical.canonical(v, depth=5).alias("tight"), canonical.canonical(v, ", ", ": ", 5).alias("spaced"), canonical.canonical_hash(F.col("j"), depth=5).alias("h")).collect()}
    for i, x in enumerate(values):
        tight = json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert got[i]["tight"] == tight
        assert got[i]["spaced"] == json.dumps(x, sort_keys=True, ensure_ascii=False)
        assert got[i]["h"] == hashlib.sha256(tight.encode()).hexdigest()


def test_no_json_and_deep_values_have_no_text(spark):
    d = spark.createDataFrame([(None,), ("{",), ("[[[1]]]",), ("[[1]]",)], "j string")
    assert [r[0] for r in d.select(canonical.canonical(json_value(F.col("j")), depth=2)).collect()] == [None, None, None, "[[1]]"]


def test_signatures_of_equal_configurations_are_equal(spark):
    d = spark.createDataFrame([('{"b": 1, "a": {"y": "x", "x": [1, 2]}}', None), ('{"a":{"x":[1,2],"y":"x"},"b":1}', "{}"), ('{"a":{"x":[2,1],"y":"x"},"b":1}', '{"t":"u"}')], "c string, g string")
    a, b, c = (r[0] for r in d.select(canonical.translation_signature(F.col("c"), F.col("g"))).collect())
    assert a == b and a["style_hash"] != c["style_hash"] and a["glossary_hash"] != c["glossary_hash"]
    assert a["glossary_hash"] == hashlib.sha256(b"{}").hexdigest()
