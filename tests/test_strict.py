"""Strict JSON lines."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources import strict

SPEC = {"name": "text", "n": "whole", "x": "number", "on": "truth", "tags": "list", "more": "object"}
LINES = [
    ('{"name": "a", "n": 1, "x": 1.5, "on": true, "tags": [1, "b"], "more": {"k": null}}', None), ('{"name": "é"}', None), (' {"name": "a", "n": null} ', None), ('{"name": "a", "x": 3}', None),
    ('{"name": "a", "name": "b"}', "repeated key"), ('{"name": "a", "more": {"k": 1, "k": 2}}', "repeated key"), ('["name"]', "not an object"), ('"name"', "not an object"), ("17", "not an object"), ("null", "not an object"),
    ('{"name": "a"', "not JSON"), ("name", "not JSON"), ("", "not JSON"), (None, "not JSON"), ('{"name": "a", "z": 1, "b": 2}', "unknown b"), ("{}", "no name"), ('{"name": null}', "no name"),
    ('{"name": 5}', "name isn't text"), ('{"name": "a", "n": 1.5}', "n isn't whole"), ('{"name": "a", "n": "1"}', "n isn't whole"), ('{"name": "a", "x": true}', "x isn't number"), ('{"name": "a", "on": 1}', "on isn't truth"),
    ('{"name": "a", "tags": {}}', "tags isn't list"), ('{"name": "a", "more": []}', "more isn't object"),
]


def test_every_fault_is_named(spark):
    df = spark.createDataFrame([(k, line, "clash") for k, (line, _) in enumerate(LINES)], "k int, value string, v string").coalesce(1)
    got = {r.k: r.reason for r in df.select("k", strict.reason(F.col("value"), SPEC, ("name",)).alias("reason")).collect()}
    assert [(LINES[k][0], got[k]) for k in got] == LINES
    good, bad = strict.records(df, SPEC, ("name",))
    assert good.count() == 4 and bad.count() == len(LINES) - 4 and good.columns == ["k", "value", "v", "record"]
    assert good.select(F.variant_get("record", "$.name", "string").alias("n")).where("n is null").count() == 0


@pytest.mark.parametrize("depth", [50])
def test_deep_and_long_lines(spark, depth):
    rows = [('{"name": "' + "x" * 200_000 + '"}',), ('{"name": "a", "more": ' + '{"k": ' * depth + "1" + "}" * depth + "}",)]
    assert [r[0] for r in spark.createDataFrame(rows, "value string").coalesce(1).select(strict.reason(F.col("value"), SPEC)).collect()] == [None, None]
    assert spark.createDataFrame([], "value string").select(strict.reason(F.col("value"), {})).count() == 0
