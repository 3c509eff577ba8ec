"""Strict JSON lines: what a record may hold is said by key and kind, and every line that breaks it is named with the reason.

A line is parsed to a VARIANT, which refuses repeated keys at any depth (a record whose later value silently wins is worse than
none). All of it is built-in functions, so a table of any size is checked in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: Kinds of values, by what a VARIANT says of itself.
KINDS = {"text": "^STRING$", "whole": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "truth": "^BOOLEAN$", "list": "^ARRAY<.*", "object": "^OBJECT<.*"}


def reason(line: Column, spec: dict[str, str], required: tuple[str, ...] = ()) -> Column:
    """Why a line is refused, or null: not JSON, repeated key, not an object, unknown <key>, no <key>, <key> isn't <kind>.

    spec: key -> kind (text, whole, number, truth, list, object); a null value counts as absent. Of several faults the first in
    this order is named, of several keys the least. A null line isn't JSON.
    """

    def judged(x: Column) -> Column:
        v, keys = x["v"], x["keys"]
        unknown = F.array_min(F.array_except(keys, F.array(*map(F.lit, spec)) if spec else F.array().cast("array<string>")))
        kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$['{k}']", "variant"))
        there = lambda k: F.coalesce(kind(k) != "VOID", F.lit(False))
        absent = [F.when(~there(k), F.lit(f"no {k}")) for k in sorted(required)]
        wrong = [F.when(there(k) & ~kind(k).rlike(KINDS[spec[k]]), F.lit(f"{k} isn't {spec[k]}")) for k in sorted(spec)]
        return (
            F.when(x["loose"].isNull() & v.isNull(), "not JSON").when(v.isNull(), "repeated key").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
            .when(unknown.isNotNull(), F.concat(F.lit("unknown "), unknown)).otherwise(F.coalesce(*absent, *wrong, F.lit(None).cast("string")))
        )

    each = F.struct(F.try_parse_json(line).alias("v"), F.from_json(line, "map<string,string>", {"mode": "PERMISSIVE"}).alias("loose"), F.coalesce(F.json_object_keys(line), F.array().cast("array<string>")).alias("keys"))
    return T.bound(each, judged)


def records(lines: DataFrame, spec: dict[str, str], required: tuple[str, ...] = (), column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(lines that hold, with their VARIANT as record; lines that don't, with their reason), other columns kept."""
    told = lines.withColumn("reason", reason(F.col(f"`{column}`"), spec, required))
    return told.where("reason is null").drop("reason").withColumn("record", F.try_parse_json(F.col(f"`{column}`"))), told.where("reason is not null")
