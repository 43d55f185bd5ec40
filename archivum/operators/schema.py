"""Conformance of JSON texts to a JSON Schema, as column expressions built from the schema.

Every node of the schema becomes an expression over the variant at its place, which gives the list of what is wrong
there and below; one projection checks a whole record, without a shuffle and without Python. A keyword says nothing
about values of other types, as the schema language has it. The path of a violation names keys and list places
(``$.result.box1.keywords[2]``). A schema with a keyword that isn't known here is an error when the check is built,
so nothing is passed over in silence."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

FOUND = "array<struct<path: string, keyword: string, expected: string>>"
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"

Schema = Mapping[str, Any]


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _is(v: Column, t: Column, name: str) -> Column:
    """Whether the value, whose type Spark shows as ``t``, is of the type that the schema language names so."""
    number = t.rlike(NUMBER)
    kinds = {
        "null": t == "VOID", "string": t == "STRING", "boolean": t == "BOOLEAN", "array": t.startswith("ARRAY"), "object": t.startswith("OBJECT"),
        "number": number, "integer": number & (_as(v, "double") == F.floor(_as(v, "double"))),
    }
    return kinds[name]


def _any(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _among(v: Column, t: Column, values: Sequence[Any]) -> Column:
    """Whether the value is one of scalar values, each of its own type."""
    texts = [x for x in values if isinstance(x, str)]
    flags = [x for x in values if isinstance(x, bool)]
    numbers = [float(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
    if len(texts) + len(flags) + len(numbers) + sum(x is None for x in values) < len(values):
        raise ValueError("enum and const are for texts, numbers, booleans and null")
    return _any([
        _is(v, t, "string") & _as(v, "string").isin(texts), _is(v, t, "boolean") & _as(v, "boolean").isin(flags),
        _is(v, t, "number") & _as(v, "double").isin(numbers), _is(v, t, "null") & F.lit(None in values),
    ])


# What each keyword of a single value asks for: (type it speaks of, test).
TESTS: dict[str, tuple[str, Callable[[Column, Any], Column]]] = {
    "minimum": ("number", lambda v, x: _as(v, "double") >= x), "maximum": ("number", lambda v, x: _as(v, "double") <= x),
    "exclusiveMinimum": ("number", lambda v, x: _as(v, "double") > x), "exclusiveMaximum": ("number", lambda v, x: _as(v, "double") < x),
    "minLength": ("string", lambda v, x: F.length(_as(v, "string")) >= x), "maxLength": ("string", lambda v, x: F.length(_as(v, "string")) <= x),
    "pattern": ("string", lambda v, x: _as(v, "string").rlike(x)),
    "minItems": ("array", lambda v, x: F.size(_as(v, "array<variant>")) >= x), "maxItems": ("array", lambda v, x: F.size(_as(v, "array<variant>")) <= x),
}
KNOWN = {"type", "enum", "const", "anyOf", "required", "properties", "additionalProperties", "items", *TESTS}


def _found(path: Column, keyword: str, expected: Any) -> Column:
    return F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), F.lit(json.dumps(expected)).alias("expected"))


def _none() -> Column:
    return F.array().cast(FOUND)


def _check(value: Column, path: Column, schema: Schema) -> Column:
    """The violations at the value and below it, as a list that is never null. The value, its type and its fields are
    bound, so that each is read once however many keywords speak of it."""
    fields = lambda v: rules.bind(_as(v, "map<string,variant>"), lambda m: rules.bind(F.schema_of_variant(v), lambda t: _wrong(v, t, m, path, schema)))
    return rules.bind(value, fields)


def _wrong(v: Column, t: Column, fields: Column, path: Column, schema: Schema) -> Column:
    """The violations at a bound value of type ``t``; ``fields`` is null for what is no object."""
    odd = set(schema) - KNOWN - NOTES
    if odd:
        raise ValueError(f"schema keywords not known: {sorted(odd)}")
    broken = []  # one entry, or null, for each keyword
    fails = lambda ok, keyword: broken.append(F.when(~F.coalesce(ok, F.lit(True)), _found(path, keyword, schema[keyword])))
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], (list, tuple)) else [schema["type"]]
        fails(_any([_is(v, t, n) for n in names]), "type")
    if "enum" in schema:
        fails(_among(v, t, schema["enum"]), "enum")
    if "const" in schema:
        fails(_among(v, t, [schema["const"]]), "const")
    if "anyOf" in schema:
        fails(_any([F.size(_check(v, path, s)) == 0 for s in schema["anyOf"]]), "anyOf")
    for keyword, (kind, test) in TESTS.items():
        if keyword in schema:
            fails(~_is(v, t, kind) | test(v, schema[keyword]), keyword)
    for name in schema.get("required", ()):
        broken.append(F.when(~F.map_contains_key(fields, name), _found(path, "required", name)))
    below = [F.array_compact(F.array(*broken)).cast(FOUND)] if broken else []
    properties, more = schema.get("properties", {}), schema.get("additionalProperties", True)
    at = lambda key: F.concat(path, F.lit("."), key)
    for name, s in properties.items():
        below.append(F.when(F.map_contains_key(fields, name), _check(fields[name], at(F.lit(name)), s)).otherwise(_none()))
    if more is not True:
        others = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*properties))
        if more is False:
            each = F.transform(others, lambda e: _found(at(e["key"]), "additionalProperties", False)).cast(FOUND)
        else:
            each = F.flatten(F.transform(others, lambda e: _check(e["value"], at(e["key"]), more)))
        below.append(F.coalesce(each, _none()))
    if "items" in schema:
        each = F.transform(_as(v, "array<variant>"), lambda x, i: _check(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema["items"]))
        below.append(F.coalesce(F.flatten(each), _none()))
    return F.concat(*below) if below else _none()


def violations(rows: DataFrame, schema: Schema, column: str = "json", keys: Sequence[str] = ("group_key",)) -> DataFrame:
    """(keys, path, keyword, expected): one row for everything in the JSON texts of ``column`` that the schema forbids;
    ``expected`` is what the keyword asks for, as JSON, of ``required`` the name that is missing. A text that isn't JSON,
    or null, has one row with the keyword ``json``."""
    read = rows.select(*keys, F.try_parse_json(F.col(column)).alias("v"))
    unread = F.array(_found(F.lit("$"), "json", None)).cast(FOUND)
    found = F.when(F.col("v").isNull(), unread).otherwise(_check(F.col("v"), F.lit("$"), schema))
    return read.select(*keys, F.explode(found).alias("f")).select(*keys, "f.path", "f.keyword", "f.expected")


def violation_counts(found: DataFrame) -> DataFrame:
    """(place, keyword, n) over all rows; in ``place`` the number of a list entry is left out."""
    return found.groupBy(F.regexp_replace("path", r"\[\d+\]", "[]").alias("place"), "keyword").agg(F.count(F.lit(1)).alias("n"))


def fixed_object(properties: Mapping[str, Schema], optional: Sequence[str] = ()) -> dict[str, Any]:
    """The schema of an object with these fields and no other."""
    return {"type": "object", "properties": dict(properties), "required": [k for k in properties if k not in optional], "additionalProperties": False}
