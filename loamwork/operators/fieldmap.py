"""Declarative field maps: path and transform, compiled to Columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.compare import values_agree
from loamwork.functions.text import strip, to_float
from loamwork.operators.jsonpaths import read_path

REPRODUCTION_BAR = 0.60
SCALARS = ("none", "x10000", "int", "float")


class FieldMapError(ValueError):
    pass


def parse_fieldmap(raw: str) -> dict:
    """{field: {path, transform}} from JSON text, fences dropped; every spec needs a transform."""
    text = raw.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        found = json.loads(text)
    except ValueError as e:
        raise FieldMapError("not JSON") from e
    if not isinstance(found, dict) or any(not isinstance(s, dict) or "transform" not in s for s in found.values()):
        raise FieldMapError("not a map of specs")
    return found


def _text(value: Column, steps: list) -> Column:
    return read_path(value, steps, "string")


def compile_field(value: Column, spec: dict) -> Column:
    """A field of the record as text (containers as JSON); null for any miss, bad value or unknown transform."""
    nothing = F.lit(None).cast("string")
    transform, path = spec.get("transform"), spec.get("path") or []
    if isinstance(transform, dict):
        if "map" in transform:
            kind, text = F.schema_of_variant(read_path(value, path)), _text(value, path)
            out = F.when(kind != "STRING", nothing)
            for k, code in transform["map"].items():
                out = out.when(F.contains(text, F.lit(k)), F.lit(code))
            return out.otherwise(nothing)
        if "concat" in transform:
            parts = F.filter(F.array(*[strip(_text(value, p)) for p in transform["concat"]]), lambda x: x.isNotNull() & (x != ""))
            return F.when(F.size(parts) > 0, F.array_join(parts, transform.get("sep", "")))
        if "list" in transform and transform["list"]:
            items = read_path(value, transform["list"][0], "array<variant>")
            field = transform.get("field")
            if field is not None:
                # an element without the key drops out; one whose value is null stays
                own = F.filter(items, lambda x: F.try_variant_get(x, "$", "map<string,variant>")[field].isNotNull())
                items = F.transform(own, lambda x: F.try_variant_get(x, "$", "map<string,variant>")[field])
            return F.to_json(items)
        return nothing
    if transform not in SCALARS:
        return nothing
    got = read_path(value, path)
    text = _text(value, path)
    if transform == "none":
        kind = F.schema_of_variant(got)
        return F.when(got.isNull(), None).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(got)).otherwise(text)
    number = F.when(F.schema_of_variant(got) != "BOOLEAN", to_float(text))
    if transform == "x10000":
        return F.bround(number * 10000).try_cast("bigint").cast("string")
    if transform == "int":
        return number.try_cast("bigint").cast("string")
    return number.cast("string")


def apply_fieldmap(df: DataFrame, fieldmap: dict, body: str = "json") -> DataFrame:
    """df with one column per field, all read from the JSON text in one projection."""
    parsed = df.withColumn("_v", F.try_parse_json(body))
    return parsed.select(*df.columns, *[compile_field(F.col("_v"), spec).alias(name) for name, spec in fieldmap.items()])


def _path_of(steps: Column) -> Column:
    """The path text of a variant array of steps; null if a step is none, or a key has quotes of both kinds."""
    kind = lambda x: F.regexp_extract(F.schema_of_variant(x), r"^\w+", 0)
    text = lambda x: F.try_variant_get(x, "$", "string")
    quote = lambda t: F.when(~F.contains(t, F.lit("'")), F.concat(F.lit("['"), t, F.lit("']"))).when(~F.contains(t, F.lit('"')), F.concat(F.lit('["'), t, F.lit('"]')))
    parts = F.transform(F.try_variant_get(steps, "$", "array<variant>"), lambda x: F.when(kind(x) == "STRING", quote(text(x))).when((kind(x) == "BIGINT") & ~text(x).startswith("-"), F.concat(F.lit("["), text(x), F.lit("]"))))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), F.concat(F.lit("$"), F.array_join(parts, "")))


def _let(value: Column, then) -> Column:
    """then(value), the value being worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _own_field(value: Column, spec: Column) -> Column:
    """compile_field for a spec that is a row's own: JSON text."""
    own = F.from_json(spec, "path string, transform string")
    asked = F.struct(own["transform"].alias("name"), F.from_json(own["transform"], "map<string,string>").alias("rule"), _path_of(F.try_parse_json(F.coalesce(own["path"], F.lit("[]")))).alias("path"))

    def read(q: Column) -> Column:
        got = F.try_variant_get(value, q["path"], "variant")
        found = F.struct(F.when(~F.is_variant_null(got), got).alias("got"), F.try_variant_get(value, q["path"], "string").alias("text"), F.schema_of_variant(F.when(~F.is_variant_null(got), got)).alias("kind"))
        return _let(found, lambda g: made(q["name"], q["rule"], g["got"], g["text"], g["kind"]))

    def made(name: Column, rule: Column, got: Column, text: Column, kind: Column) -> Column:
        number = F.when(kind != "BOOLEAN", to_float(text))
        scalar = (
            F.when(name == "none", F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(got)).when(got.isNotNull(), text))
            .when(name == "x10000", F.bround(number * 10000).try_cast("bigint").cast("string"))
            .when(name == "int", number.try_cast("bigint").cast("string"))
            .when(name == "float", number.cast("string")))
        labels = F.from_json(rule["map"], "map<string,string>")
        label = F.get(F.filter(F.map_keys(labels), lambda k: F.contains(text, k)), F.lit(0))
        paths = F.try_variant_get(F.try_parse_json(rule["concat"]), "$", "array<variant>")
        parts = F.filter(F.transform(paths, lambda p: strip(F.try_variant_get(value, _path_of(p), "string"))), lambda x: x.isNotNull() & (x != ""))
        first = F.get(F.try_variant_get(F.try_parse_json(rule["list"]), "$", "array<variant>"), F.lit(0))
        items = F.try_variant_get(value, _path_of(first), "array<variant>")
        inner = F.filter(F.transform(items, lambda x: F.element_at(F.try_variant_get(x, "$", "map<string,variant>"), rule["field"])), lambda x: x.isNotNull())
        return (
            F.when(rule["map"].isNotNull(), F.when(kind == "STRING", F.element_at(labels, label)))
            .when(rule["concat"].isNotNull(), _let(parts, lambda p: F.when(F.size(p) > 0, F.call_function("array_join", p, F.coalesce(rule["sep"], F.lit(""))))))
            .when(rule["list"].isNotNull(), F.to_json(F.when(rule["field"].isNull(), items).otherwise(inner)))
            .otherwise(scalar))

    return _let(asked, read)


def apply_specs(df: DataFrame, fields: list[str], spec: str = "spec", body: str = "json") -> DataFrame:
    """df with one column per field, each row read by the field map of its own (JSON text in `spec`): any number of maps in
    one projection. As apply_fieldmap, but that keys with quotes of both kinds read as missing."""
    own = df.withColumn("_v", F.try_parse_json(body)).withColumn("_s", F.map_entries(F.from_json(spec, "map<string,string>")))
    read = F.map_from_entries(F.transform("_s", lambda e: F.struct(e["key"], _own_field(F.col("_v"), e["value"]))))
    return own.withColumn("_r", read).select(*df.columns, *[F.col("_r")[n].alias(n) for n in fields])


def reproduction_ratio(df: DataFrame, fieldmap: dict, oracle: DataFrame, key: str, body: str = "json") -> DataFrame:
    """(key, ratio): share of the known record's filled fields that the map reproduces; 1 if none is filled."""
    fields = [c for c in oracle.columns if c != key]
    got = apply_fieldmap(df.select(key, body), fieldmap, body).drop(body)
    both = oracle.select(key, *[F.col(c).cast("string").alias(f"_want_{c}") for c in fields]).join(got, key, "left")
    hit = sum((F.coalesce(values_agree(F.col(c), F.col(f"_want_{c}")), F.lit(False)).cast("int") if c in fieldmap else F.lit(0) for c in fields), F.lit(0))
    filled = sum((F.col(f"_want_{c}").isNotNull().cast("int") for c in fields), F.lit(0))
    return both.select(key, F.when(filled == 0, 1.0).otherwise(hit / filled).alias("ratio"))
