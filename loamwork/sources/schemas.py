"""Record schemas: fields, whether they are required, and what a valid value is."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.sources.jsonschema import FALSE, TRUE, ObjectNode, SchemaError, compile_schema, parsed, projected

#: Fields that rows of two lists are aligned by: the first that a schema has.
ALIGN = ("url", "name", "title", "text")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string, decimal, integer, boolean, url, enum, strings, json
    required: bool = False
    min_length: int = 0
    pattern: str | None = None
    above: float | None = None
    below: float | None = None
    codes: tuple[str, ...] = ()
    document: str | None = None  # of kind json: the field's own JSON Schema, complete in itself

    def schema(self) -> dict:
        """The field's JSON Schema."""
        if self.document:
            return json.loads(self.document)
        own: dict = {"decimal": {"type": "number", "format": "decimal"}, "integer": {"type": "integer"}, "boolean": {"type": "boolean"}, "url": {"type": "string", "format": "uri"}, "enum": {"enum": list(self.codes)},
                     "strings": {"type": "array", "items": {"type": "string"}}}.get(self.kind, {"type": "string"})
        own |= {k: v for k, v in (("minLength", self.min_length), ("pattern", self.pattern), ("exclusiveMinimum", self.above), ("exclusiveMaximum", self.below)) if v}
        if self.above == 0:
            own["exclusiveMinimum"] = 0
        return own if self.required else {"anyOf": [own, {"type": "null"}]}

    def valid(self, value: Column) -> Column:
        """Whether a value, as text, is valid; null is valid unless the field is required."""
        if self.kind == "decimal":
            n = F.trim(value).try_cast("decimal(38,18)")
            ok = n.isNotNull()
        elif self.kind == "integer":
            n = F.when(F.trim(value).rlike(r"^[+-]?\d+(\.0*)?$"), F.trim(value).try_cast("decimal(38,0)"))
            ok = n.isNotNull()
        elif self.kind == "boolean":
            n, ok = None, F.lower(value).isin(*TRUE, *FALSE)
        elif self.kind == "url":
            n, ok = None, value.rlike(r"(?i)^https?://[^/?#\s]+")
        elif self.kind == "enum":
            n, ok = None, value.isin(*self.codes)
        elif self.kind == "json":
            n, ok = None, F.size(compile_schema(self.schema()).failures(F.try_parse_json(value), F.lit(self.name))) == 0
        else:
            n, ok = None, F.lit(True)
        if n is not None and self.above is not None:
            ok = ok & (n > F.lit(self.above))
        if n is not None and self.below is not None:
            ok = ok & (n < F.lit(self.below))
        if self.min_length:
            ok = ok & (F.char_length(value) >= self.min_length)
        if self.pattern:
            ok = ok & value.rlike(self.pattern)
        return F.when(value.isNull(), F.lit(not self.required)).otherwise(F.coalesce(ok, F.lit(False)))


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    volatile: frozenset[str] = frozenset()

    @cached_property
    def document(self) -> dict:
        """The JSON Schema of a record: no other keys are allowed."""
        return {"title": self.name, "type": "object", "required": self.required, "properties": {f.name: f.schema() for f in self.fields}, "additionalProperties": False}

    @cached_property
    def node(self) -> ObjectNode:
        """The record's compiled schema."""
        return compile_schema(self.document)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    @property
    def enums(self) -> list[str]:
        return [f.name for f in self.fields if f.kind == "enum"]

    @property
    def align_key(self) -> str | None:
        return next((k for k in ALIGN if k in self.names), None)

    def project(self, names: list[str]) -> Schema:
        """Only the named fields."""
        return Schema(self.name, tuple(f for f in self.fields if f.name in names), self.volatile & frozenset(names))

    def json(self, names: list[str] | None = None) -> str:
        """The schema as text; of some fields only, each complete in itself."""
        return json.dumps(self.document if names is None else projected(self.document, names), sort_keys=True)


class SchemaNotFound(LookupError):
    pass


SCHEMAS = {
    s.name: s
    for s in (
        Schema("Product@1", (
            Field("name", "string", True, min_length=1), Field("price", "decimal", True, above=0, below=1_000_000), Field("currency", "string", pattern="^[A-Z]{3}$"),
            Field("in_stock", "boolean", True), Field("url", "url", True), Field("image_url", "url")), frozenset({"price", "in_stock"})),
        Schema("JobPosting@1", (
            Field("title", "string", True, min_length=1), Field("company", "string", True, min_length=1), Field("salary", "integer", True, above=0),
            Field("employment_type", "enum", codes=("full_time", "part_time", "contract")), Field("location", "string", min_length=1), Field("url", "url"), Field("remote", "boolean")), frozenset({"salary"})),
        Schema("Quote@1", (Field("text", "string", True), Field("author", "string", True), Field("tags", "strings"), Field("url", "url"))),
    )
}


def get_schema(ref: str) -> Schema:
    """By name, with or without the version."""
    found = SCHEMAS.get(ref) or SCHEMAS.get(f"{ref}@1")
    if found is None:
        raise SchemaNotFound(ref)
    return found


#: Keys that a field of a plain kind may have.
_PLAIN = {"type", "minLength", "pattern", "exclusiveMinimum", "exclusiveMaximum", "format", "title", "description", "default", "examples"}


def _field(name: str, document: dict, required: bool) -> Field:
    """A field of a plain kind, if its schema is one; else of kind json."""
    options = document.get("anyOf") or []
    own = next((o for o in options if o.get("type") != "null"), document) if len(options) == 2 and any(o.get("type") == "null" for o in options) else document
    if {o.get("type") for o in options} - {"null"} == {"number", "string"}:
        own = next(o for o in options if o.get("type") == "number") | {"format": "decimal"}
    plain = set(own) <= _PLAIN and not isinstance(own.get("type"), list)
    if not plain and "enum" not in own and own.get("type") != "array":
        return Field(name, "json", required, document=json.dumps(document))
    bounds = {"min_length": own.get("minLength", 0), "pattern": own.get("pattern"), "above": own.get("exclusiveMinimum"), "below": own.get("exclusiveMaximum")}
    if "enum" in own and all(isinstance(c, str) for c in own["enum"]):
        return Field(name, "enum", required, codes=tuple(own["enum"]))
    if own.get("type") == "array" and own.get("items") == {"type": "string"} and not set(own) & {"minItems", "maxItems"}:
        return Field(name, "strings", required)
    kind = {"string": "url" if own.get("format") in ("uri", "url") else "string", "integer": "integer", "number": "decimal", "boolean": "boolean"}.get(own.get("type"))
    if plain and kind and own.get("format") in (None, "uri", "url", "decimal"):
        return Field(name, kind, required, **bounds)
    return Field(name, "json", required, document=json.dumps(document))


def schema_of(document: dict) -> Schema:
    """A record schema from a JSON Schema of an object; `x-volatile` lists its volatile fields. Named by its title, version 1
    if that has none."""
    if document.get("type") != "object" or not document.get("title"):
        raise SchemaError("a record's schema is an object with a title")
    compile_schema(document)
    title, required, own = document["title"], document.get("required", []), projected(document, list(document.get("properties", {})))
    made = Schema(title if "@" in title else f"{title}@1", tuple(_field(n, d, n in required) for n, d in own.items()), frozenset(document.get("x-volatile", ())))
    made.__dict__["document"] = document
    return made


def load_schema_file(path: str) -> Schema:
    """A schema from a JSON file: a JSON Schema, or {name, fields: [{name, kind, ...}], volatile}."""
    with open(path) as f:
        raw = parsed(f.read())
    if "fields" not in raw:
        return schema_of(raw)
    return Schema(raw["name"], tuple(Field(**{**x, "codes": tuple(x.get("codes", ()))}) for x in raw["fields"]), frozenset(raw.get("volatile", ())))


def load_schemas(spark: SparkSession, folder: str) -> list[str]:
    """Reads all JSON Schemas (*.json) of a folder, in any store that Spark reads, in order of their names, and registers
    them: get_schema finds them from then on. Later ones of a name replace earlier ones. Returns the names."""
    files: DataFrame = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    found = [schema_of(parsed(r["value"])) for r in files.select("value", F.input_file_name().alias("at")).orderBy("at").collect()]
    SCHEMAS.update({s.name: s for s in found})
    return [s.name for s in found]
