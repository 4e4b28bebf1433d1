"""The schema compiler against record models, and its use in answers, tails and folders."""

import json

import pytest
from pyspark.sql import functions as F

from loamwork.operators.validate import item_failures, list_report
from loamwork.plans import trusted
from loamwork.sources import schemas
from loamwork.sources.jsonschema import SchemaError, compile_schema

DOCUMENT = {
    "title": "Listing", "type": "object", "additionalProperties": False, "required": ["title", "price", "area"], "x-volatile": ["price"],
    "$defs": {"Kind": {"enum": ["flat", "house"], "type": "string"}, "Place": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string", "minLength": 1}, "zip": {"type": "integer"}}, "additionalProperties": False}},
    "properties": {
        "title": {"type": "string", "minLength": 1, "maxLength": 9}, "price": {"anyOf": [{"type": "number", "exclusiveMinimum": 0}, {"type": "string"}]}, "area": {"type": "integer", "minimum": 1},
        "ratio": {"anyOf": [{"type": "number", "maximum": 1}, {"type": "null"}]}, "sold": {"anyOf": [{"type": "boolean"}, {"type": "null"}]}, "kind": {"anyOf": [{"$ref": "#/$defs/Kind"}, {"type": "null"}]},
        "code": {"anyOf": [{"type": "string", "pattern": "^[A-Z]{3}$"}, {"type": "null"}]}, "url": {"anyOf": [{"type": "string", "format": "uri"}, {"type": "null"}]},
        "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 3}, "places": {"anyOf": [{"type": "array", "items": {"$ref": "#/$defs/Place"}}, {"type": "null"}]},
    },
}
VALUES = {
    "title": ["ok", "", "much too long", 5, None, True, ["x"]], "price": [1, 1.5, "2.50", " 3 ", "1_0", "x", "nan", -1, 0, "0", True, None, []], "area": [1, 1.0, 1.5, "7", " 8 ", "9.0", "x", "1_000", True, False, 0, None, {}, 10**17, "-3"],
    "ratio": [0.5, 1, 2, "0.25", "1e-3", "inf", "x", True, None, []], "sold": [True, False, 0, 1, 2, 1.0, 0.5, "yes", "OFF", "T", "maybe", "", None, []], "kind": ["flat", "shed", "Flat", 1, None],
    "code": ["GBP", "gbp", "GBPX", "GBP\n", 1, None], "url": ["https://a.b/c?d#e", "HTTP://x", "ftp://x", "a.b", "https://", 1, None], "tags": [[], ["a"], ["a", 1, None], ["a", "b", "c", "d"], "a", None],
    "places": [[], [{"city": "c"}], [{"city": "c", "zip": "12"}, {"zip": 1.5}, {"city": "", "state": 1}, 3], {"city": "c"}, None],
}
GOOD = {"title": "t", "price": 1, "area": 1}


def cases():
    out = [GOOD | {n: v} for n, values in VALUES.items() for v in values]
    return [*out, {}, {"title": "t", "other": 1, "price": 1, "area": 1, "zz": None}, {"price": 1, "area": 2}]


def failures(spark, items, document=DOCUMENT):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "i int, item string")
    return [r.failures for r in item_failures(df, schemas.schema_of(document)).orderBy("i").collect()]


def test_failures_are_those_of_a_record_model(spark):
    """Whether an item fails, and where, as the model library finds it; codes too, where both have one kind of type."""
    pydantic = pytest.importorskip("pydantic")
    import enum
    from decimal import Decimal
    from typing import Annotated, Optional

    class Kind(str, enum.Enum):
        flat = "flat"
        house = "house"

    class Place(pydantic.BaseModel):
        model_config = pydantic.ConfigDict(extra="forbid")
        city: str = pydantic.Field(min_length=1)
        zip: int = 0

    class Listing(pydantic.BaseModel):
        model_config = pydantic.ConfigDict(extra="forbid")
        title: str = pydantic.Field(min_length=1, max_length=9)
        price: Decimal = pydantic.Field(gt=0)
        area: int = pydantic.Field(ge=1)
        ratio: Optional[Annotated[float, pydantic.Field(le=1)]] = None
        sold: Optional[bool] = None
        kind: Optional[Kind] = None
        code: Optional[Annotated[str, pydantic.Field(pattern=r"^[A-Z]{3}$")]] = None
        url: Optional[pydantic.HttpUrl] = None
        tags: Annotated[list[str], pydantic.Field(max_length=3)] = []
        places: Optional[list[Place]] = None

    def wanted(item):
        try:
            Listing(**item)
        except pydantic.ValidationError as e:
            return {("".join(f"[{x}]" if isinstance(x, int) else f".{x}" for x in d["loc"]).lstrip("."), {"model_type": "dict_type", "url_scheme": "url_parsing"}.get(d["type"], d["type"])) for d in e.errors()}
        return set()

    found = [(item, {tuple(f.split(": ", 1)) for f in got}) for item, got in zip(cases(), failures(spark, cases()))]
    assert [(item, got, wanted(item)) for item, got in found if got != wanted(item)] == []


def test_order_nesting_and_bad_json(spark):
    assert failures(spark, [{"zz": 1, "places": [{"zip": "x"}], "aa": 2}]) == [["title: missing", "price: missing", "area: missing", "places[0].city: missing", "places[0].zip: int_parsing", "aa: extra_forbidden", "zz: extra_forbidden"]]
    df = spark.createDataFrame([("{bad",), ("[1]",), (None,)], "item string")
    assert [r.failures for r in item_failures(df, schemas.schema_of(DOCUMENT)).collect()] == [["item: json_invalid"], ["item: dict_type"], ["item: json_invalid"]]


def test_references_types_and_codes(spark):
    with pytest.raises(SchemaError):
        compile_schema({"$defs": {"A": {"items": {"$ref": "#/$defs/A"}, "type": "array"}}, "$ref": "#/$defs/A"})
    with pytest.raises(SchemaError):
        compile_schema({"properties": {"x": {"$ref": "#/$defs/None"}}})
    with pytest.raises(SchemaError):
        compile_schema({"type": "tuple"})
    own = {"title": "T", "type": "object", "properties": {"a": {"type": ["integer", "null"]}, "b": {"const": 3}, "c": {"enum": [1, "x", None]}, "d": {"type": "object", "additionalProperties": {"type": "boolean"}}, "e": {"anyOf": [{"type": "integer"}, {"type": "array"}]}, "f": {"allOf": [{"type": "string"}, {"minLength": 2, "type": "string"}]}, "g": {"type": "string", "format": "date"}, "h": {"multipleOf": 5, "type": "integer"}}}
    items = [{"a": None, "b": 3.0, "c": None, "d": {"k": "yes"}, "e": [1], "f": "ab", "g": "2024-02-29", "h": 10, "more": 1}, {"a": "x", "b": "3", "c": 2, "d": {"k": "maybe", "l": 1}, "e": "x", "f": "a", "g": "2023-02-29", "h": 11}]
    assert failures(spark, items, own) == [[], ["a: int_parsing", "b: literal_error", "c: enum", "d.k: bool_parsing", "e: int_parsing", "e: list_type", "f: string_too_short", "g: date_parsing", "h: multiple_of"]]


def test_values_read_as_their_types(spark):
    node = schemas.schema_of(DOCUMENT).node
    df = spark.createDataFrame([(json.dumps({"area": a, "sold": s, "kind": k, "price": p, "ratio": r, "tags": t}),) for a, s, k, p, r, t in [("31350000", "true", "flat", " 2.50", "0.5", ["a"]), (7.0, 0, "shed", 3, True, "x"), (True, None, None, "x", None, [])]], "j string").withColumn("v", F.try_parse_json("j"))
    got = [tuple(r) for r in df.select(*[node.fields[n].value(node.get(F.col("v"), n)).alias(n) for n in ("area", "sold", "kind", "price", "ratio", "tags")]).collect()]
    assert got == [("31350000", "true", "flat", "2.50", "0.5", '["a"]'), ("7", "false", None, "3", "1.0", None), ("1", None, None, None, None, "[]")]


def test_lists_are_judged_in_their_row(spark):
    lists = [[GOOD] * 5, [], [GOOD] * 3 + [{"title": None, "price": 1, "area": 1}] * 2, [GOOD, GOOD | {"area": "x"}]]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lists)], "i int, j string").withColumn("items", F.try_variant_get(F.try_parse_json("j"), "$", "array<variant>"))
    got = [r.r for r in df.select("i", list_report(F.col("items"), schemas.schema_of(DOCUMENT)).alias("r")).orderBy("i").collect()]
    assert [(r.ok, r.reason, r.item_count, r.n_invalid) for r in got] == [(True, "", 5, 0), (False, "empty", 0, 0), (False, "fill_rate:title", 5, 2), (False, "schema: 1/2 items invalid", 2, 1)]
    assert got[3].failures == [[], ["area: int_parsing"]] and got[2].fill_rates["title"] == 0.6


def test_a_folder_of_schemas_is_registered(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "b.json").write_text(json.dumps({"title": "Other@2", "type": "object", "properties": {"n": {"type": "integer"}}}))
    (tmp_path / "notes.txt").write_text("no schema")
    try:
        assert schemas.load_schemas(spark, str(tmp_path)) == ["Listing@1", "Other@2"]
        found = schemas.get_schema("Listing")
        assert found.required == ["title", "price", "area"] and found.enums == ["kind"] and found.volatile == {"price"} and found.align_key == "url"
        assert {f.name: f.kind for f in found.fields} == {"title": "json", "price": "decimal", "area": "json", "ratio": "json", "sold": "boolean", "kind": "enum", "code": "string", "url": "url", "tags": "json", "places": "json"}
        assert "$ref" not in found.json(["kind", "places"]) and '"flat"' in found.json(["kind"])
    finally:
        for n in ("Listing@1", "Other@2"):
            schemas.SCHEMAS.pop(n, None)


def test_answers_and_tails_are_judged_by_the_schema(spark):
    pages = spark.createDataFrame([(i, f"<p>page {i}</p>") for i in range(4)], "page_id long, html string")
    answers = {0: [{"title": "t", "company": "c", "salary": "12", "remote": "yes"}], 1: [{"title": "t", "company": "c", "salary": "much"}], 2: [{"title": "t", "company": "c", "salary": 1, "other": 1}], 3: {"title": "t"}}
    seen = []

    def complete(text, error):
        page = int(text.split()[-1].split("<")[0])
        if error and page == 1:
            assert error == "schema: 1/1 items invalid"
            return json.dumps([{"title": "t", "company": "c", "salary": 3}])
        return json.dumps(answers[page])

    rows = {r.page_id: r for r in trusted.direct_extract(pages, complete, schemas.get_schema("JobPosting")).collect()}
    assert (rows[0].salary, rows[0].remote, rows[0].error) == ("12", "true", None) and rows[1].salary == "3"
    assert rows[2].error == "schema: 1/1 items invalid" and rows[3].error == "ValueError: expected a JSON array of objects" and rows[2].item_ix is None and not seen

    def tail(text, fields):
        return json.dumps({"employment_type": "full_time" if "0" in text else "Full-time", "remote": "true" if "1" in text else "perhaps", "salary": [1], "location": " ", "url": "https://a/b"})

    got = {r.page_id: r for r in trusted.fill_residual(pages, tail, ["employment_type", "remote", "salary", "location", "none"], schemas.get_schema("JobPosting")).collect()}
    assert [(got[i].employment_type, got[i].remote, got[i].salary, got[i].location) for i in range(3)] == [("full_time", None, None, None), (None, "true", None, None), (None, None, None, None)]


def test_scalar_fields_of_rows_are_judged_without_lambdas(spark):
    """Of a table's rows, what a predicate reads twice is a column, not a lambda's variable."""
    from loamwork.operators.validate import item_failures
    from loamwork.sources.schemas import schema_of

    schema = schema_of({"title": "T", "type": "object", "required": ["a"], "properties": {"a": {"type": "string"}, "n": {"type": "integer"}}})
    df = item_failures(spark.createDataFrame([('{"a":1,"n":"x"}',), ("{}",), ("[]",), ("{",), ('{"a":"","n":2}',)], "item string"), schema)
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.failures for r in df.collect()] == [["a: string_type", "n: int_parsing"], ["a: missing"], ["item: dict_type"], ["item: json_invalid"], []]
