"""JSON Schema compiled to Columns over variants: what is wrong with a value, and what it reads as."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamwork.functions.text import strip

# Texts that count as flags.
TRUE = ("true", "t", "yes", "y", "on", "1")
FALSE = ("false", "f", "no", "n", "off", "0")

INTEGER = r"^[+-]?\d+(_\d+)*(\.0*)?$"
NUMBER = r"(?i)^[+-]?((\d+(_\d+)*)?\.\d+(_\d+)*|\d+(_\d+)*\.?)(e[+-]?\d+)?$"
SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"
URL = r"(?i)^https?://[^/?#\s]+[^\s]*$"


class SchemaError(ValueError):
    """A schema that can't be compiled."""


def _none() -> Column:
    return F.array().cast("array<string>")


def kind_of(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, ARRAY or OBJECT."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _at(at: Column, code: Column) -> Column:
    """One failure, or none if the code is null."""
    return F.array_except(F.array(F.concat(at, F.lit(": "), code)), F.array(F.lit(None).cast("string")))


#: While a predicate over a table's rows is made: the columns it needs first, in order; None within lambdas and elsewhere.
_stages: ContextVar[list[tuple[str, Column]] | None] = ContextVar("stages", default=None)


@contextmanager
def staged(stages: list | None):
    """Within it, what predicates read more than once goes to `stages` as columns, which stay in generated code; None: no more."""
    token = _stages.set(stages)
    try:
        yield stages
    finally:
        _stages.reset(token)


def _unstaged(make: Callable[[], Column]) -> Column:
    """make(), for lambdas, whose variables no column can hold."""
    with staged(None):
        return make()


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value being worked out once, however often `then` names it."""
    if (stages := _stages.get()) is not None:
        stages.append((f"_s{len(stages)}", value))
        return then(F.col(stages[-1][0]))
    return F.get(F.transform(F.array(value), then), F.lit(0))


class Node:
    """A compiled schema. `failures(v, at)`: "place: code" of all that is wrong with variant v, a JSON null included; `dump(v)`:
    the text of what a sound v reads as."""

    def __init__(self, failures: Callable[[Column, Column], Column], dump: Callable[[Column], Column], nullable: bool = False):
        self.failures, self.dump, self.nullable = failures, dump, nullable

    def value(self, v: Column) -> Column:
        """The text that v reads as; null if v is missing, null or wrong."""
        sound = v.isNotNull() & ~F.is_variant_null(v) & (F.size(self.failures(v, F.lit(""))) == 0)
        return F.when(sound, self.dump(v))


def _bounds(schema: dict, n: Column) -> Column:
    """The first bound that a number breaks."""
    code = F.lit(None).cast("string")
    for key, name, broken in (("exclusiveMinimum", "greater_than", lambda x: n <= x), ("minimum", "greater_than_equal", lambda x: n < x), ("exclusiveMaximum", "less_than", lambda x: n >= x), ("maximum", "less_than_equal", lambda x: n > x), ("multipleOf", "multiple_of", lambda x: n % x != 0)):
        if key in schema:
            code = F.coalesce(code, F.when(broken(F.lit(schema[key])), name))
    return code


def _scalar(code: Callable[[Column, Column], Column], dump: Callable[[Column], Column]) -> Node:
    return Node(lambda v, at: _let(kind_of(v), lambda kind: _at(at, code(v, kind))), dump)


def _number_text(v: Column) -> Column:
    return F.replace(strip(text_of(v)), F.lit("_"), F.lit(""))


def _integer(schema: dict) -> Node:
    """Whole numbers, flags, and texts that are whole numbers."""
    flag = lambda v: F.when(kind_of(v) == "BOOLEAN", F.when(text_of(v) == "true", F.lit("1")).otherwise("0")).otherwise(_number_text(v))
    whole = lambda v: F.coalesce(F.regexp_replace(flag(v), r"\.0*$", "").try_cast("decimal(38,0)"), F.floor(flag(v).try_cast("double")).try_cast("decimal(38,0)"))

    def code(v, kind):
        number = kind.isin("DECIMAL", "DOUBLE")
        wrong = F.when(kind.isin("VOID", "ARRAY", "OBJECT"), "int_type").when(number & (text_of(v).try_cast("double") % 1 != 0), "int_from_float").when((kind == "STRING") & ~strip(text_of(v)).rlike(INTEGER), "int_parsing")
        return F.coalesce(wrong, _bounds(schema, whole(v)))

    return _scalar(code, lambda v: whole(v).cast("string"))


def _number(schema: dict) -> Node:
    """Numbers, flags, and texts that are numbers."""
    n = lambda v: F.when(kind_of(v) == "BOOLEAN", (text_of(v) == "true").cast("double")).otherwise(_number_text(v).try_cast("double"))

    def code(v, kind):
        text = strip(text_of(v))
        wrong = F.when(kind.isin("VOID", "ARRAY", "OBJECT"), "float_type").when((kind == "STRING") & ~(text.rlike(NUMBER) | text.rlike(SPECIAL)), "float_parsing")
        return F.coalesce(wrong, _bounds(schema, n(v)))

    return _scalar(code, lambda v: n(v).cast("string"))


def _decimal(schema: dict) -> Node:
    """Numbers and texts that are numbers, exactly; no flags."""
    n = lambda v: _number_text(v).try_cast("decimal(38,18)")

    def code(v, kind):
        text = strip(text_of(v))
        wrong = F.when(kind.isin("VOID", "ARRAY", "OBJECT", "BOOLEAN"), "decimal_type").when((kind == "STRING") & ~text.rlike(NUMBER), F.when(text.rlike(SPECIAL), "finite_number").otherwise("decimal_parsing"))
        return F.coalesce(wrong, _bounds(schema, F.coalesce(n(v), F.lit(None).cast("decimal(38,18)"))))

    return _scalar(code, lambda v: strip(text_of(v)))


def _boolean(schema: dict) -> Node:
    """Flags, 0 and 1, and the texts that stand for them."""
    flag = lambda v: F.when(kind_of(v) == "STRING", F.when(F.lower(text_of(v)).isin(*TRUE), True).when(F.lower(text_of(v)).isin(*FALSE), False)).when(
        kind_of(v) == "BOOLEAN", text_of(v) == "true").otherwise(F.when(text_of(v).try_cast("double") == 1, True).when(text_of(v).try_cast("double") == 0, False))

    def code(v, kind):
        return F.when(kind.isin("VOID", "ARRAY", "OBJECT") | (text_of(v).try_cast("double") % 1 != 0) & (kind != "STRING"), "bool_type").when(flag(v).isNull(), "bool_parsing")

    return _scalar(code, lambda v: flag(v).cast("string"))


def _whole_end(pattern: str) -> str:
    """A final $ is the end of the text, not the place before a last line break."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") and not pattern.endswith("\\$") else pattern


def _string(schema: dict) -> Node:
    """Texts only: a number is none."""

    def code(v, kind):
        text = text_of(v)
        wrong = F.when(kind != "STRING", "url_type" if schema.get("format") in ("uri", "url") else "string_type")
        for key, name, broken in (("minLength", "string_too_short", lambda x: F.char_length(text) < x), ("maxLength", "string_too_long", lambda x: F.char_length(text) > x), ("pattern", "string_pattern_mismatch", lambda x: ~text.rlike(_whole_end(x)))):
            if key in schema:
                wrong = wrong.when(broken(schema[key]), name)
        if schema.get("format") in ("uri", "url"):
            wrong = wrong.when(~strip(text).rlike(URL), "url_parsing")
        if schema.get("format") == "date":
            wrong = wrong.when(~text.rlike(r"^\d{4}-\d{2}-\d{2}\z") | text.try_cast("date").isNull(), "date_parsing")
        if schema.get("format") == "date-time":
            wrong = wrong.when(text.try_cast("timestamp").isNull(), "datetime_parsing")
        return wrong

    return _scalar(code, text_of)


def _codes(values: list, name: str) -> Node:
    """One of some values, of its own JSON type."""

    def code(v, kind):
        ok = F.lit(False)
        for x in values:
            same = text_of(v) == ("true" if x is True else "false" if x is False else str(x))
            of = ["VOID"] if x is None else ["BOOLEAN"] if isinstance(x, bool) else ["STRING"] if isinstance(x, str) else ["BIGINT", "DECIMAL", "DOUBLE"]
            same = same if isinstance(x, (str, bool)) else text_of(v).try_cast("double") == float(x) if x is not None else F.lit(True)
            ok = ok | (kind.isin(*of) & same)
        return F.when(~F.coalesce(ok, F.lit(False)), name)

    return Node(lambda v, at: _let(kind_of(v), lambda kind: _at(at, code(v, kind))), text_of, None in values)


def _array(schema: dict, compiled: Callable[[dict], Node]) -> Node:
    item = compiled(schema.get("items") or {})

    def failures(v, at):
        items = F.try_variant_get(v, "$", "array<variant>")
        size = F.size(items)
        code = F.when(kind_of(v) != "ARRAY", "list_type")
        for key, name, broken in (("minItems", "too_short", lambda x: size < x), ("maxItems", "too_long", lambda x: size > x)):
            if key in schema:
                code = code.when(broken(schema[key]), name)
        inner = _unstaged(lambda: F.flatten(F.transform(items, lambda x, i: item.failures(x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
        return F.concat(_at(at, code), F.when(kind_of(v) == "ARRAY", F.coalesce(inner, _none())).otherwise(_none()))

    return Node(failures, lambda v: F.to_json(v))


class ObjectNode(Node):
    """An object: its fields are read in one pass over its keys."""

    def __init__(self, schema: dict, compiled: Callable[[dict], Node]):
        self.fields = {n: compiled(s) for n, s in (schema.get("properties") or {}).items()}
        self.required = [n for n in schema.get("required") or []]
        more = schema.get("additionalProperties", True)
        self.closed, self.more = more is False, compiled(more) if isinstance(more, dict) else None
        super().__init__(self._failures, lambda v: F.to_json(v))

    def get(self, v: Column, name: str) -> Column:
        """A field's variant; null if the key is missing, a variant null if its value is null."""
        return F.try_variant_get(v, "$", "map<string,variant>")[name]

    def _failures(self, v: Column, at: Column) -> Column:
        below = F.when(at == "", F.lit("")).otherwise(F.concat(at, F.lit(".")))
        wrong = F.array(F.concat(F.when(at == "", F.lit("item")).otherwise(at), F.lit(": dict_type")))
        return F.when(kind_of(v) == "OBJECT", _let(F.try_variant_get(v, "$", "map<string,variant>"), lambda own: self._inner(own, below))).otherwise(wrong)

    def _field(self, n: str, below: Column) -> Callable[[Column], Column]:
        """Of a field's variant, null if the key is missing."""
        missing = F.array(F.concat(below, F.lit(f"{n}: missing"))) if n in self.required else _none()
        found = self.fields[n].failures if n in self.fields else lambda x, at: _none()
        return lambda x: F.when(x.isNull(), missing).otherwise(found(x, F.concat(below, F.lit(n))))

    def _inner(self, own: Column, below: Column) -> Column:
        """Of an object's values by key."""
        parts = []
        for n in [*self.fields, *(n for n in self.required if n not in self.fields)]:
            parts.append(_let(own[n], self._field(n, below)))
        others = F.sort_array(F.array_except(F.map_keys(own), F.array(*map(F.lit, self.fields)).cast("array<string>")))
        if self.closed:
            parts.append(F.transform(others, lambda k: F.concat(below, k, F.lit(": extra_forbidden"))))
        elif self.more is not None:
            parts.append(_unstaged(lambda: F.flatten(F.transform(others, lambda k: self.more.failures(own[k], F.concat(below, k))))))
        return F.concat(*parts) if parts else _none()


def _any(nodes: list[Node]) -> Node:
    """Sound if one of the nodes finds it so, read by the first that does; else what each finds."""
    if len(nodes) == 1:
        return nodes[0]

    def failures(v, at):
        found = [n.failures(v, at) for n in nodes]
        sound = F.lit(False)
        for f in found:
            sound = sound | (F.size(f) == 0)
        return F.when(sound, _none()).otherwise(F.array_distinct(F.concat(*found)))

    def dump(v):
        out = F.lit(None).cast("string")
        for n in reversed(nodes):
            out = F.when(F.size(n.failures(v, F.lit(""))) == 0, n.dump(v)).otherwise(out)
        return out

    return Node(failures, dump)


def _or_null(node: Node) -> Node:
    return Node(lambda v, at: F.when(F.is_variant_null(v), _none()).otherwise(node.failures(v, at)), node.dump, True)


def compile_schema(document: dict) -> Node:
    """The node of a JSON Schema: types (one or several), properties, required, additionalProperties, items, enum, const,
    anyOf, oneOf (as anyOf), allOf, local $ref, lengths, bounds, patterns and the formats uri, date and date-time.

    Types are lax in the way of record models: 3.0, "3" and true are integers, "yes" and 1 are flags, texts
    are texts only. A number or a string (anyOf), or format decimal, is an exact decimal. Codes of failures are the names that such models
    give them: missing, int_parsing, greater_than, extra_forbidden, ... A $ref into itself raises SchemaError, as does one that leads nowhere.
    """

    def compiled(schema: dict | bool, seen: tuple[str, ...] = ()) -> Node:
        if schema is True or schema == {}:
            return Node(lambda v, at: _none(), lambda v: F.when(kind_of(v).isin("ARRAY", "OBJECT"), F.to_json(v)).otherwise(text_of(v)), True)
        if "$ref" in schema:
            ref = schema["$ref"]
            if ref in seen:
                raise SchemaError(f"{ref} refers to itself")
            target = document
            for step in ref.removeprefix("#").split("/")[1:] if ref.startswith("#") else [None]:
                target = target.get(step.replace("~1", "/").replace("~0", "~")) if step is not None and isinstance(target, dict) else None
            if target is None:
                raise SchemaError(f"{ref} leads nowhere")
            return compiled(target, (*seen, ref))
        own = lambda s: compiled(s, seen)
        for key in ("anyOf", "oneOf"):
            if key in schema:
                options = [o for o in schema[key] if o.get("type") != "null"]
                kinds = {o.get("type") for o in options}
                node = _decimal(next(o for o in options if o.get("type") == "number")) if kinds == {"number", "string"} and len(options) == 2 else _any([own(o) for o in options])
                return _or_null(node) if len(options) < len(schema[key]) else node
        if "allOf" in schema:
            nodes = [own(s) for s in schema["allOf"]]
            return Node(lambda v, at: F.concat(*[n.failures(v, at) for n in nodes]), nodes[0].dump, all(n.nullable for n in nodes))
        if "enum" in schema:
            return _codes(schema["enum"], "enum")
        if "const" in schema:
            return _codes([schema["const"]], "literal_error")
        kind = schema.get("type")
        if isinstance(kind, list):
            node = _any([own(schema | {"type": k}) for k in kind if k != "null"])
            return _or_null(node) if "null" in kind else node
        if kind == "object" or (kind is None and "properties" in schema):
            return ObjectNode(schema, own)
        if kind == "array":
            return _array(schema, own)
        if kind == "null":
            return Node(lambda v, at: _at(at, F.when(~F.is_variant_null(v), "none_required")), text_of, True)
        if schema.get("format") == "decimal" and kind in ("number", "string"):
            return _decimal(schema)
        scalars = {"string": _string, "integer": _integer, "number": _number, "boolean": _boolean}
        if kind is None:
            return own({})
        if kind not in scalars:
            raise SchemaError(f"unknown type {kind!r}")
        return scalars[kind](schema)

    return compiled(document)


def projected(document: dict, names: list[str]) -> dict:
    """{field: its schema} of some fields, each complete in itself: $refs replaced by what they refer to, codes and all."""

    def inlined(x, seen=()):
        if isinstance(x, list):
            return [inlined(y, seen) for y in x]
        if not isinstance(x, dict):
            return x
        if "$ref" in x:
            ref = x["$ref"]
            if ref in seen:
                raise SchemaError(f"{ref} refers to itself")
            target = document
            for step in ref.split("/")[1:]:
                target = target.get(step, {})
            return inlined(target, (*seen, ref))
        return {k: inlined(v, seen) for k, v in x.items()}

    own = document.get("properties", {})
    return {n: inlined(own[n]) for n in names if n in own}


def parsed(text: str) -> dict:
    found = json.loads(text)
    if not isinstance(found, dict):
        raise SchemaError("a schema is an object")
    return found
