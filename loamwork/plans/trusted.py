"""Trusted records from an injected completer: whole pages, and the residual fields of pages already extracted."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.functions.text import is_blank, strip_fences, trim_html
from loamwork.operators.validate import list_report
from loamwork.sources.jsonschema import kind_of
from loamwork.sources.schemas import Schema
from loamwork.sources.shared import kept

#: Characters of a page that a completer is shown: of its JSON islands, of its HTML.
JSON_CHARS, HTML_CHARS = 120_000, 200_000


def parse_items(raw: str) -> list[dict]:
    """The objects of a JSON array, a code fence dropped; ValueError for anything else."""
    found = _json(raw)
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise ValueError("expected a JSON array of objects")
    return found


def parse_object(raw: str) -> dict:
    """A JSON object, a code fence dropped; ValueError for anything else."""
    found = _json(raw)
    if not isinstance(found, dict):
        raise ValueError("expected a JSON object")
    return found


def _json(raw: str):
    text = raw.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        return json.loads(text)
    except ValueError as e:
        raise ValueError(f"not JSON: {e}") from e


def _asking(complete: Callable, extra: str):
    """Rows of (page_id, page_text, extra) with what complete(page text, extra) answers, or how it failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, failed = [], []
            for text, more in zip(b["page_text"], b[extra]):
                try:
                    raw.append(complete(text or "", more if extra == "error" else list(more)))
                    failed.append(None)
                except Exception as e:  # the callable's own failures are the page's result
                    raw.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
            yield b.assign(raw=raw, failed=failed)

    return run


def _answered(asked: DataFrame) -> T.StructType:
    return T.StructType([*asked.schema.fields, T.StructField("raw", T.StringType()), T.StructField("failed", T.StringType())])


def direct_extract(pages: DataFrame, complete: Callable[[str, str | None], str], schema: Schema, repairs: int = 1, most: int = HTML_CHARS, islands: int = JSON_CHARS) -> DataFrame:
    """(page_id, item_ix, fields as text, error): records of stored pages by `complete(page text, last error)`.

    Pages are trimmed in the engine, JSON islands and the rest with limits of their own, and go to the callable in Arrow
    batches, on the executors. Answers are written down, so that each is asked for once, and judged in the engine: an answer
    that is no JSON array of objects, or that the gates of list_report refuse, is asked for again with the reason, `repairs`
    times. Values are what the schema reads them as. A page that still has no valid answer, or whose callable raises each
    time, gives one row with null item_ix and the error. The callable must be serialisable."""
    names, out = schema.names, None
    asked = pages.select("page_id", trim_html(F.col("html"), most, islands).alias("page_text"), F.lit(None).cast("string").alias("error"))
    for attempt in range(1 + repairs):
        answers = kept(asked.mapInPandas(_asking(complete, "error"), _answered(asked)), "answers")
        v = F.try_parse_json(strip_fences(F.col("raw")))
        items = F.try_variant_get(v, "$", "array<variant>")
        shape = F.coalesce(F.col("failed"), F.when(v.isNull(), "ValueError: not JSON").when(items.isNull() | (kind_of(v) != "ARRAY") | F.exists(items, lambda x: kind_of(x) != "OBJECT"), "ValueError: expected a JSON array of objects"))
        judged = answers.withColumn("shape", shape).withColumn("items", F.when(F.col("shape").isNull(), items)).withColumn("report", F.when(F.col("shape").isNull(), list_report(F.col("items"), schema)))
        judged = judged.withColumn("why", F.coalesce("shape", F.nullif("report.reason", F.lit(""))))
        good = judged.where("why is null").select("page_id", F.posexplode("items").alias("item_ix", "item"))
        good = good.select("page_id", "item_ix", *[schema.node.fields[n].value(schema.node.get(F.col("item"), n)).alias(n) for n in names], F.lit(None).cast("string").alias("error"))
        out = good if out is None else out.unionByName(good)
        asked = judged.where("why is not null").select("page_id", "page_text", F.col("why").alias("error"))
    lost = asked.select("page_id", F.lit(None).cast("int").alias("item_ix"), *[F.lit(None).cast("string").alias(n) for n in names], "error")
    return out.unionByName(lost)


def fill_residual(pages: DataFrame, complete: Callable[[str, list[str]], str], residual: list[str], schema: Schema, most: int = HTML_CHARS, islands: int = JSON_CHARS) -> DataFrame:
    """(page_id, residual fields as text): what `complete(page text, fields)` says of them, one call a page.

    Each value is judged by its own field's schema and is what that reads it as: a text that is a number becomes the number,
    a code stays a code. Never fails: an answer that is no JSON object, or a callable that raises, gives nulls; so do
    blank values, values of a wrong type and fields that weren't asked for. With no residual fields nothing is called."""
    fields = [n for n in residual if n in schema.names]
    if not fields:
        return pages.select("page_id").where("false")
    asked = pages.select("page_id", trim_html(F.col("html"), most, islands).alias("page_text"), F.array(*map(F.lit, fields)).alias("fields"))
    answers = asked.mapInPandas(_asking(complete, "fields"), _answered(asked))
    parsed = answers.withColumn("v", F.try_parse_json(strip_fences(F.col("raw")))).withColumn("v", F.when(kind_of(F.col("v")) == "OBJECT", F.col("v")))
    values = [schema.node.fields[n].value(schema.node.get(F.col("v"), n)) for n in fields]
    return parsed.select("page_id", *[F.when(~is_blank(x), x).alias(n) for n, x in zip(fields, values)])
