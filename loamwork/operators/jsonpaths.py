"""JSON: path reads, leaves, and discovery of the paths where known values live."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.text import strip, to_float

SCALE = 10_000


_STEP = re.compile(r"\['((?:[^'\\]|\\['\\])*)'\]|\[(0|[1-9]\d*)\]", re.DOTALL)


def path_text(steps: list) -> str:
    """A path as text, $['key'][0]: in keys, quotes and backslashes have a backslash before them."""
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + re.sub(r"(['\\])", r"\\\1", s) + "']" for s in steps)


def path_steps(text: str) -> list:
    """The steps of which path_text made a text; ValueError for a text that it makes of none."""
    steps, at = [], 1
    while text[:1] == "$" and at < len(text) and (m := _STEP.match(text, at)):
        steps.append(int(m[2]) if m[2] else re.sub(r"\\(.)", r"\1", m[1], flags=re.DOTALL))
        at = m.end()
    if text[:1] != "$" or at < len(text):
        raise ValueError(f"not a path: {text!r}")
    return steps


def _spark_segment(step) -> str | None:
    """A step in Spark's own path language, which has no escapes: keys with both kinds of quotes have none."""
    if isinstance(step, int):
        return f"[{step}]"
    return f"['{step}']" if "'" not in step else f'["{step}"]' if '"' not in step else None


def read_path(value: Column, steps: list, kind: str = "variant") -> Column:
    """What a variant has at a path, null for any miss; negative places and flags as steps miss."""
    if any(isinstance(s, bool) or not isinstance(s, (int, str)) or (isinstance(s, int) and s < 0) for s in steps):
        return F.lit(None).cast(kind)
    at = "$"
    for k, s in enumerate(steps):
        segment = _spark_segment(s)
        if segment is None:
            return read_path(F.try_variant_get(value, at, "map<string,variant>")[s], steps[k + 1 :], kind)
        at += segment
    got = F.try_variant_get(value, at, kind)
    return F.when(F.is_variant_null(got), None).otherwise(got) if kind == "variant" else got


def _leaves(obj, path=()):
    if isinstance(obj, dict):
        for k, v in obj.items():
            yield from _leaves(v, (*path, k))
    elif isinstance(obj, list):
        for i, v in enumerate(obj):
            yield from _leaves(v, (*path, i))
    else:
        yield path, obj


def _rendered(v) -> tuple[str, str]:
    """Kind and text of a scalar, the text as Python prints it."""
    if v is None:
        return "null", "None"
    if isinstance(v, bool):
        return "bool", str(v)
    return ("num" if isinstance(v, (int, float)) else "str"), str(v)


@lru_cache(1 << 16)
def _written(path: tuple) -> tuple[str, int, list[str]]:
    """Text, depth and steps of a path; documents of a kind share their paths."""
    return path_text(list(path)), len(path), [str(s) for s in path]


def json_leaves(df: DataFrame, key: str, body: str = "json") -> DataFrame:
    """(key, path, depth, steps, kind, value): every scalar, nulls too; empty containers and bad JSON give none.

    Documents nest without bound, so this walks each in an Arrow batch; leaves are streamed out.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = df.schema[key].dataType
    schema = pa.schema([("k", to_arrow_type(key_type)), ("path", pa.string()), ("depth", pa.int32()), ("steps", pa.list_(pa.string())), ("kind", pa.string()), ("value", pa.string())])

    def batch(keys, rows):
        paths = [_written(p) for p, _ in rows]
        seen = [_rendered(v) for _, v in rows]
        columns = [keys, *([p[i] for p in paths] for i in range(3)), *([v[i] for v in seen] for i in range(2))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    def run(batches):
        for b in batches:
            keys, rows = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    obj = json.loads(text) if text else {}
                except (ValueError, RecursionError):
                    continue
                rows.extend(_leaves(obj))
                keys.extend([k] * (len(rows) - len(keys)))
                if len(rows) >= 20_000:
                    yield batch(keys, rows)
                    keys, rows = [], []
            yield batch(keys, rows)

    fields = [T.StructField("k", key_type), *[T.StructField(n, t) for n, t in (("path", T.StringType()), ("depth", T.IntegerType()), ("steps", T.ArrayType(T.StringType())), ("kind", T.StringType()), ("value", T.StringType()))]]
    return df.select(key, body).mapInArrow(run, T.StructType(fields)).withColumnRenamed("k", key)


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


#: Width of a bin of magnitudes; wider than the tolerance of close().
BIN = 1e-6


def _bin(amount: Column) -> Column:
    """The bin of an amount: linear up to 1, logarithmic beyond, so that amounts that are close() lie in one bin or in
    neighbouring ones, whatever their size."""
    size = F.abs(amount)
    return F.floor(F.signum(amount) * F.when(size <= 1, size).otherwise(1 + F.ln(size)) / BIN).cast("long")


def value_hits(leaves: DataFrame, known: DataFrame, sample: str, number: Column) -> DataFrame:
    """The rows of `leaves` that hold a value of `known` (sample, ..., want) of their sample, with known's columns and the
    scale: numbers as they are or times 10 000, within a relative 1e-9; others as stripped text, scale 1.

    A band join: a known amount lies in its bin and both neighbours, a leaf in its own, so that what meets is compared
    exactly once. Texts meet by equality, under keys of their own, so that the leaves are read once. Infinite amounts match nothing. Both sides are as many rows as the documents hold
    values, which the estimate of an exploded table doesn't show: they meet sorted, and neither is sent to the driver.
    """
    amount = to_float(F.col("want"))
    key = lambda scale, bin_: F.struct(F.lit(scale).alias("scale"), F.concat(F.lit("n"), bin_.cast("string")).alias("_key"))
    near = F.when(_finite(F.col("_amount")), F.array(*[key(s, _bin(F.col("_amount") / s) + d) for s in (1, SCALE) for d in (-1, 0, 1)]))
    text = F.when(F.col("want").isNotNull(), F.array(F.struct(F.lit(1).alias("scale"), F.concat(F.lit("t"), strip(F.col("want"))).alias("_key"))))
    asked = known.withColumn("_amount", F.when(number, amount)).withColumn("_number", number)
    asked = asked.select("*", F.inline(F.when(F.col("_number"), near).otherwise(text)))
    leaf = F.when(F.col("kind").isin("num", "str"), to_float(F.col("value")))
    held = leaves.withColumn("_leaf", leaf)
    held = held.withColumn("_key", F.explode(F.array_compact(F.array(F.when(_finite(F.col("_leaf")), F.concat(F.lit("n"), _bin(F.col("_leaf")).cast("string"))), F.concat(F.lit("t"), strip(F.col("value")))))))
    both = held.join(asked.hint("merge"), [sample, "_key"])
    return both.where(~F.col("_number") | close(F.col("_leaf") * F.col("scale"), F.col("_amount"))).drop("_key", "_leaf", "_amount", "_number")


def _finite(amount: Column) -> Column:
    return amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf"))


def discover(leaves: DataFrame, oracle: DataFrame, sample: str, numeric: list[str], skip: list[str] = (), by: list[str] = ()) -> DataFrame:
    """(by, field, path, scale): for each field, the smallest path whose leaf matches the known value in every sample.

    leaves as json_leaves gives them; oracle is (by, sample, field, value text), null values too: with `by` (a family, say),
    each group is discovered on its own samples. Numbers match as they are or times 10 000 (scale null for others, which
    match as text without outer white space). A field null or missing in some sample has no path.
    """
    by = list(by)
    known = oracle.where(~F.col("field").isin(list(skip)) if skip else F.lit(True))
    whole = known.groupBy(*by, "field").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col(sample))).alias("_n"))
    if by:
        whole = whole.join(oracle.groupBy(*by).agg(F.count_distinct(sample).alias("_all")).hint("merge"), by)
    else:
        whole = whole.withColumn("_all", F.lit(oracle.agg(F.count_distinct(sample)).first()[0]))
    whole = whole.where("_n = _all").select(*by, "field", F.col("_n").alias("_whole"))
    number = F.col("field").isin(list(numeric)) if numeric else F.lit(False)
    hits = value_hits(leaves.select(sample, "path", "depth", "steps", "kind", "value"), known.select(*by, sample, "field", F.col("value").alias("want")), sample, number)
    # paths are counted first and meet the samples' number then: the known values themselves meet the leaves alone
    held = hits.groupBy(*by, "field", "path", "depth", "steps", "scale").agg(F.count_distinct(sample).alias("_n")).join(whole.hint("merge"), [*by, "field"]).where("_n = _whole")
    first = held.groupBy(*by, "field").agg(F.min(F.struct("depth", "steps", "scale", "path")).alias("_f"))
    return first.select(*by, "field", F.col("_f.path").alias("path"), F.when(number, F.col("_f.scale")).alias("scale"))
