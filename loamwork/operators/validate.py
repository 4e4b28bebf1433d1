"""Validation gates over wide records: schema, field fill, item count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.sources.jsonschema import staged
from loamwork.sources.schemas import Schema


def check_items(items: DataFrame, schema: Schema, extra: str | None = None) -> DataFrame:
    """items with `invalid`: some field isn't valid, or the flag column `extra` says that it has other keys."""
    ok = F.lit(True)
    for f in schema.fields:
        ok = ok & f.valid(F.col(f.name).cast("string"))
    if extra:
        ok = ok & ~F.coalesce(F.col(extra), F.lit(False))
    return items.withColumn("invalid", ~ok)


def fill_rates(items: DataFrame, schema: Schema, by: str = "page_id") -> DataFrame:
    """(by, field, fill_rate): share of a page's items that have the field, over all declared fields."""
    wide = items.groupBy(by).agg(*[F.avg(F.col(n).isNotNull().cast("int")).alias(n) for n in schema.names])
    return wide.unpivot([by], schema.names, "field", "fill_rate")


def validate(items: DataFrame, schema: Schema, by: str = "page_id", pages: DataFrame | None = None, baseline: DataFrame | None = None, min_fill: float = 0.8, min_count_ratio: float = 0.5, extra: str | None = None) -> DataFrame:
    """(by, ok, reason, item_count, n_invalid, fill_rates): one row per page.

    The first gate that fails gives the reason: empty, fill_rate:<first required field below the floor>,
    schema: <bad>/<all> items invalid, item_count: <n> < <ratio>*<baseline>. `pages` adds pages without
    items; baseline is (by, baseline). One aggregate over the items, pre-aggregated map-side.
    """
    checked = check_items(items, schema, extra)
    per = checked.groupBy(by).agg(F.count("*").alias("item_count"), F.count_if("invalid").alias("n_invalid"), *[F.avg(F.col(n).isNotNull().cast("int")).alias(f"_fill_{n}") for n in schema.names])
    if pages is not None:
        per = pages.select(by).distinct().join(per, by, "left").withColumn("item_count", F.coalesce("item_count", F.lit(0))).withColumn("n_invalid", F.coalesce("n_invalid", F.lit(0)))
    per = per.join(baseline, by, "left") if baseline is not None else per.withColumn("baseline", F.lit(None).cast("long"))
    reason = F.when(F.col("item_count") == 0, "empty")
    for n in schema.required:
        reason = reason.when(F.col(f"_fill_{n}") < min_fill, f"fill_rate:{n}")
    reason = reason.when(F.col("n_invalid") > 0, F.concat(F.lit("schema: "), F.col("n_invalid"), F.lit("/"), F.col("item_count"), F.lit(" items invalid")))
    reason = reason.when(F.col("item_count") < min_count_ratio * F.col("baseline"), F.concat(F.lit("item_count: "), F.col("item_count"), F.lit(f" < {min_count_ratio}*"), F.col("baseline"))).otherwise("")
    rates = F.map_from_arrays(F.array(*map(F.lit, schema.names)), F.array(*[F.col(f"_fill_{n}") for n in schema.names]))
    return per.select(by, (reason == "").alias("ok"), reason.alias("reason"), "item_count", "n_invalid", rates.alias("fill_rates"))


def item_failures(items: DataFrame, schema: Schema, item: str = "item") -> DataFrame:
    """items (variants, or JSON text) with `failures`: what is wrong with each, as "place: code", fields in the schema's order,
    then keys that it doesn't have. Text that is no JSON gives item: json_invalid."""
    text = items.schema[item].dataType.typeName() == "string"
    v = F.try_parse_json(item) if text else F.col(item)
    read = items.withColumn("_v", v)
    with staged([]) as stages:
        failures = schema.node.failures(F.col("_v"), F.lit(""))
    for name, value in stages:
        read = read.withColumn(name, value)
    return read.select(*items.columns, F.when(F.col("_v").isNull(), F.array(F.lit("item: json_invalid"))).otherwise(failures).alias("failures"))


def list_report(items: Column, schema: Schema, min_fill: float = 0.8) -> Column:
    """Of an array of variants, within its row: a struct of ok, reason (as validate's), item_count, n_invalid, failures (an
    array per item) and fill_rates."""
    has = lambda v, n: schema.node.get(v, n).isNotNull() & ~F.is_variant_null(schema.node.get(v, n))
    count = F.size(items)
    rate = lambda n: F.try_divide(F.size(F.filter(items, lambda v: has(v, n))), count)
    failures = F.transform(items, lambda v: schema.node.failures(v, F.lit("")))
    bad = F.size(F.filter(failures, lambda f: F.size(f) > 0))
    reason = F.when(count == 0, "empty")
    for n in schema.required:
        reason = reason.when(rate(n) < min_fill, f"fill_rate:{n}")
    reason = reason.when(bad > 0, F.concat(F.lit("schema: "), bad, F.lit("/"), count, F.lit(" items invalid"))).otherwise("")
    rates = F.map_from_arrays(F.array(*map(F.lit, schema.names)), F.array(*[rate(n) for n in schema.names]))
    return F.struct((reason == "").alias("ok"), reason.alias("reason"), count.alias("item_count"), bad.alias("n_invalid"), failures.alias("failures"), rates.alias("fill_rates"))
