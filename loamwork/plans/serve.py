"""Serving a batch of requests: route, walk the ladder, classify failures, fall back, merge residual fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.text import derive_family, derive_pattern, is_blank
from loamwork.operators.failure import action, classify
from loamwork.operators.fieldmap import compile_field
from loamwork.operators.residual import merge_records
from loamwork.operators.route import route
from loamwork.sources.schemas import Schema


def decide(requests: DataFrame) -> DataFrame:
    """requests with failure, source, action.

    requests: url, family (null: unknown), listed, kind, status, marker, used_version (null: every rung
    failed or none was tried), oracle_ok (null: no trusted records). A known family is served by its
    crawler; drift and unknown families by trusted records if there are valid ones, and are queued for
    regeneration or registered; blocked, gone and transient ones are not served.
    """
    valid = F.when(F.col("kind") == "ok", F.when(F.col("family").isNotNull(), F.col("used_version").isNotNull()))
    failure = classify(F.col("kind"), F.col("status"), F.col("marker"), F.col("listed"), valid)
    new = F.col("family").isNull() & (F.col("kind") == "ok") & F.col("listed")
    trusted = F.coalesce(F.col("oracle_ok"), F.lit(False))
    source = F.when(failure.isNull() & ~new, "crawler").when((new | (failure == "drift")) & trusted, "oracle").otherwise("none")
    return requests.withColumn("failure", failure).withColumn("source", source).withColumn("action", F.when(new, F.when(trusted, "bootstrap").otherwise("report")).otherwise(action(F.col("failure"))))


def bootstrap(requests: DataFrame) -> DataFrame:
    """(family, url_patterns): registrations for served URLs that no family matched."""
    return requests.where("action = 'bootstrap'").select(derive_family(F.col("url")).alias("family"), derive_pattern(F.col("url")).alias("p")).groupBy("family").agg(F.sort_array(F.collect_set("p")).alias("url_patterns"))


def serve(pages: DataFrame, families: list[tuple[str, list[str]]], extract: Callable[[DataFrame], DataFrame], tails: DataFrame | None = None, fields: list[str] = ()) -> DataFrame:
    """Records of stored pages: routed, extracted by `extract`, residual fields filled from `tails` by page."""
    records = extract(route(pages, families).where("family is not null"))
    return merge_records(records, tails, "page_id", list(fields)) if tails is not None else records


def serve_requests(pages: DataFrame, families: list[tuple[str, list[str]]], ladders: dict[str, list[tuple[int, dict]]], schema: Schema, trusted: DataFrame | None = None, tails: DataFrame | None = None, residual: list[str] = ()) -> DataFrame:
    """Requests for stored pages, end to end: page_id, url, family, used_version, record (a struct of the schema's fields
    as text), failure, source, action.

    pages: page_id, url, json (the page's record island), kind, status, marker, listed. A page is routed, its
    family's ladder (versions in order, each a field map) is walked to the first rung whose record is valid, all in the
    scan's stage: the registry's ladders are few and on the driver, and the page's JSON is parsed once. Pages that
    no rung served take the record of `trusted` (page_id, fields), if that has a valid one; served ones have their blank
    residual fields filled from `tails` (page_id, fields). What is done next is decide()'s.
    """
    names = schema.names
    text = lambda df, n: (F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string")).alias(n)
    kind = "struct<" + ",".join(f"`{n}`:string" for n in names) + ">"
    none = F.lit(None).cast(f"struct<n:int,fields:{kind}>")

    def valid(record) -> Column:
        ok = record.isNotNull()
        for f in schema.fields:
            ok = ok & f.valid(record[f.name])
        return ok

    found, tried = route(pages, families).withColumn("_v", F.try_parse_json("json")), [none]
    for rung in range(max((len(x) for x in ladders.values()), default=0)):
        record = none
        for family, ladder in sorted(ladders.items()):
            if rung < len(ladder):
                n, spec = ladder[rung]
                own = [(compile_field(F.col("_v"), spec[f]).cast("string") if f in spec else F.lit(None).cast("string")).alias(f) for f in names]
                record = F.when(F.col("family") == family, F.struct(F.lit(n).alias("n"), F.struct(*own).alias("fields"))).otherwise(record)
        found = found.withColumn(f"_r{rung}", record)
        tried.append(F.when((F.col("kind") == "ok") & F.col("_v").isNotNull() & valid(F.col(f"_r{rung}.fields")), F.col(f"_r{rung}")))
    served = found.withColumn("_r", F.coalesce(*tried)).select("page_id", "url", "family", "kind", "status", "marker", "listed", F.col("_r.n").alias("used_version"), F.col("_r.fields").alias("_own"))
    for rows, name in ((trusted, "_trusted"), (tails, "_tail")):
        if rows is None:
            served = served.withColumn(name, F.lit(None).cast(kind))
        else:
            served = served.join(rows.select("page_id", F.struct(*[text(rows, n) for n in names]).alias(name)), "page_id", "left")
    done = decide(served.withColumn("oracle_ok", valid(F.col("_trusted"))))
    filled = F.struct(*[(F.when(is_blank(F.col("_own")[n]), F.coalesce(F.col("_tail")[n], F.col("_own")[n])).otherwise(F.col("_own")[n]) if n in residual else F.col("_own")[n]).alias(n) for n in names])
    record = F.when(F.col("source") == "crawler", filled).when(F.col("source") == "oracle", F.col("_trusted"))
    return done.select("page_id", "url", "family", "used_version", record.alias("record"), "failure", "source", "action")
