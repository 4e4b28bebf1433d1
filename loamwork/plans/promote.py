"""Promotion and escalation of a family, and field maps made from discovered paths."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators import registry
from loamwork.operators.fieldmap import REPRODUCTION_BAR, reproduction_ratio
from loamwork.operators.jsonpaths import SCALE, discover, json_leaves, path_steps
from loamwork.operators.numbering import dense_ids
from loamwork.sources.schemas import Schema
from loamwork.sources.store import Change, Snapshot, Store


@dataclass(frozen=True)
class Promotion:
    """The registry's tables after a promotion, and the rows to append to the audit."""

    n: int
    versions: DataFrame
    audit: DataFrame


def promote(spark: SparkSession, versions: DataFrame, family: str, fieldmap: dict, schema_ref: str, after: int = 0, scores: dict | None = None, warnings: list[str] = (), residual: list[str] = (), now: str | None = None) -> Promotion:
    """Registers the field map as the family's next version, makes it the active one, and audits that."""
    source = spark.createDataFrame([(family, json.dumps(fieldmap, sort_keys=True), 0)], "family string, spec string, ord int")
    added = registry.add_versions(versions, source, now)
    n = added.where(F.col("family") == family).agg(F.max("n")).first()[0]
    active = registry.set_active(added, spark.createDataFrame([(family, n)], "family string, n int"))
    data = [(family, "promote", n, schema_ref, json.dumps(scores), list(warnings), list(residual))]
    events = spark.createDataFrame(data, "family string, event string, to_version int, schema_ref string, scores string, history_warnings array<string>, residual_fields array<string>")
    return Promotion(n, active, registry.audit_rows(events.select("family", "event", F.struct("to_version", "schema_ref", "scores", "history_warnings", "residual_fields").alias("data")), after, now))


def promote_in(store: Store, family: str, fieldmap: dict, schema_ref: str, fixtures: DataFrame | None = None, scores: dict | None = None, warnings: list[str] = (), residual: list[str] = (), now: str | None = None, base: Snapshot | None = None) -> Snapshot:
    """A promotion as one commit: the family (made if it isn't there), its next version, that being active, its fixtures
    (page_id, json, expected; the earlier ones go) and the audit row are there together or not at all.

    Promotions of other families at the same time don't hinder it. With `base`, the snapshot that the decision was made on,
    another change of this family since then raises Conflict."""
    spark = store.spark

    def make(now_there: Snapshot) -> Change:
        known = now_there.table("families")
        if known.where(F.col("family") == family).isEmpty():
            new = spark.createDataFrame([(family, schema_ref)], "family string, schema_ref string").select("family", F.array().cast("array<string>").alias("url_patterns"), "schema_ref", F.lit("healthy").alias("status"), registry.now_iso(now).alias("created_at"))
            known = known.unionByName(new)
        last = now_there.table("audit").agg(F.max("id")).first()[0] or 0
        done = promote(spark, now_there.table("versions"), family, fieldmap, schema_ref, last, scores, warnings, residual, now)
        replace = {"families": known, "versions": done.versions}
        if fixtures is not None:
            numbered = dense_ids(fixtures.select("page_id", "json", "expected"), [F.col("page_id")], "sample", -1).select(F.lit(family).alias("family"), "sample", "page_id", "json", "expected")
            replace["fixtures"] = now_there.table("fixtures").where(F.col("family") != family).unionByName(numbered.withColumn("sample", F.col("sample").cast("int")))
        return Change(replace, {"audit": done.audit}, frozenset({family}))

    return store.update(make, base=base)


def escalate(spark: SparkSession, families: DataFrame, family: str, schema_ref: str, reason: str, after: int = 0, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(families, audit rows) after regeneration of a family was given up: its status is escalated; a family that
    has no row yet gets one."""
    if families.where(F.col("family") == family).isEmpty():
        new = spark.createDataFrame([(family, schema_ref)], "family string, schema_ref string").select("family", F.lit(None).cast(families.schema["url_patterns"].dataType).alias("url_patterns"), "schema_ref", registry.now_iso(now).alias("created_at"))
        families = registry.upsert_families(families, new)
    events = spark.createDataFrame([(family, "escalated", reason)], "family string, event string, reason string").select("family", "event", F.struct("reason").alias("data"))
    return registry.set_status(families, family, "escalated"), registry.audit_rows(events, after, now)


def stronger_model(model: str, ladder: dict[str, str]) -> str | None:
    """The model to try once after `model` failed, or None at the top; which follows which is the caller's."""
    return ladder.get(model)


def field_map_of(found: DataFrame) -> dict:
    """A field map from discover()'s rows: at most one for each field of a schema."""
    return {r["field"]: {"path": path_steps(r["path"]), "transform": "x10000" if r["scale"] == SCALE else "none"} for r in found.orderBy("field").collect()}


def value_path_candidate(samples: DataFrame, oracle: DataFrame, schema: Schema) -> dict | None:
    """The field map of paths at which the known values lie in every sample; None if a sample has no JSON or
    nothing is found.

    samples: (page_id, json); oracle: (page_id, fields as text). Volatile fields are numbers, enums are left out."""
    if not samples.where(F.try_parse_json("json").isNull()).isEmpty():
        return None
    names = [n for n in schema.names if n in oracle.columns]
    known = oracle.select("page_id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names])))
    found = field_map_of(discover(json_leaves(samples, "page_id"), known, "page_id", sorted(schema.volatile), schema.enums))
    return found or None


def path_map_candidate(samples: DataFrame, oracle: DataFrame, proposed: dict, bar: float = REPRODUCTION_BAR) -> dict | None:
    """The proposed field map if it reproduces the known values: its mean ratio over the samples is at the bar or above."""
    ratio = reproduction_ratio(samples, proposed, oracle, "page_id").agg(F.avg("ratio")).first()[0]
    return proposed if ratio is not None and ratio >= bar else None
