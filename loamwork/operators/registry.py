"""The registry's tables as DataFrames: ladders, transitions, upserts, audit and history reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.operators.numbering import dense_ids
from loamwork.operators.safety import ast_violations


def version_ladder(versions: DataFrame) -> DataFrame:
    """versions with `rung`: the active one first, then by falling number; archived ones too."""
    order = [F.desc((F.col("status") == "active").cast("int")), F.desc("n")]
    return versions.withColumn("rung", F.row_number().over(Window.partitionBy("family").orderBy(*order)))


def ladder_walk(ladder: DataFrame) -> DataFrame:
    """(family, used_version, attempts): the first rung whose outcome is ok; outcomes are ok, invalid, error.

    An error ends the walk there: no version, attempts up to it. Without either, every rung was tried.
    """
    stop = F.min(F.when(F.col("outcome") != "invalid", F.col("rung")))
    return ladder.groupBy("family").agg(
        F.min_by(F.when(F.col("outcome") == "ok", F.col("n")), F.when(F.col("outcome") != "invalid", F.col("rung"))).alias("used_version"),
        F.coalesce(stop, F.max("rung")).cast("int").alias("attempts"))


def run_counters(ladder: DataFrame, walked: DataFrame) -> DataFrame:
    """(family, n, runs, successes): counters of the versions that a walk tried."""
    return ladder.join(walked, "family").where("rung <= attempts").groupBy("family", "n").agg(F.count("*").alias("runs"), F.count_if(F.col("outcome") == "ok").alias("successes"))


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("family").agg((F.coalesce(F.max("n"), F.lit(0)) + 1).cast("int").alias("next_n"))


def _require(wanted: DataFrame, there: DataFrame, keys: list[str], what: str) -> None:
    """Raises LookupError naming up to ten of `wanted` that are not there; wanted is small: what one call changes."""
    missing = wanted.select(*keys).join(there.select(*keys), keys, "left_anti").limit(10).collect()
    if missing:
        raise LookupError(f"no {what} {[tuple(r) for r in missing]}")


def set_active(versions: DataFrame, target: DataFrame, strict: bool = True) -> DataFrame:
    """versions after target (family, n) became active; the one that was becomes fallback, others stay.

    A target that is no version raises LookupError, and nothing changes."""
    if strict:
        _require(target, versions, ["family", "n"], "version")
    aim = target.select("family", F.col("n").alias("_n"))
    status = F.when(F.col("_n").isNull(), F.col("status")).when(F.col("n") == F.col("_n"), "active").when(F.col("status") == "active", "fallback").otherwise(F.col("status"))
    return versions.join(aim, "family", "left").withColumn("status", status).drop("_n")


def rollback(versions: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """versions after each family's newest fallback became active and the active one archived.

    Without `families` (family), families that have no fallback stay as they are; those named must have
    one, else LookupError, and others stay."""
    if families is not None:
        _require(families, versions.where("status = 'fallback'"), ["family"], "fallback to roll back to for")
        named = families.select("family").distinct()
        return rollback(versions.join(named, "family", "left_semi")).unionByName(versions.join(named, "family", "left_anti"))
    best = F.max(F.when(F.col("status") == "fallback", F.col("n"))).over(Window.partitionBy("family"))
    status = F.when(F.col("_best").isNull(), F.col("status")).when(F.col("n") == F.col("_best"), "active").when(F.col("status") == "active", "archived").otherwise(F.col("status"))
    return versions.withColumn("_best", best).withColumn("status", status).drop("_best")


def add_versions(versions: DataFrame, sources: DataFrame, now: Column | str | None = None) -> DataFrame:
    """versions with one row more for each of sources (family, spec, ord): the next numbers of its family in order of
    ord, status fallback, no runs, and the hash of what was registered.

    Sources that the gate refuses raise ValueError before anything is added: specs are JSON field maps, or
    source text without violations."""
    bad = sources.where(F.try_parse_json("spec").isNull() & (F.size(ast_violations(F.col("spec"))) > 0)).select("family").limit(10).collect()
    if bad:
        raise ValueError(f"refused by the gate: {[r['family'] for r in bad]}")
    number = F.row_number().over(Window.partitionBy("family").orderBy("ord"))
    new = sources.join(next_version(versions), "family", "left").select(
        "family", (F.coalesce("next_n", F.lit(1)) - 1 + number).cast("int").alias("n"), F.lit("fallback").alias("status"), "spec",
        F.sha2("spec", 256).alias("source_sha"), now_iso(now).alias("promoted_at"), F.lit(0).cast("long").alias("runs"), F.lit(0).cast("long").alias("successes"))
    return versions.unionByName(new, allowMissingColumns=True)


class IntegrityError(ValueError):
    """A registered spec is not what was registered."""


def active_specs(versions: DataFrame) -> DataFrame:
    """(family, n, spec) of the active versions; one whose spec no longer has its hash raises IntegrityError."""
    active = versions.where("status = 'active'")
    changed = active.where(~verify_source(active)).select("family", "n").limit(10).collect()
    if changed:
        raise IntegrityError(f"changed since registration: {[tuple(r) for r in changed]}")
    return active.select("family", "n", "spec")


def record_runs(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """versions with runs (family, n, ok) counted in: each adds a run, and a success where ok. An unknown version
    raises LookupError."""
    added = runs.groupBy("family", "n").agg(F.count("*").alias("_r"), F.count_if("ok").alias("_s"))
    _require(added, versions, ["family", "n"], "version")
    return versions.join(added, ["family", "n"], "left").withColumns({"runs": F.col("runs") + F.coalesce("_r", F.lit(0)), "successes": F.col("successes") + F.coalesce("_s", F.lit(0))}).select(*versions.columns)


def now_iso(now: Column | str | None = None) -> Column:
    """A pinned time, or the query's own, in UTC."""
    if now is not None:
        return now if isinstance(now, Column) else F.lit(now)
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def audit_rows(events: DataFrame, after: int = 0, now: Column | str | None = None) -> DataFrame:
    """(id, ts, family, event, data) to append to an audit log whose largest id is `after`; events have family, event
    and data (a struct or map, written as JSON). Ids are after + 1, after + 2, ... in order of `ord`, where events have it (a
    number), then of family, event and data; rows that are equal in all of these follow each other."""
    rows = events.select(*(["ord"] if "ord" in events.columns else []), "family", "event", F.to_json("data").alias("data"))
    return dense_ids(rows, [F.col(c) for c in rows.columns] + [F.rand(5)], "id", after).select("id", now_iso(now).alias("ts"), "family", "event", "data")


def history_rows(records: DataFrame, fields: list[str], after: int = 0, now: Column | str | None = None) -> DataFrame:
    """(id, family, url, version, extracted_json, ts) to append to the run history: one row for each served page, its
    records (item_ix, fields) as a JSON array in order. Ids are after + 1, after + 2, ... in order of family, url, version."""
    pages = records.groupBy("family", "url", "version").agg(F.sort_array(F.collect_list(F.struct("item_ix", *fields))).alias("items"))
    items = F.to_json(F.transform("items", lambda x: F.struct(*[x[f].alias(f) for f in fields])), {"ignoreNullFields": "false"})
    pages = dense_ids(pages.select("family", "url", "version", items.alias("extracted_json")), [F.col("family"), F.col("url"), F.col("version")], "id", after)
    return pages.select("id", "family", "url", "version", "extracted_json", now_iso(now).alias("ts"))


def read_audit(audit: DataFrame, family: str | None = None) -> DataFrame:
    """Audit rows, newest first, of one family or all."""
    return (audit if family is None else audit.where(F.col("family") == family)).orderBy(F.desc("id"))


def all_families(families: DataFrame) -> DataFrame:
    """Families in order of name, patterns as a list."""
    kind = families.schema["url_patterns"].dataType.typeName()
    return (families if kind == "array" else families.withColumn("url_patterns", F.coalesce(F.from_json("url_patterns", "array<string>"), F.array().cast("array<string>")))).orderBy("family")


def access_rows(log: DataFrame) -> DataFrame:
    """(domain, working_strategy, status, updated_at) in order of domain: the newest of each that isn't null."""
    return latest_values(log, "domain", ["working_strategy", "status", "updated_at"]).orderBy("domain")


def lookup(rows: DataFrame, **key) -> dict | None:
    """The one row with these values as a dict, or None; filters reach the scan."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == F.lit(value))
    found = rows.limit(1).collect()
    return found[0].asDict(recursive=True) if found else None


def rollback_target(versions: DataFrame) -> DataFrame:
    return versions.where("status = 'fallback'").groupBy("family").agg(F.max("n").alias("target_n"))


def upsert_families(base: DataFrame, updates: DataFrame) -> DataFrame:
    """base with updates: patterns and schema are replaced, status and created_at kept; new ones are healthy."""
    u = updates.select("family", F.col("url_patterns").alias("_p"), F.col("schema_ref").alias("_s"), F.col("created_at").alias("_c"))
    return base.join(u, "family", "full_outer").select(
        "family", F.coalesce("_p", "url_patterns").alias("url_patterns"), F.coalesce("_s", "schema_ref").alias("schema_ref"),
        F.coalesce("status", F.lit("healthy")).alias("status"), F.coalesce("created_at", "_c").alias("created_at"))


def set_status(base: DataFrame, family: str, status: str) -> DataFrame:
    if base.where(F.col("family") == family).isEmpty():
        raise LookupError(family)
    return base.withColumn("status", F.when(F.col("family") == family, status).otherwise(F.col("status")))


def latest_values(log: DataFrame, key: str, columns: list[str], order: str = "id") -> DataFrame:
    """(key, columns): for each column the newest value that isn't null."""
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def recent(log: DataFrame, by: list[str], most: int = 20, order: str = "id") -> DataFrame:
    """The newest `most` rows of each key; Spark keeps a bounded heap per group while it sorts."""
    return log.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("rank") <= most)


def active_residual(versions: DataFrame, audit: DataFrame) -> DataFrame:
    """(family, n, residual): the residual fields that the newest promotion of the active version recorded."""
    active = versions.where("status = 'active'").select("family", "n")
    newest = audit.where("event = 'promote'").groupBy("family", F.col("to_version").alias("n")).agg(F.max_by("residual", "id").alias("residual"))
    return active.join(newest, ["family", "n"], "left")


def verify_source(versions: DataFrame, spec: str = "spec", sha: str = "source_sha") -> Column:
    """Whether a version's spec is what was registered."""
    return F.sha2(spec, 256).eqNullSafe(F.col(sha)) & F.col(spec).isNotNull()


def snapshot_due(versions: DataFrame, every: int = 20) -> DataFrame:
    """(family, due): whether the total of successes is a multiple of `every`."""
    return versions.groupBy("family").agg((F.sum("successes") % every == 0).alias("due"))
