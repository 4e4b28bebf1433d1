"""Regeneration of many families at once: a state machine whose rounds are Spark jobs and whose state is rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.operators import registry
from loamwork.operators.agree import AGREEMENT_BAR, agreement_detail, aligned_pairs, failure_report, history_jumps, latest_history, score_candidates, score_summary
from loamwork.operators.fieldmap import REPRODUCTION_BAR, apply_specs
from loamwork.operators.jsonpaths import SCALE, discover, json_leaves, path_steps
from loamwork.operators.numbering import numbered
from loamwork.operators.residual import residual_fields
from loamwork.operators.validate import check_items
from loamwork.functions.compare import values_agree
from loamwork.plans.promote import stronger_model
from loamwork.sources.schemas import Schema
from loamwork.sources.shared import kept
from loamwork.sources.store import TABLES, Change, Snapshot, Store

MAX_ROUNDS, PER_ROUND, MIN_ORACLES = 3, 2, 3
#: Families that a commit names; with more of them it claims all.
NAMED = 1_000


def _text(df: DataFrame, name: str) -> Column:
    return (F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")).alias(name)


def _large(df: DataFrame) -> DataFrame:
    """df, a row or more a page, for a join with another such table. Columns of few values and computed ones make it look small
    enough for a broadcast, which would take it through the driver: they meet sorted. Tables by family are left to Spark."""
    return df.hint("merge")


def discovered_maps(samples: DataFrame, known: DataFrame, schema: Schema) -> DataFrame:
    """(family, spec): for each family the field map of the paths at which the known values lie in all its samples.

    samples: (family, page_id, json); known: (family, page_id, item_ix, fields as text), of which a page's first record counts.
    Volatile fields are numbers, enums are left out. Families with a sample that is no JSON, or with nothing found, have no row."""
    broken = samples.where(F.try_parse_json("json").isNull()).select("family").distinct()
    first = known.where("item_ix = 0").join(broken, "family", "left_anti")
    long = first.select("family", "page_id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in schema.names])))
    found = discover(json_leaves(samples.select("page_id", "json"), "page_id"), long, "page_id", sorted(schema.volatile), schema.enums, ["family"])

    @F.pandas_udf("string")
    def steps(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: json.dumps(path_steps(p)))

    # keys are field names of the schema, which need no escapes
    one = F.concat(F.lit('"'), F.col("field"), F.lit('": {"path": '), steps("path"), F.lit(', "transform": "'), F.when(F.col("scale") == SCALE, "x10000").otherwise("none"), F.lit('"}'))
    return found.withColumn("one", one).groupBy("family").agg(F.array_sort(F.collect_list("one")).alias("all")).select("family", F.concat(F.lit("{"), F.array_join("all", ", "), F.lit("}")).alias("spec"))


def reproducing(maps: DataFrame, samples: DataFrame, known: DataFrame, schema: Schema, bar: float = REPRODUCTION_BAR) -> DataFrame:
    """maps (family, spec) that give enough of the known values of their family's first sample: a share of `bar` of those
    that are filled."""
    first = samples.groupBy("family").agg(F.min_by(F.struct("page_id", "json"), "page_id").alias("f")).select("family", "f.*")
    got = apply_specs(first.join(maps.select("family", "spec"), "family"), schema.names)
    want = known.where("item_ix = 0").select("family", "page_id", F.struct(*schema.names).alias("want"))
    both = got.join(_large(want), ["family", "page_id"])
    filled = sum((F.col("want")[n].isNotNull().cast("int") for n in schema.names), F.lit(0))
    hit = sum((F.coalesce(values_agree(F.col(n), F.col("want")[n]), F.lit(False)).cast("int") for n in schema.names), F.lit(0))
    return both.where((filled == 0) | (hit >= bar * filled)).select("family", "spec")


def specs_by(complete: Callable[[str, int, str, str], list[dict]], most: int = PER_ROUND) -> Callable[[DataFrame], DataFrame]:
    """A generator of field maps from a callable that runs on the executors, once per open family and round:
    complete(family, round, model, report of the last failures). One that raises proposes nothing."""

    def generate(open_: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                out = []
                for f, n, model, report in zip(b["family"], b["round"], b["model"], b["report"]):
                    try:
                        maps = complete(f, int(n), model, report or "")
                    except Exception:  # a failed proposal is no proposal
                        maps = []
                    out += [(f, i, json.dumps(m)) for i, m in enumerate(maps[:most])]
                yield pd.DataFrame(out, columns=["family", "ord", "spec"])

        return open_.select("family", "round", "model", "report").mapInPandas(run, "family string, ord int, spec string")

    return generate


@dataclass(frozen=True)
class Regeneration:
    """The loop over all families of a schema.

    samples: (family, page_id, url, json). oracle(model): (family, page_id, item_ix, fields as text), the trusted records that a
    model gives; pages without any are unusable. generate(open): of open families (family, round, model, report) the
    proposals (family, ord, spec). propose(first): of families in their first round (family, page_id, json, known) one field map each
    (family, spec), which counts if it reproduces enough. stronger: which model to try after which.

    A round scores every open family's candidates on its samples and fixtures: in the first, what discovery finds comes
    first, then the proposed map, then the generated ones. The best that passes is promoted: next version, active, fixtures and audit
    (scores, warnings against history, residual fields). Families without one go on with a report of the failures; after max_rounds, or with
    fewer than min_oracles usable samples, they escalate, and begin anew with a stronger model if there is one. Families without samples
    escalate at once. Each round is one commit of state, candidates, versions, families, fixtures and audit, so a loop that
    is stopped goes on where it was, and proposals of a finished round are not asked for again.
    """

    store: Store
    schema: Schema
    samples: DataFrame
    oracle: Callable[[str], DataFrame]
    generate: Callable[[DataFrame], DataFrame]
    propose: Callable[[DataFrame], DataFrame] | None = None
    stronger: dict[str, str] = field(default_factory=dict)
    max_rounds: int = MAX_ROUNDS
    per_round: int = PER_ROUND
    min_oracles: int = MIN_ORACLES
    bar: float = AGREEMENT_BAR
    now: str | None = None

    def begin(self, families: DataFrame, model: str) -> Snapshot:
        """Opens families (family): those that are open go on as they are, others start at round 1."""
        names = families.select("family").distinct()

        def make(s: Snapshot) -> Change:
            state = s.table("loop_state")
            new = names.join(state.where("phase = 'open'"), "family", "left_anti").select(
                "family", F.lit(self.schema.name).alias("schema_ref"), F.lit(model).alias("model"), F.lit(1).alias("round"), F.lit("open").alias("phase"),
                *[F.lit(None).cast(t).alias(n) for n, t in (("version", "int"), ("report", "string"), ("reason", "string"))])
            return Change({"loop_state": state.join(new, "family", "left_anti").unionByName(new)}, touches=self._touches(new))

        return self.store.update(make)

    def run(self, most: int | None = None) -> Snapshot:
        """Rounds until no family is open, `most` at most."""
        done = self.store.read()
        while most is None or most > 0:
            after = self.step()
            if after is None:
                break
            done, most = after, None if most is None else most - 1
        return done

    def _touches(self, names: DataFrame) -> frozenset[str]:
        some = [r["family"] for r in names.select("family").distinct().limit(NAMED + 1).collect()]
        return frozenset(some if len(some) <= NAMED else "*")

    def _known(self, open_: DataFrame) -> DataFrame:
        """The trusted records of open families, each by the model that its family is at; models are few."""
        out = None
        for model in sorted(r["model"] for r in open_.select("model").distinct().collect()):
            rows = self.oracle(model)
            own = rows.select("family", "page_id", "item_ix", *[_text(rows, n) for n in self.schema.names]).join(open_.where(F.col("model") == model).select("family"), "family", "left_semi")
            out = own if out is None else out.unionByName(own)
        return out.join(_large(self.samples.select("family", "page_id")), ["family", "page_id"], "left_semi")

    def _runs(self, candidates: DataFrame, pages: DataFrame, known: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
        """(records, runs) of each family's candidates on its pages."""
        by, names = ["family", "ord", "page_id"], self.schema.names
        got = apply_specs(pages.select("family", "page_id", "json").join(candidates.select("family", "ord", "spec"), "family"), names)
        got = kept(got.select(*by, F.lit(0).alias("item_ix"), *names), "records")
        want = known.select("family", "page_id", "item_ix", *names).join(candidates.select("family", "ord"), "family")
        detail = agreement_detail(got, want, by, self.schema.align_key, "item_ix", names, self.schema.volatile)
        sound = check_items(got, self.schema).select(*by, (~F.col("invalid")).alias("schema_ok"))
        runs = detail.join(_large(sound), by, "left").select("family", F.col("ord").cast("string").alias("candidate"), "ord", F.lit(kind).alias("kind"), F.lit(False).alias("error"), "schema_ok", "mean", "min_item", "count_match")
        return got, runs

    def _candidates(self, ready: DataFrame, pages: DataFrame, known: DataFrame) -> DataFrame:
        """(family, model, round, ord, origin, spec), written down: each is asked for once."""
        new = ready.where("round = 1").select("family")
        made = discovered_maps(pages.join(new, "family", "left_semi"), known.join(new, "family", "left_semi"), self.schema).select("family", F.lit(0).alias("ord"), F.lit("discovery").alias("origin"), "spec")
        if self.propose is not None:
            first = pages.join(new, "family", "left_semi").groupBy("family").agg(F.min_by(F.struct("page_id", "json"), "page_id").alias("f")).select("family", "f.*")
            shown = first.join(_large(known.where("item_ix = 0").select("family", "page_id", F.to_json(F.struct(*self.schema.names)).alias("known"))), ["family", "page_id"])
            maps = kept(self.propose(shown).select("family", "spec"), "proposed")
            made = made.unionByName(reproducing(maps, pages, known, self.schema).select("family", F.lit(1).alias("ord"), F.lit("map").alias("origin"), "spec"))
        generated = self.generate(ready.select("family", "round", "model", "report"))
        generated = generated.withColumn("_k", F.row_number().over(Window.partitionBy("family").orderBy("ord"))).where(F.col("_k") <= self.per_round)
        made = made.unionByName(generated.select("family", (F.col("_k") + 1).alias("ord"), F.lit("generated").alias("origin"), "spec"))
        return kept(ready.select("family", "model", "round").join(made, "family"), "candidates")

    def _fixtures(self, s: Snapshot, names: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pages, known records) of the families' golden pages."""
        own = s.table("fixtures").join(names.select("family"), "family", "left_semi")
        kind = "array<struct<" + ",".join(f"`{n}`:string" for n in self.schema.names) + ">>"
        known = own.select("family", F.col("sample").cast("long").alias("page_id"), F.posexplode(F.from_json("expected", kind)).alias("item_ix", "x"))
        return own.select("family", F.col("sample").cast("long").alias("page_id"), "json"), known.select("family", "page_id", "item_ix", "x.*")

    def _warnings(self, s: Snapshot, won: DataFrame, pages: DataFrame, records: DataFrame) -> DataFrame:
        """(family, warnings): volatile amounts of the winner's first page that moved far from the URL's last run."""
        names, key = self.schema.names, self.schema.align_key
        first = pages.groupBy("family").agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("f")).select("family", "f.page_id", "f.url")
        new = records.join(won.select("family", "ord"), ["family", "ord"], "left_semi").join(first.select("family", "page_id"), ["family", "page_id"], "left_semi").select("family", "item_ix", *names)
        last = latest_history(s.table("run_history"), ["family", "url"]).join(first.select("family", "url"), ["family", "url"], "left_semi")
        kind = "array<struct<" + ",".join(f"`{n}`:string" for n in names) + ">>"
        old = last.select("family", F.posexplode(F.from_json("extracted_json", kind)).alias("item_ix", "x")).select("family", "item_ix", "x.*")
        moved = history_jumps(aligned_pairs(new, old, ["family"], key, "item_ix", names), names, self.schema.volatile, key or names[0], by=["family"])
        amount = lambda c: F.regexp_replace(F.col(c).cast("decimal(30,6)").cast("string"), r"\.?0+$", "")
        label = F.coalesce("label", F.lit("None")) if key else F.lit("?")
        line = F.concat(label, F.lit(":"), "field", F.lit(" jumped "), amount("old"), F.lit("->"), amount("new"))
        return moved.withColumn("line", line).groupBy("family").agg(F.array_sort(F.collect_list("line")).alias("warnings"))

    def step(self) -> Snapshot | None:
        """One round of every open family, committed; None if none is open."""
        base = self.store.read()
        open_ = kept(base.table("loop_state").where((F.col("phase") == "open") & (F.col("schema_ref") == self.schema.name)), "open")
        if open_.isEmpty():
            return None
        known = kept(self._known(open_), "known")
        usable = known.groupBy("family").agg(F.count_distinct("page_id").alias("usable"))
        seen = self.samples.join(open_.select("family"), "family", "left_semi").groupBy("family").agg(F.count_distinct("page_id").alias("seen"))
        counted = kept(open_.join(usable, "family", "left").join(seen, "family", "left").na.fill(0, ["usable", "seen"]), "counted")
        ready = counted.where(F.col("usable") >= self.min_oracles)
        pages = kept(self.samples.join(ready.select("family"), "family", "left_semi").join(_large(known.select("family", "page_id").distinct()), ["family", "page_id"], "left_semi"), "samples")
        candidates = self._candidates(ready, pages, known)

        records, runs = self._runs(candidates, pages, known, "sample")
        golden, expected = self._fixtures(base, ready)
        if not golden.isEmpty():
            runs = runs.unionByName(self._runs(candidates, golden, expected, "fixture")[1])
        scores = kept(score_summary(score_candidates(runs, self.bar, ["family"])), "scores")
        best = scores.where("passed").groupBy("family").agg(F.max_by(F.struct("ord", "summary"), F.struct("agreement", -F.col("ord"))).alias("b")).select("family", "b.*")
        won = kept(best.join(candidates.select("family", "ord", "spec"), ["family", "ord"]), "won")
        residual = residual_fields(records.join(won.select("family", "ord"), ["family", "ord"], "left_semi").withColumnRenamed("page_id", "sample"), known.withColumnRenamed("page_id", "sample"), "family", self.schema.names)
        residual = residual.join(won.select("family"), "family", "left_semi").groupBy("family").agg(F.array_sort(F.collect_list("field")).alias("residual"))
        promoted = won.join(self._warnings(base, won, pages, records), "family", "left").join(residual, "family", "left")
        promoted = kept(promoted.withColumns({"warnings": F.coalesce("warnings", F.array().cast("array<string>")), "residual": F.coalesce("residual", F.array().cast("array<string>"))}), "promoted")

        none = F.concat(F.lit("Round "), F.col("round").cast("string"), F.lit(": no candidate"))
        stronger = F.create_map(*[F.lit(x) for m in {r["model"] for r in open_.select("model").distinct().collect()} for x in (m, stronger_model(m, self.stronger))]) if self.stronger else None
        lost = (F.when(F.col("seen") == 0, "no samples").when(F.col("usable") < self.min_oracles, F.concat(F.lit("insufficient oracles: got "), F.col("usable").cast("string"), F.lit(f", need {self.min_oracles}")))
                .when((F.col("round") >= self.max_rounds), "max rounds exhausted"))
        after = counted.join(won.select("family", F.lit(True).alias("won")), "family", "left").join(failure_report(scores, ["family"]).withColumnRenamed("report", "_report"), "family", "left")
        after = after.withColumn("lost", F.when(F.col("won").isNull(), lost))
        after = after.withColumn("next", F.when(F.col("lost").isNotNull() & (F.col("lost") != "no samples"), stronger[F.col("model")] if stronger is not None else F.lit(None).cast("string")))
        after = kept(after.withColumn("new_phase", F.when(F.col("won"), "promoted").when(F.col("lost").isNotNull() & F.col("next").isNull(), "escalated").otherwise("open")).withColumn("_report", F.coalesce("_report", none)), "after")
        touches = self._touches(open_)

        return self.store.update(lambda s: self._change(s, after, promoted, candidates, scores, pages, known, touches), base=base)

    def _change(self, s: Snapshot, after: DataFrame, promoted: DataFrame, candidates: DataFrame, scores: DataFrame, pages: DataFrame, known: DataFrame, touches: frozenset[str]) -> Change:
        """What a round makes of the registry's tables."""
        versions = s.table("versions")
        numbers = promoted.join(registry.next_version(versions), "family", "left").withColumn("n", F.coalesce("next_n", F.lit(1)))
        added = registry.add_versions(versions, promoted.select("family", "spec", F.lit(0).alias("ord")), self.now)
        versions = registry.set_active(added, numbers.select("family", "n"), strict=False)

        state = after.join(numbers.select("family", F.col("n").alias("_n")), "family", "left").select(
            "family", "schema_ref", F.coalesce("next", "model").alias("model"), F.when(F.col("next").isNotNull(), 1).when((F.col("new_phase") == "open"), F.col("round") + 1).otherwise(F.col("round")).alias("round"),
            F.col("new_phase").alias("phase"), F.col("_n").alias("version"), F.when((F.col("new_phase") == "open") & F.col("next").isNull(), F.col("_report")).alias("report"),
            F.when(F.col("won"), "promoted").otherwise(F.col("lost")).alias("reason"))
        rest = s.table("loop_state").join(after.select("family"), "family", "left_anti")

        families = s.table("families")
        new = after.join(families.select("family"), "family", "left_anti").select("family", F.array().cast("array<string>").alias("url_patterns"), "schema_ref", F.lit("healthy").alias("status"), registry.now_iso(self.now).alias("created_at"))
        status = F.when(F.col("new_phase") == "promoted", "healthy").when(F.col("lost").isNotNull() & F.col("next").isNull(), "escalated").when(F.col("new_phase") == "open", "regenerating")
        families = families.unionByName(new).join(after.select("family", status.alias("_status")), "family", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")

        own = known.select("family", "page_id", F.struct("item_ix", *self.schema.names).alias("r")).groupBy("family", "page_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
        expected = own.select("family", "page_id", F.to_json(F.transform("r", lambda x: F.struct(*[x[n].alias(n) for n in self.schema.names])), {"ignoreNullFields": "false"}).alias("expected"))
        golden = pages.join(promoted.select("family"), "family", "left_semi").select("family", "page_id", "json").join(_large(expected), ["family", "page_id"])
        golden = numbered(golden, [F.col("page_id")], ["family"]).select("family", F.col("place").cast("int").alias("sample"), "page_id", "json", "expected")
        fixtures = s.table("fixtures").join(promoted.select("family"), "family", "left_anti").unionByName(golden)

        data = "struct<to_version:int,schema_ref:string,scores:string,history_warnings:array<string>,residual_fields:array<string>,reason:string,rounds:int,model:string>"
        none = lambda *names: [F.lit(None).cast("array<string>" if "_" in n and n != "schema_ref" and n != "to_version" else "int" if n in ("to_version", "rounds") else "string").alias(n) for n in names]
        ups = numbers.select("family", F.lit("promote").alias("event"), F.struct(F.col("n").alias("to_version"), F.lit(self.schema.name).alias("schema_ref"), F.to_json("summary").alias("scores"), F.col("warnings").alias("history_warnings"), F.col("residual").alias("residual_fields"), *none("reason", "rounds", "model")).cast(data).alias("data"))
        downs = after.where("lost is not null").select("family", F.lit("escalated").alias("event"), F.struct(*none("to_version", "schema_ref", "scores", "history_warnings", "residual_fields"), F.col("lost").alias("reason"), F.when(F.col("lost") == "max rounds exhausted", F.col("round")).otherwise(0).alias("rounds"), "model").cast(data).alias("data"))
        last = s.table("audit").agg(F.max("id")).first()[0] or 0
        audit = registry.audit_rows(ups.unionByName(downs), last, self.now)

        tried = candidates.join(scores.select("family", "ord", "passed", "agreement", F.to_json("summary").alias("detail")), ["family", "ord"], "left")
        return Change({"versions": versions, "loop_state": rest.unionByName(state), "families": families, "fixtures": fixtures}, {"audit": audit, "candidates": tried.select(*[c.split()[0] for c in TABLES["candidates"].split(", ")])}, touches)
