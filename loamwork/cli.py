"""Command line over a registry folder: a store, or a folder of Parquet tables (reports only).

    python -m loamwork.cli REGISTRY family [list | show NAME | rollback NAME | activate NAME N | status NAME STATUS]
    python -m loamwork.cli REGISTRY access | audit [NAME] | loop [show [NAME]]
    python -m loamwork.cli REGISTRY domain list CONFIG | domain check CONFIG URL
    python -m loamwork.cli REGISTRY loop run --schema REF --samples PATH --truth PATH --answers PATH [--families A,B] [--model M] [--stronger M=N] [--rounds N]
    python -m loamwork.cli REGISTRY request --schema REF --pages PATH --out PATH [--trusted PATH] [--tails PATH --residual A,B]

--json gives JSON lines. A loop's samples have family, page_id, url, json; its truth family, page_id, item_ix, the fields and,
if models differ, model; its answers are canned proposals: family, model, round, ord, spec. A request's pages are those of
serve_requests; what is served is written to --out, and the report counts it.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators import registry
from loamwork.plans.regenerate import MAX_ROUNDS, Regeneration
from loamwork.plans.serve import serve_requests
from loamwork.sources.config import load_config, on_list
from loamwork.sources.schemas import get_schema
from loamwork.sources.store import Change, Snapshot, Store


def show(rows: DataFrame, as_json: bool) -> list[str]:
    """Lines of a report: JSON objects, or columns parted by tabs under their names. For reports of registry size."""
    if as_json:
        return rows.toJSON().collect()
    return ["\t".join(rows.columns), *("\t".join("" if x is None else str(x) for x in r) for r in rows.collect())]


#: Tables that a folder of Parquet tables names otherwise.
NAMES = {"domain_access": "access"}


class Registry:
    """A store's newest state, or a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root, Store(spark, root)
        self.snapshot: Snapshot | None = self.store.read() if self.store.read().version else None

    def table(self, name: str) -> DataFrame:
        if self.snapshot is not None:
            return self.snapshot.table(name)
        return self.spark.read.parquet(f"{self.root}/{NAMES.get(name, name)}.parquet")

    def family(self, name: str | None) -> str:
        if name is None or registry.lookup(self.table("families"), family=name) is None:
            raise LookupError(name)
        return name


def family(r: Registry, args: argparse.Namespace) -> DataFrame:
    verb, rest = (args.words or ["list"])[0], args.words[1:]
    if verb == "list":
        return registry.all_families(r.table("families"))
    if verb in ("rollback", "activate", "status"):
        name = r.family(rest[0] if rest else None)
        one = r.spark.createDataFrame([(name,)], "family string")

        def change(s: Snapshot) -> Change:
            versions = s.table("versions")
            if verb == "status":
                return Change({"families": registry.set_status(s.table("families"), name, rest[1])}, touches=frozenset({name}))
            after = registry.rollback(versions, one) if verb == "rollback" else registry.set_active(versions, one.withColumn("n", F.lit(int(rest[1]))))
            event = one.select("family", F.lit(verb).alias("event"), F.struct(F.lit(name).alias("family")).alias("data"))
            last = s.table("audit").agg(F.max("id")).first()[0] or 0
            return Change({"versions": after}, {"audit": registry.audit_rows(event, last)}, frozenset({name}))

        r.snapshot = r.store.update(change)
        if verb == "status":
            return r.table("families").where(F.col("family") == name)
        rest = [name]
    elif verb != "show":
        rest = [verb]
    name = r.family(rest[0] if rest else None)
    return registry.version_ladder(r.table("versions").where(F.col("family") == name)).orderBy("rung")


def loop(r: Registry, args: argparse.Namespace) -> DataFrame:
    if args.words[:1] == ["run"]:
        read = r.spark.read.parquet
        samples, truth, answers = read(args.samples), read(args.truth), read(args.answers)
        of_model = (lambda m: truth.where(F.col("model") == m).drop("model")) if "model" in truth.columns else lambda m: truth
        stronger = dict(x.split("=", 1) for x in args.stronger or [])
        run = Regeneration(r.store, get_schema(args.schema), samples, of_model, lambda open_: answers.join(open_.select("family", "model", "round"), ["family", "model", "round"]).select("family", "ord", "spec"), stronger=stronger, max_rounds=args.rounds)
        names = samples.select("family") if args.families is None else r.spark.createDataFrame([(x,) for x in args.families.split(",")], "family string")
        run.begin(names, args.model)
        r.snapshot = run.run()
    state = r.table("loop_state")
    if args.words[:1] == ["show"] and args.words[1:]:
        state = state.where(F.col("family") == args.words[1])
    return state.orderBy("family")


def domain(r: Registry, args: argparse.Namespace) -> DataFrame:
    verb, config = args.words[0], load_config(args.words[1])
    if verb == "check":
        url = r.spark.createDataFrame([(args.words[2],)], "url string")
        return url.withColumn("allowed", on_list(F.col("url"), [d.domain for d in config]))
    rows = [(d.domain, d.max_rps, d.render_js, [k for k, _ in d.access_strategies], d.note) for d in config]
    return r.spark.createDataFrame(rows, "domain string, max_rps double, render_js boolean, strategies array<string>, note string").orderBy("domain")


def ladders(r: Registry) -> dict[str, list[tuple[int, dict]]]:
    """Each family's versions that are tried, in order, as field maps; a spec that no longer has its hash raises IntegrityError."""
    import json

    tried = registry.version_ladder(r.table("versions").where("status <> 'archived' and spec is not null"))
    changed = tried.where(~registry.verify_source(tried)).limit(10).collect()
    if changed:
        raise registry.IntegrityError(f"changed since registration: {[(x['family'], x['n']) for x in changed]}")
    out: dict[str, list[tuple[int, dict]]] = {}
    for x in tried.orderBy("family", "rung").select("family", "n", "spec").collect():  # the registry's size
        out.setdefault(x["family"], []).append((x["n"], json.loads(x["spec"])))
    return out


def request(r: Registry, args: argparse.Namespace) -> DataFrame:
    read = lambda path: r.spark.read.parquet(path) if path else None
    own = [(x["family"], list(x["url_patterns"] or [])) for x in registry.all_families(r.table("families")).collect()]
    served = serve_requests(read(args.pages), own, ladders(r), get_schema(args.schema), read(args.trusted), read(args.tails), args.residual.split(",") if args.residual else [])
    served.write.mode("errorifexists").parquet(args.out)
    return r.spark.read.parquet(args.out).groupBy("family", "source", "failure", "action").agg(F.count("*").alias("pages")).orderBy("family", "source", "failure")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loamwork", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("registry")
    parser.add_argument("what", choices=["family", "access", "audit", "loop", "domain", "request"])
    parser.add_argument("words", nargs="*")
    parser.add_argument("--json", action="store_true")
    for name in ("schema", "samples", "truth", "answers", "families", "pages", "out", "trusted", "tails", "residual"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--model", default="default")
    parser.add_argument("--stronger", action="append")
    parser.add_argument("--rounds", type=int, default=MAX_ROUNDS)
    args = parser.parse_args(argv)
    r = Registry(spark or SparkSession.builder.appName("loamwork").getOrCreate(), args.registry)
    try:
        if args.what == "access":
            rows = registry.access_rows(r.table("domain_access") if r.snapshot is None else r.table("domain_access").withColumn("id", F.col("updated_at")))
        elif args.what == "audit":
            rows = registry.read_audit(r.table("audit"), args.words[0] if args.words else None)
        else:
            rows = {"family": family, "loop": loop, "domain": domain, "request": request}[args.what](r, args)
        print("\n".join(show(rows, args.json)))
    except LookupError as e:
        print(f"unknown: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
