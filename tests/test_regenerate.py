"""Regeneration of families as rows: rounds, models, resumption, fixtures, audit."""

import json
import re

import pytest
from pyspark.sql import functions as F

from loamwork.operators.fieldmap import apply_fieldmap, apply_specs
from loamwork.plans.regenerate import Regeneration, specs_by
from loamwork.sources.schemas import get_schema
from loamwork.sources.store import Change, Store, TABLES

NONE = lambda *p: {"path": list(p), "transform": "none"}
GOOD = {"title": NONE("t"), "company": NONE("c"), "salary": {"path": ["k"], "transform": "x10000"}, "employment_type": {"path": ["label"], "transform": {"map": {"Full": "full_time", "Part": "part_time"}}}}
BAD = GOOD | {"salary": {"path": ["k"], "transform": "int"}}


def test_maps_of_each_row_read_as_compiled_ones(spark):
    docs = [{"a": {"b c": [1, 2.5, "x", None, True]}, "n": "1,234.5", "it's": " v ", "tags": [{"t": "a"}, {"u": 1}, {"t": None}, 3], "big": 1e30, "o": {"x": [1, {"y": 2}]}, "s": "Full and Part"}, {"a": None, "n": True, "tags": "x"}, {}, [1], "text"]
    specs = {"p": NONE("a", "b c", 1), "q": NONE("a"), "r": NONE("o"), "s": {"path": ["n"], "transform": "x10000"}, "t": {"path": ["n"], "transform": "int"}, "u": {"path": ["n"], "transform": "float"}, "v": {"path": ["s"], "transform": {"map": {"Part": "p", "Full": "f"}}},
             "w": {"path": [], "transform": {"concat": [["it's"], ["none"], ["a", "b c", 2]], "sep": "-"}}, "x": {"transform": {"list": [["tags"]], "field": "t"}}, "y": {"path": ["tags"], "transform": {"list": [["tags"]]}}, "z": {"path": ["a", -1], "transform": "none"}, "aa": {"path": ["s"], "transform": "unknown"}, "bb": NONE(), "cc": {"path": ["big"], "transform": "x10000"}, "dd": NONE("a", True), "ee": NONE("a", "b c", 4)}
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, "{bad"), (10, None)], "i int, json string")
    want = {r.i: r.asDict() for r in apply_fieldmap(df, specs).collect()}
    got = {r.i: r.asDict() for r in apply_specs(df.withColumn("spec", F.lit(json.dumps(specs))), list(specs)).drop("spec").collect()}
    assert got == want


def inputs(spark):
    """a is found by discovery, b by its second round, c by the stronger model only, d never, e has few records, f no pages."""
    pages, truth = [], []
    for f, n in (("a", 4), ("b", 4), ("c", 4), ("d", 4), ("e", 4)):
        for i in range(n):
            page = 100 * (ord(f) - 96) + i
            full = i % 2 == 0
            pages.append((f, page, f"http://h/{f}/{i}", json.dumps({"t": f"title {f}{i}", "c": f"co {i}", "k": 3 + i, "label": "Full-time" if full else "Part-time"})))
            if f != "e" or i < 2:
                truth.append((f, page, 0, f" title {f}{i}", f"co {i}", str((3 + i) * 10_000), None if f == "a" else ("full_time" if full else "part_time")))
    samples = spark.createDataFrame(pages, "family string, page_id long, url string, json string")
    known = spark.createDataFrame(truth, "family string, page_id long, item_ix int, title string, company string, salary string, employment_type string")
    return samples, known


def propose(family, n, model, report):
    if family == "b":
        assert (report != "") == (n > 1)
        return [BAD] if n == 1 else [BAD, GOOD]
    if family == "c" and model == "large":
        return [GOOD]
    if family == "d":
        raise RuntimeError("no idea")
    return [BAD]


def loop(spark, tmp_path, **more):
    samples, known = inputs(spark)
    return Regeneration(Store(spark, str(tmp_path)), get_schema("JobPosting"), samples, lambda model: known, specs_by(propose), stronger={"small": "large"}, max_rounds=2, now="t", **more)


def outcome(s):
    return {r.family: (r.phase, r.model, r["round"], r.version, r.reason) for r in s.table("loop_state").collect()}


def test_a_loop_that_is_stopped_after_a_round_goes_on(spark, tmp_path):
    one = loop(spark, tmp_path)
    names = spark.createDataFrame([(f,) for f in "abcdef"], "family string")
    old = [(1, "a", "http://h/a/0", 1, json.dumps([{"title": "title a0", "salary": "90000"}]), "t")]
    one.store.update(lambda s: Change(append={"run_history": spark.createDataFrame(old, TABLES["run_history"]), "versions": spark.createDataFrame([("a", 4, "active", "{}", "x", "t", 9, 9)], TABLES["versions"])}))
    one.begin(names, "small")
    after = one.run(most=1)
    assert outcome(after) == {"a": ("promoted", "small", 1, 5, "promoted"), "b": ("open", "small", 2, None, None), "c": ("open", "small", 2, None, None), "d": ("open", "small", 2, None, None),
                              "e": ("open", "large", 1, None, "insufficient oracles: got 2, need 3"), "f": ("escalated", "small", 1, None, "no samples")}
    assert {r.family: r.status for r in after.table("families").collect()} == {"a": "healthy", "b": "regenerating", "c": "regenerating", "d": "regenerating", "e": "regenerating", "f": "escalated"}

    # another process goes on: what was open stays as it was
    two = loop(spark, tmp_path)
    two.begin(names.where("family in ('b', 'c')"), "small")
    done = two.run()
    assert outcome(done) == {"a": ("promoted", "small", 1, 5, "promoted"), "b": ("promoted", "small", 2, 1, "promoted"), "c": ("promoted", "large", 1, 1, "promoted"), "d": ("escalated", "large", 2, None, "max rounds exhausted"),
                             "e": ("escalated", "large", 1, None, "insufficient oracles: got 2, need 3"), "f": ("escalated", "small", 1, None, "no samples")}
    assert {(r.family, r.n, r.status) for r in done.table("versions").collect()} == {("a", 4, "fallback"), ("a", 5, "active"), ("b", 1, "active"), ("c", 1, "active")}
    assert {r.family: r.status for r in done.table("families").collect()} == {"a": "healthy", "b": "healthy", "c": "healthy", "d": "escalated", "e": "escalated", "f": "escalated"}
    audit = [(r.id, r.family, r.event, json.loads(r["data"])) for r in done.table("audit").orderBy("id").collect()]
    assert [x[0] for x in audit] == list(range(1, len(audit) + 1))
    assert [(f, e, d.get("reason") or d["to_version"]) for _, f, e, d in audit] == [
        ("a", "promote", 5), ("e", "escalated", "insufficient oracles: got 2, need 3"), ("f", "escalated", "no samples"),
        ("b", "promote", 1), ("c", "escalated", "max rounds exhausted"), ("d", "escalated", "max rounds exhausted"), ("e", "escalated", "insufficient oracles: got 2, need 3"),
        ("c", "promote", 1), ("d", "escalated", "max rounds exhausted")]
    first = next(d for _, f, e, d in audit if f == "a")
    assert first["history_warnings"] == ["None:salary jumped 90000->30000"] and first["residual_fields"] == [] and json.loads(first["scores"])["passed"]
    assert {(r.family, r.sample) for r in done.table("fixtures").collect()} == {(f, i) for f in "abc" for i in range(4)}
    tried = {(r.family, r.model, r["round"], r.ord, r.origin): r.passed for r in done.table("candidates").collect()}
    assert tried[("a", "small", 1, 0, "discovery")] and not tried[("b", "small", 1, 0, "discovery")] and tried[("b", "small", 2, 3, "generated")] and ("b", "small", 2, 0, "discovery") not in tried
    assert two.step() is None


def test_fixtures_hold_a_new_version_to_what_the_old_one_read(spark, tmp_path):
    """A golden page that the discovered map reads otherwise keeps it from promotion."""
    one = loop(spark, tmp_path)
    wrong = [("a", 0, 1, json.dumps({"t": "x", "c": "y", "k": 1}), json.dumps([{"title": "another", "company": "y", "salary": "10000"}]))]
    one.store.update(lambda s: Change(append={"fixtures": spark.createDataFrame(wrong, TABLES["fixtures"])}))
    one.begin(spark.createDataFrame([("a",)], "family string"), "small")
    assert outcome(one.run(most=1))["a"][0] == "open"


def test_proposed_maps_count_if_they_reproduce_enough_and_residual_fields_are_kept(spark, tmp_path):
    samples, known = inputs(spark)
    known = known.withColumn("location", F.lit("nowhere"))
    asked = lambda first: first.select("family", F.when(F.col("family") == "b", json.dumps(GOOD)).otherwise(json.dumps({"title": NONE("t")})).alias("spec"))
    one = Regeneration(Store(spark, str(tmp_path)), get_schema("JobPosting"), samples, lambda model: known, specs_by(lambda *a: []), asked, max_rounds=1, bar=0.8, now="t")
    one.begin(spark.createDataFrame([("b",), ("c",)], "family string"), "small")
    done = one.run()
    assert {(r.family, r.origin, r.ord) for r in done.table("candidates").collect()} >= {("b", "map", 1)} and not done.table("candidates").where("family = 'c' and origin = 'map'").count()
    data = json.loads(done.table("audit").where("family = 'b'").first()["data"])
    assert data["residual_fields"] == ["location"] and outcome(done)["b"][0] == "promoted"


def test_a_round_is_refused_if_the_family_changed_meanwhile(spark, tmp_path, monkeypatch):
    from loamwork.sources.store import Conflict

    one = loop(spark, tmp_path)
    one.begin(spark.createDataFrame([("a",)], "family string"), "small")
    own = one._candidates

    def meddled(*a):
        one.store.update(lambda s: Change(append={"versions": spark.createDataFrame([("a", 9, "active", "{}", "x", "t", 0, 0)], TABLES["versions"])}, touches=frozenset("a")))
        return own(*a)

    object.__setattr__(one, "_candidates", meddled)
    with pytest.raises(Conflict):
        one.step()
    assert [(r.n, r.status) for r in one.store.read().table("versions").collect()] == [(9, "active")]


def test_tables_by_page_are_not_sent_to_the_driver(spark, sf, monkeypatch):
    """However small the loop's tables look, those with a row a page meet in exchanges."""
    from loamwork import catalogue
    from loamwork.operators import numbering
    from loamwork.plans import regenerate

    plans, kept = {}, regenerate.kept

    def seen(df, tag):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, tag)

    monkeypatch.setattr(regenerate, "kept", seen)
    monkeypatch.setattr(numbering, "kept", seen)
    assert catalogue.queries()["loop_promote"](spark, sf).count()
    assert {"known", "samples", "candidates", "scores", "promoted", "numbered"} <= plans.keys()
    found = {tag: [x for p in own for x in re.findall(r"BroadcastHashJoin \[[^\]]*(?:page_id|sample)#.*", p)] for tag, own in plans.items()}
    # a winner's warnings read one page a family, which is a table by family
    assert not {tag: x for tag, own in found.items() if (x := [j for j in own if tag != "promoted" or "LeftSemi" not in j])}
