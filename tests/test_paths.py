"""Paths as text and back, reads at any key, and known values found by a band join."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamwork.operators import jsonpaths
from loamwork.operators.fieldmap import apply_fieldmap
from loamwork.plans.promote import field_map_of

KEYS = ["it's", "a\\", "\\'", 'say "x"', "both ' and \"", "", "dot.key", "[0]", "'] ['", "é\n", "0"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.text(), st.sampled_from(KEYS), st.integers(0, 10**12))))
def test_paths_come_back_as_they_were(steps):
    assert jsonpaths.path_steps(jsonpaths.path_text(steps)) == steps


@pytest.mark.parametrize("text", ["", "x", "$.a", "$['a'", "$['a\\b']", "$[01]", "$['a']x", "$[-1]"])
def test_other_texts_are_no_paths(text):
    with pytest.raises(ValueError):
        jsonpaths.path_steps(text)


def test_a_discovered_map_reads_any_key(spark):
    rows = [(i, json.dumps({"top": [{k: f"v{i}-{n}" for n, k in enumerate(KEYS)}]})) for i in range(3)]
    samples = spark.createDataFrame(rows, "page_id long, json string")
    known = spark.createDataFrame([(i, f"f{n}", f" v{i}-{n} ") for i in range(3) for n in range(len(KEYS))], "page_id long, field string, value string")
    spec = field_map_of(jsonpaths.discover(jsonpaths.json_leaves(samples, "page_id"), known, "page_id", []))
    assert {f: s["path"] for f, s in spec.items()} == {f"f{n}": ["top", 0, k] for n, k in enumerate(KEYS)}
    got = {r.page_id: r.asDict() for r in apply_fieldmap(samples, spec).collect()}
    assert all(got[i][f"f{n}"] == f"v{i}-{n}" for i in range(3) for n in range(len(KEYS)))


def python_close(a, b):
    return abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1.0)


def test_the_band_join_finds_what_every_pair_would(spark):
    """Amounts of all sizes, just inside and outside of the tolerance, at both scales, and on the edges of bins."""
    base = [0.0, 1e-12, 0.5, 1 - 1e-10, 1.0, 1 + 1e-10, math.e, 12.0, 51.77, 3135.0, 99999.99, 1e15, 1e300, -7.25, -1e8]
    leaves = [x * f for x in base for f in (1, 1 + 4e-10, 1 + 3e-9, 1 - 5e-10)] + [k * 1e-6 for k in range(1, 4)]
    wants = base + [x * 10_000 for x in base if x < 1e300] + [k * 1e-6 - 1e-16 for k in range(1, 4)]
    df = spark.createDataFrame([(1, f"$[{i}]", 1, ["x"], "num", repr(x)) for i, x in enumerate(leaves)], "s int, path string, depth int, steps array<string>, kind string, value string")
    known = spark.createDataFrame([(1, "n", repr(x)) for x in wants], "s int, field string, want string")
    hits = jsonpaths.value_hits(df, known, "s", F.col("field") == "n")
    got = [(r.value, r.want, r.scale) for r in hits.collect()]
    want = {(repr(x), repr(t), s) for x in leaves for t in wants for s in (1, 10_000) if python_close(x * s, t)}
    assert set(got) == want and len(got) == len([1 for x in leaves for t in wants for s in (1, 10_000) if python_close(x * s, t)])
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert all("_key" in line for line in plan.splitlines() if "Join" in line)


def test_each_family_is_discovered_on_its_own_samples(spark):
    docs = {1: ("a", {"x": 5, "t": "one"}), 2: ("a", {"x": 6, "t": "two"}), 3: ("b", {"y": {"x": 0.0007}, "t": "\tthree "}), 4: ("b", {"y": {"x": 8}, "u": "four"})}
    samples = spark.createDataFrame([(i, json.dumps(d)) for i, (_, d) in docs.items()], "page_id long, json string")
    known = spark.createDataFrame([("a", 1, "n", "50000"), ("a", 2, "n", "60,000"), ("b", 3, "n", "7"), ("b", 4, "n", "80000"), ("a", 1, "t", "one"), ("a", 2, "t", "two"), ("b", 3, "t", "three"), ("b", 4, "t", None)], "family string, page_id long, field string, value string")
    got = {(r.family, r.field, r.path, r.scale) for r in jsonpaths.discover(jsonpaths.json_leaves(samples, "page_id"), known, "page_id", ["n"], by=["family"]).collect()}
    assert got == {("a", "n", "$['x']", 10_000), ("a", "t", "$['t']", None), ("b", "n", "$['y']['x']", 10_000)}


def test_discovery_sends_no_values_to_the_driver(spark, sf):
    """However small an exploded table is thought to be, known values and leaves meet in an exchange."""
    from loamwork import catalogue

    plan = catalogue.queries()["discover_paths"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert plan.count("MapInArrow") == 1  # the leaves are read once


def test_field_map_from_discovery_sends_no_values_to_the_driver(spark, sf, monkeypatch):
    from loamwork import catalogue
    from loamwork.plans import promote

    plans, made = [], promote.field_map_of
    monkeypatch.setattr(promote, "field_map_of", lambda found: plans.append(found._jdf.queryExecution().executedPlan().toString()) or made(found))
    assert catalogue.queries()["field_map_from_discovery"](spark, sf).count() == 3
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_no_job_of_field_map_from_discovery_sends_a_table_to_the_driver(spark, sf):
    """All plans of the query as they ran, re-planned ones too, not the discovery's first plan alone."""
    from loamwork import catalogue

    def ran():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        done = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {done.apply(i).executionId(): done.apply(i).physicalPlanDescription() for i in range(done.size())}

    before = ran()
    catalogue.queries()["field_map_from_discovery"](spark, sf)
    plans = [p for k, p in ran().items() if k not in before]
    found = [p for p in plans if "MapInArrow" in p]
    assert len(found) == 1 and "Final Plan" in found[0] and "SortMergeJoin" in found[0]
    assert not any("Broadcast" in p for p in plans)
