"""Registry writes, promotion, trusted records, routing of malformed patterns, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from loamwork import cli
from loamwork.operators import agree, failure, registry, route
from loamwork.plans import promote, trusted
from loamwork.plans.serve import serve_requests
from loamwork.sources.config import parse_domain
from loamwork.sources.schemas import get_schema

VERSIONS = "family string, n int, status string, spec string, source_sha string, promoted_at string, runs long, successes long"


def versions(spark, *rows):
    return spark.createDataFrame([(f, n, s, None, None, None, 0, 0) for f, n, s in rows], VERSIONS)


def test_unknown_versions_are_errors_and_change_nothing(spark):
    v = versions(spark, ("a", 1, "active"), ("a", 2, "fallback"), ("b", 1, "active"))
    with pytest.raises(LookupError):
        registry.set_active(v, spark.createDataFrame([("a", 9)], "family string, n int"))
    with pytest.raises(LookupError):
        registry.rollback(v, spark.createDataFrame([("b",)], "family string"))
    back = registry.rollback(v, spark.createDataFrame([("a",)], "family string"))
    assert {(r.family, r.n, r.status) for r in back.collect()} == {("a", 1, "archived"), ("a", 2, "active"), ("b", 1, "active")}
    with pytest.raises(LookupError):
        registry.record_runs(v, spark.createDataFrame([("b", 7, True)], "family string, n int, ok boolean"))
    run = registry.record_runs(v, spark.createDataFrame([("a", 1, True), ("a", 1, False)], "family string, n int, ok boolean"))
    assert registry.lookup(run, family="a", n=1)["runs"] == 2 and registry.lookup(run, family="a", n=1)["successes"] == 1 and registry.lookup(run, family="c") is None


def test_promotion_registers_activates_and_audits(spark):
    v = versions(spark, ("a", 1, "active"), ("b", 4, "active"))
    spec = {"title": {"path": ["t"], "transform": "none"}}
    done = promote.promote(spark, v, "a", spec, "Quote@1", after=10, scores={"agreement": 1.0}, residual=["tags"], now="2024-05-01")
    assert done.n == 2 and {(r.family, r.n, r.status) for r in done.versions.collect()} == {("a", 1, "fallback"), ("a", 2, "active"), ("b", 4, "active")}
    row = done.audit.first()
    assert row.id > 10 and row.ts == "2024-05-01" and json.loads(row["data"])["residual_fields"] == ["tags"]
    own = done.versions.where("family = 'a' and n = 2")
    assert json.loads(registry.active_specs(own).first().spec) == spec
    with pytest.raises(registry.IntegrityError):
        registry.active_specs(own.withColumn("spec", F.lit("{}")))
    with pytest.raises(ValueError):
        registry.add_versions(v, spark.createDataFrame([("a", "import os", 0)], "family string, spec string, ord int"))


def test_escalation_makes_the_family_if_need_be(spark):
    families = spark.createDataFrame([("a", ["x"], "Quote@1", "healthy", "t0")], "family string, url_patterns array<string>, schema_ref string, status string, created_at string")
    for name in ("a", "new"):
        after, audit = promote.escalate(spark, families, name, "Quote@1", "no oracle", now="t1")
        assert registry.lookup(after, family=name)["status"] == "escalated" and audit.first().event == "escalated" and after.count() == 1 + (name == "new")
    assert promote.stronger_model("small", {"small": "large"}) == "large" and promote.stronger_model("large", {"small": "large"}) is None


def test_field_maps_from_discovery_and_proposals(spark):
    schema = get_schema("Quote")
    samples = spark.createDataFrame([(i, json.dumps({"q": [{"body": f"text {i}"}], "by": f"author {i}"})) for i in range(5)], "page_id long, json string")
    oracle = samples.select("page_id", F.concat(F.lit("text "), "page_id").alias("text"), F.concat(F.lit("author "), "page_id").alias("author"))
    found = promote.value_path_candidate(samples, oracle, schema)
    assert found == {"author": {"path": ["by"], "transform": "none"}, "text": {"path": ["q", 0, "body"], "transform": "none"}}
    assert promote.value_path_candidate(samples.union(spark.createDataFrame([(9, "no json")], samples.schema)), oracle, schema) is None
    half = {"author": found["author"]}
    assert promote.path_map_candidate(samples, oracle, found) == found and promote.path_map_candidate(samples, oracle, half) is None and promote.path_map_candidate(samples, oracle, half, 0.5) == half


def test_trusted_records_and_tails(spark):
    pages = spark.createDataFrame([(1, "<p>good</p>"), (2, "<p>repaired</p>"), (3, "<p>raises</p>"), (4, None)], "page_id long, html string")

    def complete(text, error):
        if "raises" in text:
            raise OSError("down")
        if "repaired" in text and error is None:
            return "[1]"
        return '```json\n[{"text": "t", "author": "a", "tags": ["x"]}, {"text": "u", "author": "b"}]\n```' if text else "{}"

    rows = trusted.direct_extract(pages, complete, get_schema("Quote")).collect()
    assert sorted((r.page_id, r.item_ix) for r in rows if r.error is None) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert {r.page_id: r.error[:7] for r in rows if r.error} == {3: "OSError", 4: "ValueEr"} and next(r.tags for r in rows if r.tags) == '["x"]'

    def tail(text, fields):
        return json.dumps({"author": " " if "repaired" in text else "x", "other": 1}) if "raises" not in text else "nothing"

    assert {r.page_id: r.author for r in trusted.fill_residual(pages, tail, ["author", "none"], get_schema("Quote")).collect()} == {1: "x", 2: None, 3: None, 4: "x"}
    assert trusted.fill_residual(pages, tail, [], get_schema("Quote")).count() == 0
    for bad in ("[1]", "{}", "x"):
        with pytest.raises(ValueError):
            trusted.parse_items(bad)
    assert trusted.parse_object('```\n{"a": 1}\n```') == {"a": 1}


def test_requests_are_served_from_the_first_valid_rung_with_tails(spark):
    good = {"text": {"path": ["t"], "transform": "none"}, "author": {"path": ["a"], "transform": "none"}}
    pages = spark.createDataFrame([(1, "https://h/q/1", '{"t": "one", "a": "x"}', "ok", 200, None, True), (2, "https://h/q/2", '{"a": "x"}', "ok", 200, None, True), (3, "https://h/z", "{}", "ok", 200, None, False)], "page_id long, url string, json string, kind string, status int, marker string, listed boolean")
    tails = spark.createDataFrame([(1, "http://u")], "page_id long, url string")
    rows = {r.page_id: r for r in serve_requests(pages, [("q", ["/q/"])], {"q": [(2, {"author": good["author"]}), (1, good)]}, get_schema("Quote"), None, tails, ["url"]).collect()}
    assert (rows[1].used_version, rows[1].record.text, rows[1].record.url, rows[1].source) == (1, "one", "http://u", "crawler")
    assert rows[2].used_version is None and rows[2].failure == "drift" and rows[2].record is None and rows[3].family is None


def test_routing_ignores_what_no_engine_takes_and_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "http://h/a1"), (1, "http://h/a1"), (2, "http://h/b"), (3, None)], "page_id long, url string")
    assert [r.family for r in route.route(pages, [("x", ["(?P<n>a)(?P=n)?1", "(", "(?P<n"])]).orderBy("page_id").collect()] == ["x", "x", None, None]
    table = spark.createDataFrame([("h", "z", ["(", "/a"]), ("h", "y", ["(?P<d>\\d)"]), ("g", "a", ["h"])], "host string, family string, url_patterns array<string>")
    assert [r.family for r in route.route_by_table(pages, table).orderBy("page_id").collect()] == ["y", "y", None, None]
    html = """<a href="/x?a=1&amp;b=2">1</a><A class=k HREF=/y>2</A><a href='/z&#39;'>3</a><a data-href="/no">4</a>"""
    links = route.harvest_links(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string"))
    assert [r.link for r in links.orderBy("link_ix").collect()] == ["http://h/x?a=1&b=2", "http://h/y", "http://h/z'"]


def test_empty_pairs_agree_and_given_nulls_sort_as_none(spark):
    kind = "page_id int, ix int, url string, url_given boolean, v string"
    left = spark.createDataFrame([(1, 0, None, True, "null"), (1, 1, "A", True, "first")], kind)
    right = spark.createDataFrame([(1, 0, "A", True, "first"), (1, 1, None, True, "null")], kind)
    got = agree.items_agreement(left, right, ["page_id"], "url", "ix", ["v"], pages=spark.createDataFrame([(1,), (2,)], "page_id int"))
    assert {r.page_id: r.agreement for r in got.collect()} == {1: 1.0, 2: 1.0}


def test_strategies(spark):
    with pytest.raises(ValueError):
        failure.checked_kinds([k for k, _ in parse_domain({"domain": "h", "access_strategies": ["backoff", "unheard_of"]}).access_strategies])
    won = failure.saved_winners(spark.createDataFrame([("h", True, "session", 1, "working"), ("g", False, None, 2, "escalated")], "domain string, ok boolean, strategy string, rounds int, status string"), "t")
    log = won.withColumn("id", F.lit(1)).unionByName(spark.createDataFrame([("g", "backoff", None, "s", 0)], "domain string, working_strategy string, status string, updated_at string, id int"))
    assert [tuple(r) for r in registry.access_rows(log).collect()] == [("g", "backoff", "escalated", "t"), ("h", "session", "working", "t")]


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([("b", '["x"]', "Quote@1", "healthy", "t"), ("a", None, "Quote@1", "healthy", "t")], "family string, url_patterns string, schema_ref string, status string, created_at string").write.parquet(f"{tmp_path}/families.parquet")
    versions(spark, ("a", 1, "fallback"), ("a", 2, "active")).write.parquet(f"{tmp_path}/versions.parquet")
    spark.createDataFrame([(1, "t", "a", "promote", "{}"), (2, "t", "b", "promote", "{}")], "id long, ts string, family string, event string, data string").write.parquet(f"{tmp_path}/audit.parquet")
    run = lambda *a: (cli.main([str(tmp_path), *a], spark), capsys.readouterr().out.splitlines())
    code, out = run("family", "list", "--json")
    assert code == 0 and [json.loads(x)["family"] for x in out] == ["a", "b"] and json.loads(out[1])["url_patterns"] == ["x"]
    code, out = run("family", "show", "a")
    assert code == 0 and [x.split("\t")[1] for x in out[1:]] == ["2", "1"]
    assert run("family", "show", "none")[0] == 1 and len(run("audit")[1]) == 3 and len(run("audit", "b")[1]) == 2
