"""Operators on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from loamwork.operators import agree, failure, fieldmap, jsonpaths, registry, residual, route, safety
from loamwork.operators.validate import validate
from loamwork.plans.loop import run_loop
from loamwork.plans.serve import decide
from loamwork.sources import config, html_select, pages, schemas


def test_route_ignores_bad_patterns_and_takes_first_name(spark):
    p = spark.createDataFrame([("https://a.com/p/1",), ("https://b.com/",)], "url string")
    got = {r.url: r.family for r in route.route(p, [("z", ["/p/"]), ("b", ["(", "a.com"]), ("c", [])]).collect()}
    assert got == {"https://a.com/p/1": "b", "https://b.com/": None}
    assert all(r.family is None for r in route.route(p, []).collect())


def test_pagination_cycles_until_cap(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "url string, next_url string")
    walked = route.follow(spark.createDataFrame([("a",), ("c",)], "url string"), edges, 4)
    rows = sorted((r.start, r.depth, r.url) for r in walked.collect())
    assert rows == [("a", 1, "a"), ("a", 2, "b"), ("a", 3, "a"), ("a", 4, "b"), ("c", 1, "c")]


def test_collect_samples_breadth_first(spark):
    html = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    p = spark.createDataFrame([(1, "https://a.com/", html("/1", "/2", "https://b.com/x", "/1")), (2, "https://a.com/1", html("/3")), (3, "https://a.com/2", ""), (4, "https://a.com/3", "")], "page_id long, url string, html string")
    assert route.collect_samples(p, ["https://a.com/"], 3) == ["https://a.com/", "https://a.com/1", "https://a.com/2"]
    assert route.collect_samples(p, ["https://a.com/none"], 3) == []


def test_validate_precedence(spark):
    rows = [(1, None, "x", "true", "https://a/1", False), (1, "a", "1", "true", "https://a/1", False), (2, "a", "x", "true", "https://a/1", False), (2, "b", "2", "no", "http://a/2", False),
            (3, "a", "2", "1", "https://a/3", True), (4, "a", "2", "off", "https://a/4", False)]
    items = spark.createDataFrame(rows, "page_id int, name string, price string, in_stock string, url string, extra boolean").withColumn("currency", F.lit("GBP")).withColumn("image_url", F.lit(None).cast("string"))
    base = spark.createDataFrame([(4, 3)], "page_id int, baseline int")
    all_ = spark.createDataFrame([(i,) for i in range(1, 6)], "page_id int")
    got = {r.page_id: r.reason for r in validate(items, schemas.get_schema("Product"), pages=all_, baseline=base, extra="extra").collect()}
    assert got == {1: "fill_rate:name", 2: "schema: 1/2 items invalid", 3: "schema: 1/1 items invalid", 4: "item_count: 1 < 0.5*3", 5: "empty"}
    exact = spark.createDataFrame([(4, 2)], "page_id int, baseline int")
    assert validate(items.where("page_id = 4"), schemas.get_schema("Product"), baseline=exact).first().ok


def test_schema_lookup():
    assert schemas.get_schema("Quote").name == "Quote@1" and schemas.get_schema("JobPosting@1").enums == ["employment_type"]
    assert schemas.get_schema("Product").align_key == "url" and schemas.get_schema("Product").required == ["name", "price", "in_stock", "url"]
    with pytest.raises(schemas.SchemaNotFound):
        schemas.get_schema("None")


def lists(spark, a, b):
    kind = "page_id int, ix int, name string, price string"
    return agree.agreement_detail(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ["page_id"], "name", "ix", ["name", "price"], {"price"})


def test_agreement(spark):
    a = [(1, i, f"Book {c}", f"£{i}.00") for i, c in enumerate("abc")]
    same = lists(spark, a, [(p, 9 - i, n, x[1:]) for p, i, n, x in a]).first()
    assert (same["mean"], same.min_item, same.count_match) == (1.0, 1.0, True)
    dropped = lists(spark, a, a[:2]).first()
    assert dropped.min_item == 0 and not dropped.count_match and dropped["mean"] == pytest.approx(4 / 6)
    wrong = lists(spark, a, a[:2] + [(1, 2, "Book c", "£9")]).first()
    assert wrong["mean"] == pytest.approx(5 / 6) and wrong.min_item == 0.5
    assert lists(spark, a, []).first()["mean"] == 0.0


def test_scores_pool_samples_and_fixtures(spark):
    kind = "candidate string, ord int, kind string, error boolean, schema_ok boolean, mean double, min_item double, count_match boolean"
    rows = [("a", 0, "sample", False, True, 1.0, 1.0, True), ("a", 0, "fixture", False, None, 0.9, 0.9, True), ("b", 1, "sample", False, True, 1.0, 1.0, True), ("c", 2, "sample", True, None, None, None, None), ("d", 3, "sample", False, True, 1.0, 1.0, True)]
    scores = agree.score_candidates(spark.createDataFrame(rows, kind))
    got = {r.candidate: (r.passed, round(r.agreement, 3)) for r in scores.collect()}
    assert got == {"a": (False, 0.95), "b": (True, 1.0), "c": (False, 0.0), "d": (True, 1.0)}
    assert agree.best_candidate(scores).first().candidate == "b"
    assert agree.failure_report(scores).first().report.count("\n") == 1


def test_read_path(spark):
    v = spark.sql("""select parse_json('{"a": {"b c": [1, {"d": null}]}, "0": 5}') v""")
    read = lambda *steps: v.select(jsonpaths.read_path(F.col("v"), list(steps), "string").alias("x")).first().x
    assert read("a", "b c", 0) == "1" and read("a", "b c", 2) is None and read("a", "b c", -1) is None and read("a", "b c", 0, "z") is None and read("a", "none") is None and read("a", True) is None
    assert read("0") == "5" and read(0) is None


def test_leaves(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": [1, {"b": None}, {}], "c": True, "d": 1.0})), (2, "{bad"), (3, None), (4, "[]")], "k int, json string")
    got = {(r.k, r.path, r.kind, r.value) for r in jsonpaths.json_leaves(df, "k").collect()}
    assert got == {(1, "$['a'][0]", "num", "1"), (1, "$['a'][1]['b']", "null", "None"), (1, "$['c']", "bool", "True"), (1, "$['d']", "num", "1.0")}


def discovered(spark, docs, truth, numeric=()):
    leaves = jsonpaths.json_leaves(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "s int, json string"), "s")
    oracle = spark.createDataFrame([(i, k, v) for i, t in enumerate(truth) for k, v in t.items()], "s int, field string, value string")
    return {r.field: (r.path, r.scale) for r in jsonpaths.discover(leaves, oracle, "s", list(numeric)).collect()}


def test_discover(spark):
    docs = [{"x": {"name": "A"}, "name": "A", "k": 12, "n": 0}, {"x": {"name": "B"}, "name": "B", "k": 3, "n": 0}]
    assert discovered(spark, docs, [{"f": "A ", "p": "120000", "n": "0"}, {"f": "B", "p": "30000", "n": "0"}], ["p", "n"]) == {"f": ("$['name']", None), "p": ("$['k']", 10000), "n": ("$['n']", 1)}
    assert discovered(spark, docs, [{"f": "A"}, {"f": None}]) == {} and discovered(spark, docs, [{"f": "A"}, {"f": "A"}]) == {}


def test_transforms(spark):
    doc = {"a": {"n": "1,200.5", "half": 0.00005, "b": True, "s": "Permanent Full-time", "l": [{"u": "x"}, {"v": 1}, {"u": None}, 3]}, "city": " X "}
    df = spark.createDataFrame([(json.dumps(doc),)], "json string")
    specs = {
        "x": {"path": ["a", "half"], "transform": "x10000"}, "i": {"path": ["a", "n"], "transform": "int"}, "f": {"path": ["a", "n"], "transform": "float"}, "flag": {"path": ["a", "b"], "transform": "int"},
        "m": {"path": ["a", "s"], "transform": {"map": {"Full": "first", "Full-time": "second"}}}, "c": {"path": [], "transform": {"concat": [["none"], ["city"], ["a", "n"]], "sep": "-"}},
        "none": {"path": [], "transform": {"concat": [["none"]]}}, "l": {"path": [], "transform": {"list": [["a", "l"]], "field": "u"}}, "bad": {"path": ["a"], "transform": "odd"}, "obj": {"path": ["a", "l", 0], "transform": "none"}}
    got = fieldmap.apply_fieldmap(df, specs).first()
    assert [got[k] for k in ("x", "i", "f", "flag", "m", "c", "none", "l", "bad", "obj")] == ["0", "1200", "1200.5", None, "first", "X-1,200.5", None, '["x",null]', None, '{"u":"x"}']
    with pytest.raises(fieldmap.FieldMapError):
        fieldmap.parse_fieldmap('{"a": {"path": []}}')
    assert fieldmap.parse_fieldmap('```json\n{"a": {"path": [], "transform": "none"}}\n```') == {"a": {"path": [], "transform": "none"}}


def test_ladder(spark):
    rows = [("a", 1, "fallback", "ok"), ("a", 2, "active", "invalid"), ("a", 3, "archived", "invalid"), ("b", 1, "active", "error"), ("b", 2, "fallback", "ok"), ("c", 1, "active", "invalid")]
    ladder = registry.version_ladder(spark.createDataFrame(rows, "family string, n int, status string, outcome string"))
    assert {(r.family, r.n): r.rung for r in ladder.where("family = 'a'").collect()} == {("a", 2): 1, ("a", 3): 2, ("a", 1): 3}
    assert {r.family: (r.used_version, r.attempts) for r in registry.ladder_walk(ladder).collect()} == {"a": (1, 3), "b": (None, 1), "c": (None, 1)}
    assert {(r.family, r.n): r.status for r in registry.rollback(ladder).where("family = 'a'").collect()} == {("a", 1): "active", ("a", 2): "archived", ("a", 3): "archived"}


def test_status_and_sources(spark):
    base = spark.createDataFrame([("a", "healthy")], "family string, status string")
    assert registry.set_status(base, "a", "escalated").first().status == "escalated"
    with pytest.raises(LookupError):
        registry.set_status(base, "z", "x")


@pytest.mark.parametrize("status,body,want", [(200, "", "drift"), (204, "", "drift"), (301, "", "transient"), (401, "", "blocked_auth"), (403, "CF-Challenge", "blocked_challenge"), (404, "", "gone"), (410, "", "gone"), (429, "", "blocked_rate"), (500, "", "transient")])
def test_classify(spark, status, body, want):
    df = spark.createDataFrame([(status, body)], "s int, b string")
    kind, marker = failure.outcome_kind(F.col("s")), failure.blocked_marker(F.col("s"), F.col("b"))
    assert df.select(failure.classify(kind, F.col("s"), marker, F.lit(True), F.lit(False)).alias("x")).first().x == want
    assert df.select(failure.classify(kind, F.col("s"), marker, F.lit(False), F.lit(False)).alias("x")).first().x == "refused"
    assert df.select(failure.classify(F.lit("blocked"), F.col("s"), F.lit("odd"), F.lit(True), F.lit(False)).alias("x")).first().x == "transient"


def test_residual_all_quantifier(spark):
    kind = "fam int, sample int, a string, b string"
    known = spark.createDataFrame([(1, 1, "x", "x"), (1, 2, "x", "x")], kind)
    found = spark.createDataFrame([(1, 1, None, "x"), (1, 2, None, None)], kind)
    assert [tuple(r) for r in residual.residual_fields(found, known, "fam", ["a", "b"]).collect()] == [(1, "a")]


def test_config(spark):
    d = config.parse_domain({"domain": "A.com:80", "access_strategies": ["backoff", {"header": {"x": 1}}]})
    assert d.domain == "a.com" and d.access_strategies == (("backoff", {}), ("header", {"x": 1})) and config.parse_domain({"domain": "b"}).access_strategies == (("backoff", {}),)
    for bad in ("backoff", [{"a": 1, "b": 2}], [3]):
        with pytest.raises(ValueError):
            config.parse_domain({"domain": "a", "access_strategies": bad})
    p = spark.createDataFrame([("https://a.com/x",), ("https://sub.a.com/",)], "url string")
    frame = config.domains_frame(spark, [d])
    assert config.authorized(p, frame).count() == 1 and config.refused(p, frame).first().url == "https://sub.a.com/"
    with pytest.raises(config.UnauthorizedDomain):
        config.assert_authorized("https://sub.a.com/", [d])


def test_safety():
    assert safety.violations("import re\nfrom urllib.parse import urljoin\nx = f'{1}'") == []
    assert safety.violations("import os") == ["import os"] and safety.violations("from urllib import request") == ["import urllib"] and safety.violations("e = eval") == ["name eval"]
    assert safety.violations("'{}'.format(1)") == ["attribute format"] and safety.violations("().__class__") == ["attribute __class__"] and safety.violations("x =") == ["syntax"]


def test_selectors(spark):
    html = '<div class="card"><h2>A <b>x</b></h2><a href="/1">l</a><br></div><div class="card big"><a href="/2">m</a></div><p class="card">no</p>'
    p = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string")
    got = [tuple(r) for r in html_select.extract(p, "div.card", {"title": "h2", "link": "a@href"}).orderBy("item_ix").collect()]
    assert got == [(1, 0, "A x", "/1"), (1, 1, None, "/2")]
    with pytest.raises(ValueError):
        html_select.extract(p, "div > a", {})


def test_fixtures_pair_by_name(spark):
    files = spark.createDataFrame([("f", "sample_1.html", "h"), ("f", "sample_1.json", "[]"), ("f", "sample_2.html", "h"), ("f", "other.json", "")], "family string, name string, body string")
    assert [tuple(r) for r in pages.pair_fixtures(files).collect()] == [("f", "sample_1", "h", "[]")]


def test_decide(spark):
    kind = "url string, family string, listed boolean, kind string, status int, marker string, used_version int, oracle_ok boolean"
    rows = [("1", "f", True, "ok", 200, None, 1, None), ("2", "f", True, "ok", 200, None, None, True), ("3", None, True, "ok", 200, None, None, False), ("4", None, True, "ok", 200, None, None, True), ("5", "f", False, "ok", 200, None, 1, True), ("6", "f", True, "blocked", 429, "rate", None, True)]
    got = {r.url: (r.failure, r.source, r.action) for r in decide(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"1": (None, "crawler", None), "2": ("drift", "oracle", "regenerate"), "3": (None, "none", "report"), "4": (None, "oracle", "bootstrap"), "5": ("refused", "none", "refuse"), "6": ("blocked_rate", "none", "recover_access")}


def test_loop_needs_oracles_and_reports(spark):
    samples = spark.createDataFrame([(i, json.dumps({"t": f"T{i}", "c": "C", "s": i})) for i in (1, 2, 3)], "page_id int, json string")
    truth = spark.createDataFrame([(i, 0, f"T{i}", "C", i * 10000) for i in (1, 2, 3)], "page_id int, item_ix int, title string, company string, salary int")
    good = {"title": {"path": ["t"], "transform": "none"}, "company": {"path": ["c"], "transform": "none"}, "salary": {"path": ["s"], "transform": "x10000"}}
    seen = []

    def propose(n, report):
        seen.append(report)
        return [good | {"salary": {"path": ["s"], "transform": "int"}}] if n == 1 else [good]

    done = run_loop(samples, truth, propose, schemas.get_schema("JobPosting"))
    assert done.ok and done.rounds == 2 and done.fieldmap == good and "candidate c0" in seen[1]
    few = run_loop(samples.limit(1), truth.where("page_id = 1"), propose, schemas.get_schema("JobPosting"))
    assert not few.ok and few.reason == "only 1 usable oracles"


def test_redirects(spark):
    hops = spark.createDataFrame([(f"https://a.com/{i}", f"https://a.com/{i + 1}") for i in range(9)] + [("https://a.com/x", "https://evil.com/")], "url string, location string")
    starts = spark.createDataFrame([("https://a.com/0",), ("https://a.com/5",), ("https://a.com/x",), ("https://b.com/",)], "url string")
    got = {r.start: (r.outcome, r.n_hops) for r in route.redirects(starts, hops, ["a.com"]).collect()}
    assert got["https://a.com/0"][0] == "too_many" and got["https://a.com/5"] == ("ok", 4) and got["https://a.com/x"][0] == "refused" and got["https://b.com/"] == ("refused", 0)


def test_stream_validates(spark, tmp_path):
    from loamwork.streaming.serve_stream import validate_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "t", "a", None), (1, None, "b", None)], "page_id int, text string, author string, url string").write.parquet(src)
    s = schemas.get_schema("Quote").project(["text", "author", "url"])
    stream = spark.readStream.schema("page_id int, text string, author string, url string").parquet(src)
    validate_stream(stream, s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().reason == "fill_rate:text"


def test_windowed_runs(spark):
    from loamwork.streaming.serve_stream import windowed_runs

    runs = spark.sql("select timestamp'2026-01-01 00:01:00' ts, 'f' family, true ok union all select timestamp'2026-01-01 00:04:00', 'f', false union all select timestamp'2026-01-01 00:06:00', 'f', true")
    assert sorted((r.runs, r.successes) for r in windowed_runs(runs).collect()) == [(1, 1), (2, 1)]


def test_serve_routes_extracts_and_fills(spark):
    from loamwork.plans.serve import serve

    p = spark.createDataFrame([(1, "https://a.com/p", "<div class='c'><b>A</b></div><div class='c'></div>"), (2, "https://b.com/", "<div class='c'><b>B</b></div>")], "page_id long, url string, html string")
    tails = spark.createDataFrame([(1, "fill", "x")], "page_id long, name string, extra string")
    got = serve(p, [("f", ["a.com"])], lambda d: html_select.extract(d, "div.c", {"name": "b"}), tails, ["name", "extra"])
    assert sorted((r.page_id, r.item_ix, r.name, r.extra) for r in got.collect()) == [(1, 0, "A", "x"), (1, 1, "fill", "x")]


def test_seeds_snapshots_and_files(spark, tmp_path):
    history = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, url string")
    assert [r.url for r in route.distinct_seeds(history, "c").orderBy("ord").collect()] == ["a", "b", "c"]
    fetched = spark.createDataFrame([("u", "old", 1), ("u", "new", 2)], "url string, html string, ord int")
    assert [(r.html, r.name[-5:]) for r in pages.snapshots(fetched).collect()] == [("new", ".html")]
    pages.append_jsonl(history, str(tmp_path / "log"))
    pages.append_jsonl(history, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    kind = "family string, sample string, html string, expected string"
    pages.save_fixtures(spark.createDataFrame([("f", "1", "h", "[]"), ("f", "2", "h", "[]"), ("g", "1", "h", "[]")], kind), str(tmp_path / "fx"))
    pages.save_fixtures(spark.createDataFrame([("f", "1", "h2", "[]")], kind), str(tmp_path / "fx"))
    assert sorted((r.family, r.html) for r in spark.read.parquet(str(tmp_path / "fx")).collect()) == [("f", "h2"), ("g", "h")]


def test_strategies(spark):
    attempts = spark.createDataFrame([("a", 1, 0, "s", "blocked"), ("a", 1, 1, "t", "ok"), ("a", 2, 0, "s", "ok"), ("b", 1, 0, "s", "error"), ("c", 3, 0, "s", "ok")], "domain string, round int, ord int, strategy string, kind string")
    got = {r.domain: (r.ok, r.strategy, r.rounds, r.status) for r in failure.recover(attempts).collect()}
    assert got == {"a": (True, "t", 1, "working"), "b": (False, None, 2, "escalated")}
    tries = spark.createDataFrame([("x", 1, "error", None), ("x", 2, "blocked", "rate"), ("x", 3, "ok", None), ("y", 1, "blocked", "auth"), ("z", 1, "error", None), ("z", 2, "error", None), ("z", 3, "error", None)], "request string, attempt int, kind string, marker string")
    assert {r.request: (r.used_attempt, round(r.waited_s, 3)) for r in failure.backoff(tries).collect()} == {"x": (3, 0.3), "y": (1, 0.0), "z": (3, 0.3)}


def test_active_residual_and_sources(spark):
    versions = spark.createDataFrame([("f", 1, "active", "{}", "x"), ("g", 1, "fallback", "{}", "x")], "family string, n int, status string, spec string, source_sha string")
    audit = spark.createDataFrame([(1, "promote", "f", 1, "old"), (2, "promote", "f", 1, "new"), (3, "other", "f", 1, "no")], "id long, event string, family string, to_version int, residual string")
    assert [tuple(r) for r in registry.active_residual(versions, audit).collect()] == [("f", 1, "new")]
    assert not versions.select(registry.verify_source(versions).alias("x")).first().x
