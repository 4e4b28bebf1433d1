"""The command line over a store: loop, requests, rollback, domains."""

import json

import pytest

from loamwork import cli
from loamwork.operators.registry import IntegrityError
from loamwork.sources.store import TABLES, Change, Store
from pyspark.sql import functions as F

SPEC = {"text": {"path": ["t"], "transform": "none"}, "author": {"path": ["a"], "transform": "none"}}


def test_a_family_is_regenerated_served_and_rolled_back(spark, tmp_path, capsys):
    root = str(tmp_path / "registry")
    run = lambda *a: (cli.main([root, *a], spark), capsys.readouterr().out.splitlines())
    store = Store(spark, root)
    store.update(lambda s: Change({"families": spark.createDataFrame([("q", ["/q/"], "Quote@1", "healthy", "t")], TABLES["families"])}))
    pages = [(i, f"https://h/q/{i}", json.dumps({"t": f"text {i}", "a": f"by {i % 2}"})) for i in range(4)]
    spark.createDataFrame([("q", *p) for p in pages], "family string, page_id long, url string, json string").write.parquet(str(tmp_path / "samples"))
    spark.createDataFrame([("q", i, 0, f"text {i}", f"by {i % 2}") for i in range(4)], "family string, page_id long, item_ix int, text string, author string").write.parquet(str(tmp_path / "truth"))
    spark.createDataFrame([("q", "default", 1, 0, json.dumps(SPEC))], "family string, model string, round int, ord int, spec string").write.parquet(str(tmp_path / "answers"))
    code, out = run("loop", "run", "--schema", "Quote", "--samples", str(tmp_path / "samples"), "--truth", str(tmp_path / "truth"), "--answers", str(tmp_path / "answers"), "--json")
    assert code == 0 and json.loads(out[0])["phase"] == "promoted" and json.loads(out[0])["version"] == 1

    asked = spark.createDataFrame([(i, u, j if i else "{}", "ok", 200, None, True) for i, u, j in pages], "page_id long, url string, json string, kind string, status int, marker string, listed boolean")
    asked.write.parquet(str(tmp_path / "pages"))
    code, out = run("request", "--schema", "Quote", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "served"), "--json")
    assert {(x.get("source"), x.get("failure"), x["pages"]) for x in map(json.loads, out)} == {("crawler", None, 3), ("none", "drift", 1)}
    assert {r.record.text for r in spark.read.parquet(str(tmp_path / "served")).where("source = 'crawler'").collect()} == {"text 1", "text 2", "text 3"}

    assert run("family", "rollback", "q")[0] == 1  # nothing to roll back to
    one = store.read().table("versions")
    store.update(lambda s: Change({"versions": one.unionByName(one.withColumns({"n": F.lit(2), "status": F.lit("fallback")}))}))
    code, out = run("family", "rollback", "q", "--json")
    assert code == 0 and [(x["n"], x["status"]) for x in map(json.loads, out)] == [(2, "active"), (1, "archived")]
    code, out = run("family", "activate", "q", "1", "--json")
    assert [(x["n"], x["status"]) for x in map(json.loads, out)] == [(1, "active"), (2, "fallback")] and run("family", "activate", "q", "7")[0] == 1
    assert json.loads(run("family", "status", "q", "degraded", "--json")[1][0])["status"] == "degraded" and run("family", "show", "none")[0] == 1
    assert [json.loads(x)["event"] for x in run("audit", "q", "--json")[1]] == ["activate", "rollback", "promote"]
    assert len(run("loop", "show", "q")[1]) == 2 and len(run("loop", "show", "z")[1]) == 1

    store.update(lambda s: Change({"versions": s.table("versions").withColumn("spec", F.lit("{}"))}))
    with pytest.raises(IntegrityError):
        run("request", "--schema", "Quote", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "again"))


def test_domains(spark, tmp_path, capsys):
    pytest.importorskip("yaml")
    run = lambda *a: (cli.main([str(tmp_path / "r"), *a], spark), capsys.readouterr().out.splitlines())
    (tmp_path / "d.yaml").write_text("domains:\n  - domain: b.com\n    max_rps: 2\n  - domain: A.com\n    access_strategies: [backoff, {session: {x: 1}}]\n")
    assert [json.loads(x)["domain"] for x in run("domain", "list", str(tmp_path / "d.yaml"), "--json")[1]] == ["a.com", "b.com"]
    assert json.loads(run("domain", "check", str(tmp_path / "d.yaml"), "https://a.com/x", "--json")[1][0])["allowed"] and not json.loads(run("domain", "check", str(tmp_path / "d.yaml"), "https://c.com/x", "--json")[1][0])["allowed"]
    (tmp_path / "bad.yaml").write_text("domains:\n  - domain: b.com\n    access_strategies: [unheard_of]\n")
    with pytest.raises(ValueError, match="unheard_of"):
        run("domain", "list", str(tmp_path / "bad.yaml"))
