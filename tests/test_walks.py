"""Sampling of many families, provenance of records, limiter state over batches."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from loamwork.operators import route
from loamwork.streaming.serve_stream import slots_stream


def walked(pages, seeds, wanted, attempts):
    """One family, one URL at a time."""
    queue, tried, got = deque(dict.fromkeys(seeds)), [], []
    while queue and len(got) < wanted and len(tried) < attempts:
        url = queue.popleft()
        tried.append(url)
        if url in pages:
            got.append((len(got), len(tried), url))
            queue.extend(x for x in dict.fromkeys(pages[url]) if x not in tried and x not in queue)
    return got


@pytest.mark.parametrize("wanted,attempts", [(3, 12), (50, 9), (1, 1)])
def test_families_are_sampled_as_one_by_one(spark, wanted, attempts):
    url = lambda i: f"http://h/{i}"
    links = {i: [(i * 3 + 1) % 40, (i * 7 + 2) % 40, i, 100 + i, (i * 3 + 1) % 40] for i in range(40) if i % 6}
    pages = {url(i): [url(x) for x in own] for i, own in links.items()}
    rows = [(i, url(i), "".join(f'<a href="/{x}">x</a>' for x in own) + '<a href="http://other/1">o</a>') for i, own in links.items()]
    df = spark.createDataFrame(rows + [(900 + i, u, h) for i, u, h in rows[:3]], "page_id long, url string, html string")
    seeds = {"a": [5, 0, 5, 9], "b": [6, 12], "c": [1], "d": [200, 300], None: [7]}
    queue = spark.createDataFrame([(f, url(x), n) for f, own in seeds.items() for n, x in enumerate(own)], "family string, url string, ord int")
    got = {}
    for r in route.sample_families(df, queue.where("family is not null"), wanted, attempts).orderBy("family", "sample").collect():
        got.setdefault(r.family, []).append((r.sample, r.attempt, r.url))
    want = {f: walked(pages, [url(x) for x in own], wanted, attempts) for f, own in seeds.items() if f}
    assert got == {f: w for f, w in want.items() if w}


def test_records_know_the_pages_that_they_were_made_from(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i}") for i in range(6)], "page_id long, url string, html string")
    edges = spark.createDataFrame([("u0", "u1"), ("u1", "u2"), ("u2", "u0"), ("u4", "gone")], "url string, next_url string")
    walks = route.recorded(route.follow(pages.where("page_id in (0, 4)"), edges, 4), pages)
    records = spark.createDataFrame([("u0", 0, "a"), ("u0", 2, "b"), ("u4", 4, "c")], "start string, page_id long, name string")
    got = route.with_provenance(records, walks)
    # the cycle comes back to its first page, of which a record has then seen all
    assert {r.name: [s.page_id for s in r.seen] for r in got.collect()} == {"a": [0, 1, 2, 0], "b": [0, 1, 2], "c": [4]}
    assert all(len(s.sha) == 64 for r in got.collect() for s in r.seen)
    served = got.withColumn("family", F.when(F.col("start") == "u0", "f").otherwise("g"))
    due = spark.createDataFrame([("f", True), ("g", False)], "family string, due boolean")
    assert sorted((r.family, r.url) for r in route.snapshots_of(served, due, pages).collect()) == [("f", "u0"), ("f", "u1"), ("f", "u2")]


def test_slots_of_three_batches_are_those_of_one(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i) for i in range(60)] + [(None, 99)]
    kind = "host string, ord long"
    whole = {(r.host, r.ord): r.slot_s for r in route.rate_slots(spark.createDataFrame(rows, kind), 2.0).collect()}
    inbox = tmp_path / "in"
    for part in (rows[:25], rows[25:26], rows[26:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(inbox))
        slots_stream(spark.readStream.schema(kind).parquet(str(inbox)), str(tmp_path / "out"), str(tmp_path / "checkpoint"), 2.0).awaitTermination()
    got = {(r.host, r.ord): r.slot_s for r in spark.read.parquet(str(tmp_path / "out" / "slots")).collect()}
    assert got == whole and whole[("a", 1)] == 0.0 and max(v for (h, _), v in whole.items() if h == "a") == 19.5


def test_titles_keep_the_references_that_their_sql_keeps(spark, tmp_path):
    import duckdb

    from loamwork import catalogue

    titles = ["a&amp", "x = &quot;1&quot; &copy;", "&lt;b&gt;\t &amp;lt; z", None, "&nbsp;c d"]
    rows = [(i, "http://h/", f"<html><title>{t}</title><p>&amp;</p></html>" if t else None) for i, t in enumerate(titles)] + [(9, "http://h/", "<html><p>x</p></html>"), (10, "http://h/", "<title>alone</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.title) for r in catalogue.queries()["select_title"](spark, str(tmp_path)).collect())
    assert got == sorted(duckdb.sql(f"with pages as (from '{tmp_path}/pages.parquet/*.parquet') {catalogue.oracle_sql()['select_title']}").fetchall())
    assert dict(got)[0] == "a&amp" and dict(got)[1] == "x = &quot;1&quot; &copy;"


def test_provenance_tells_pages_of_one_url_apart(spark, tmp_path):
    import duckdb

    from loamwork import catalogue

    rows = [(i, f"http://h/{i % 5}", f"<p>{i}</p>") for i in range(16)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.start, r.page_id, r.seen) for r in catalogue.queries()["record_provenance"](spark, str(tmp_path)).select("start", "page_id", "seen").collect())
    sql = catalogue.oracle_sql()["record_provenance"].replace("WITH RECURSIVE ", f"WITH RECURSIVE pages AS (FROM '{tmp_path}/pages.parquet/*.parquet'), ", 1)
    assert got == sorted(duckdb.sql(sql).fetchall())
