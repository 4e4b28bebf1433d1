"""Learned operators: held-out accuracy and odd inputs; the pipeline against its own stages' rules."""

import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from loamwork.llm import quality, toxicity, weak
from tests.llm.test_exact import cut, empty, odd_documents, pairs_of

BIG = "/root/testdata/sf0.01"


def test_label_model_finds_accuracies_and_correlation():
    draw = np.random.default_rng(3)
    y = draw.random(20_000) < 0.3
    fires = lambda hit, miss: np.where(y, draw.random(len(y)) < hit, draw.random(len(y)) < miss)
    a, b, c = fires(0.9, 0.05), fires(0.6, 0.1), fires(0.8, 0.02)
    d = np.where(draw.random(len(y)) < 0.95, b, ~b)
    votes = a + 2 * b + 4 * c + 8 * d
    m = weak.LabelModel([1, 1, 1, 1]).fit(np.bincount(votes, minlength=16).astype(float))
    assert m.prior == pytest.approx(0.3, abs=0.06) and m.rates[1][0] == pytest.approx(0.9, abs=0.08) and m.rates[1][2] == pytest.approx(0.8, abs=0.08)
    assert m.correlation[1, 3] > 0.5 > abs(m.correlation[0, 2]) and m.weight[1] < 0.8 < m.weight[0]
    assert ((m.posterior()[votes] > 0.5) == y).mean() > 0.93
    assert weak.LabelModel([1, -1]).fit(np.zeros(4)).posterior().shape == (4,)


def test_linear_scorer_learns_and_is_sparse():
    rows = [(np.array([1, 5 + i % 50]), np.array([1.0, 1.0])) if i % 2 else (np.array([2, 5 + i % 50]), np.array([1.0, 1.0])) for i in range(400)]
    w, b = weak.fit_linear(rows, np.array([i % 2 for i in range(400)], float), 64, 1e-3)
    assert w[1] + b > 1 > -1 > w[2] + b and np.abs(w[5:55]).max() < 0.8
    assert weak.fit_linear([], np.zeros(0), 8, 0.1)[1] == 0.0


def test_linear_fit_holds_few_bytes_a_cell():
    """The driver fits on millions of cells: beside the rows it keeps 8 bytes for each, not several copies."""
    draw = np.random.default_rng(1)
    rows = [(np.unique(draw.integers(0, 3000, 300)).astype(np.uint16), np.ones(300, np.float32)) for _ in range(4000)]
    rows = [(f, v[: len(f)]) for f, v in rows]
    cells = sum(len(f) for f, _ in rows)
    tracemalloc.start()
    try:
        weak.fit_linear(rows, draw.random(4000), 4096, 1e-5, rounds=2)
        assert tracemalloc.get_traced_memory()[1] < 20 * cells
    finally:
        tracemalloc.stop()


def test_quality_sample_comes_packed_and_in_one_order(spark, monkeypatch):
    """A row for each block of texts; the fit is the same however the rows are dealt."""
    docs, seen, own = spark.read.parquet(f"{BIG}/documents.parquet").where("doc_id < 300"), [], quality.unpacked
    monkeypatch.setattr(quality, "unpacked", lambda packed: seen.append((len(packed), own(packed))) or seen[-1][1])
    one, other = quality.fit(docs.coalesce(1)), quality.fit(docs.repartition(3))
    assert [n for n, _ in seen] == [1, 3] and len(seen[0][1][1]) == docs.count()
    assert all((a == b).all() for x, y in zip(seen[0][1][1], seen[1][1][1]) for a, b in zip(x, y))
    assert (one["weights"] == other["weights"]).all() and one["bias"] == other["bias"]


def test_quality_scores_look_each_word_up_once(monkeypatch):
    """A score is the sum of its features' weights, from one weight a distinct word, though the table forgets."""
    weights = np.random.default_rng(2).normal(size=quality.SIZE).astype(np.float32)
    made, own = [], quality.hashed
    monkeypatch.setattr(quality, "hashed", lambda word: made.append(word) or own(word))
    texts = ["One two, two THREE three. " * 40, "日本語 の 文章 です。", "x" * 500, "a1 b2\nc3", "", None]
    for most in (200_000, 2):
        table, found = quality._Worth(weights, most), []
        for text in texts:
            found.append(quality.worth(*quality.traits(text), table))
        if most > 2:
            assert sorted(made) == sorted({w for t in texts for w in (t or "").split()})
        assert len(table) <= most
        for text, x in zip(texts, found):
            f, v = quality.features(*quality.traits(text), quality._Shapes())
            assert x == pytest.approx(float(weights[f].astype(float) @ v), abs=1e-5)


def test_quality_against_labels(spark):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{BIG}/labels.parquet'").fetchall())
    got = Counter((labels[r.doc_id], r.predicted) for r in quality.op4_quality(spark, BIG).collect() if r.doc_id in labels)
    assert got[1, 1] / (got[1, 1] + got[1, 0]) > 0.98 and got[0, 0] / (got[0, 0] + got[0, 1]) > 0.9


def test_quality_of_odd_documents(spark):
    df = odd_documents(spark)
    rows = quality.classify(df).collect()
    assert len(rows) == df.count() and all(0 <= r.quality_score <= 1 and r.predicted == int(r.quality_score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].quality_score == by[4].quality_score == by[5].quality_score and quality.classify(empty(spark)).count() == 0


def test_toxicity_against_held_out_labels(spark):
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{BIG}/labels.parquet'").fetchall())
    rows = toxicity.op7_toxicity(spark, BIG).collect()
    got = Counter((labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels)
    assert got[1, 1] >= 0.6 * (got[1, 1] + got[1, 0]) and got[0, 1] <= 0.02 * (got[0, 0] + got[0, 1])


def test_toxicity_of_odd_documents(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0), (None, 1, 1), (3, 1, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false")):
        rows = toxicity.classify(df, some, "doc_id % 3 = 1").collect()
        assert len(rows) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        by = {r.doc_id: r for r in rows if r.doc_id is not None}
        assert by[3].score == by[4].score and by[1].held_out and not by[2].held_out
    assert toxicity.classify(empty(spark), labels, "false").count() == 0


def test_samples_are_bounded_though_rows_repeat(spark, monkeypatch):
    """Many equal rows, or many rows of one key, don't fill the samples that come to the driver."""
    sizes, own = [], (quality.fit_linear, toxicity.fit_linear)
    monkeypatch.setattr(quality, "fit_linear", lambda rows, *a, **k: sizes.append(len(rows)) or own[0](rows, *a, **k))
    monkeypatch.setattr(toxicity, "fit_linear", lambda rows, *a, **k: sizes.append(len(rows)) or own[1](rows, *a, **k))
    docs = spark.read.parquet(f"{BIG}/documents.parquet").where("doc_id < 200").select("doc_id", "text")
    equal = spark.range(20_000).selectExpr("7L as doc_id", "'one text that is in the table very often' as text")
    model = quality.fit(docs.union(equal))
    assert sizes.pop() <= 201 and model["labels"].prior > 0
    # without a share, each row is sampled: the many equal ones once
    model = quality.fit(docs.union(equal), fit_rows=30_000)
    assert sizes.pop() == 201
    many = spark.range(20_000).selectExpr("7L as doc_id", "concat('you are an idiot ', id) as text")
    labels = spark.createDataFrame([(i, int(i == 7)) for i in range(100)], "doc_id long, toxic int")
    for rows in (docs.union(many), docs.union(many).repartition(5)):
        model = toxicity.fit(rows, labels, "true")
        assert sizes[-2:] == [200, 200]
        sizes.append(model["bias"])
    assert sizes[2] == sizes[5]


def test_pipeline_stages_keep_their_rules(spark, sf, tmp_path):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(i))
        stage(spark, docs, sf).write.parquet(out)
        kept.append((docs, docs := spark.read.parquet(out)))
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    assert all(b.columns == a.columns for a, b in kept[:-1])
    before, after = map(texts, kept[1])
    assert sorted(i for i, _ in after) == sorted({c for _, c, _ in pairs_of(before)})
    before, after = texts(kept[2][0]), dict(texts(kept[2][1]))
    for k, n, gone, _ in cut(before):
        if gone == n and n:
            assert k not in after
        elif gone:
            assert len(after[k].split(" ")) == n - gone
        else:
            assert after[k] == dict(before)[k]
    before, after = Counter(texts(kept[3][0])), Counter(texts(kept[3][1]))
    assert set(after) <= set(before) and max(after.values()) <= 3
    assert Counter(i for i, _ in texts(kept[4][0])) == Counter(r.doc_id for r in kept[4][1].collect())
    assert corpus_pipeline.run(spark, sf).count() == kept[4][1].count()


def test_traits_of_other_scripts_and_of_whole_words():
    for text in ("日本語の文章です。" * 20, "한국어 문장 입니다 " * 20, "中文文本，没有空格。" * 30, "𠀀𠀁𠀂" * 40):
        t = quality.traits(text)[1]
        assert t["letters"] > 0.75 and t["symbols"] == 0
    assert quality.traits("→★♦" * 9)[1]["symbols"] == 1.0
    assert quality.shape("a" * 30 + "B" * 9 + "7") == "aA0"


def test_scores_by_hand(spark):
    """Scores of both classifiers from their fitted weights."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").where("doc_id < 400")
    m = quality.fit(docs)
    got = docs.select("text", quality.scorer(spark, m)("text").alias("s")).collect()
    for r in got[:60]:
        f, v = quality.features(*quality.traits(r.text), quality._Shapes())
        assert abs(r.s - 1 / (1 + np.exp(np.clip(m["bias"] + float(m["weights"][f] @ v), -40, 40)))) < 1e-5
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    m = toxicity.fit(docs, labels, "doc_id % 3 <> 1")
    got = docs.select("text", toxicity.scorer(spark, m)("text").alias("s")).collect()
    for r in got[:60]:
        f, v = toxicity.features(toxicity.distinct(r.text), toxicity._Words(toxicity.word_features))
        assert abs(r.s - 1 / (1 + np.exp(-np.clip(m["bias"] + float(m["weights"][f] @ v), -40, 40)))) < 1e-5


def test_pipeline_stages_take_odd_documents(spark):
    """Rows, not counts: nulls, repeated rows, different texts under one key, clashing and unordered further columns."""
    passage = " ".join(f"p{i}" for i in range(30))
    some = [(1, passage + " first one here with more words of its own than few", "a"), (1, "an unrelated text under the same key, of enough words to stand alone", "a"), (2, passage + " second one here with other words that only it has got", None), (3, None, "b"), (3, None, "b"), (None, "no key at all", "b"), (4, "", "a"), (5, "dup dup text of its own.", "a"), (5, "dup dup text of its own.", "a")]
    rows = [(i, t, s, len(t or ""), {"k": n}, n, "x", "y", "z", "w") for n, (i, t, s) in enumerate(some)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, extra map<string,int>, count int, _id string, digest string, cut string, key string")
    shown = lambda d: sorted((repr((r.doc_id, r.text)) for r in d.collect()))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, df, "")
    assert good.columns == df.columns and set(shown(good)) <= set(shown(df))
    one = stages["n-gram Jaccard join"](spark, df, "")
    texts = [(i, t) for i, t, _ in some]
    assert one.columns == df.columns and shown(one) == sorted(map(repr, [x for x in dict.fromkeys(texts) if x != (4, "")]))
    cut_ = stages["substring dedup"](spark, df, "")
    assert cut_.columns == df.columns and shown(cut_) == sorted(repr((i, "second one here with other words that only it has got" if i == 2 else t)) for i, t in texts)
    mixed = stages["mixing sources"](spark, df, "")
    took = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    assert mixed.columns == df.columns and set(took) <= set(some) and all(n <= 3 * some.count(x) for x, n in took.items())
    assert sum(n * len((x[1] or "").split()) for x, n in took.items()) <= sum(len((t or "").split()) for _, t in texts)
    assert Counter(r.doc_id for r in stages["byte-level BPE"](spark, df, "").collect()) == Counter(i for i, _ in texts)
    for stage in stages.values():
        assert stage(spark, df.where("false"), "").count() == 0


def test_pipeline_cuts_texts_once(spark):
    """The filter on what is left of a text doesn't cut it again, which took a second Python worker for each core."""
    df = spark.createDataFrame([(1, "a b c", "s", 5)], "doc_id long, text string, source string, n_chars long")
    plan = dict(corpus_pipeline.STAGES)["substring dedup"](spark, df, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
