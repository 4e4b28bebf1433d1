"""Operators that a brute-force version, tiktoken or DuckDB can settle exactly."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from loamwork.llm import ann, byte_bpe, catalogue, class_lm, common, mixing, near_dup, order_minhash, sharding, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
KIND = "doc_id long, text string, source string, id string, digest string, node string, words string, size int, bytes int, ids string"


def odd_documents(spark):
    """Null and empty texts, null keys and sources, repeated rows, copies, long texts, clashing column names."""
    texts = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, ""), (5, " \t\n"), (None, "one two three four five six"), (None, None), (6, LONG), (7, LONG + " tail"), (8, "x " + PASSAGE + " y"),
             (9, PASSAGE + " " + PASSAGE), (10, "ÀÉ 你好 😀 " + PASSAGE[:40]), (11, "word"), (12, "be " * 50), (13, "be " * 50 + "not"), (14, " nbsp x\x0bvt\x0cff")]
    rows = [(i, t, None if k % 5 == 0 else f"s{k % 3}", "i", "d", "n", "w", 1, 2, "z") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def corpus(sf):
    return duckdb.sql(f"select doc_id, text, source from '{sf}/documents.parquet' order by doc_id").fetchall()


def pairs_of(docs):
    """Brute-force classes and links of (key, text) rows."""
    sets = []
    for _, t in docs:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links, root = Counter(), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            same = (docs[i][1] or "") == (docs[j][1] or "")
            k = len(sets[i] & sets[j])
            if same or (k and k >= 0.8 * len(sets[i] | sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(docs):
        least[find(i)] = min(k, least.get(find(i), k))
    return [(k, least[find(i)], links[i]) for i, (k, _) in enumerate(docs)]


def test_near_duplicates_equal_brute_force(spark, sf, corpus):
    got = Counter(tuple(r) for r in catalogue.queries()["op1_ngram_jaccard"](spark, sf).collect())
    assert got == Counter(pairs_of([(i, t) for i, t, _ in corpus]))


def test_near_duplicates_of_odd_documents(spark):
    df = odd_documents(spark)
    got = Counter(tuple(r) for r in near_dup.near_duplicates(df).collect())
    want = pairs_of([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None])
    assert got == Counter(want) + Counter({(None, None, 0): 2})
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_a_large_group_of_near_copies_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 7)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join([*base[: i % 100], f"new{i}", *base[i % 100 + 1 :]])) for i in range(60)]
    got = sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(pairs_of(docs))


def test_prefixes_shorten_by_what_the_sample_shows():
    """No links: what theory finds at the threshold. Many links found deep: longer prefixes. Links missed there: shorter."""
    assert near_dup.shortened({}, 20, 0.8, 0.999) == 5 and near_dup.shortened({}, 20, 0.95, 0.999) > 12 and near_dup.shortened({}, 1, 0.1, 0.9999) == 1
    deep = {(k, 16): 100_000 for k in range(4)}
    assert near_dup.shortened(deep, 20, 0.8, 0.9995) > 5
    assert near_dup.shortened({**deep, (0, 4): 500}, 20, 0.8, 0.9995) == 4


def test_no_table_lengthens_the_prefix_that_finds_a_pair_at_the_threshold(spark, monkeypatch):
    """3,540 links of one kind, all shared deep, are no reason to look less closely at others."""
    base, depths, own = [f"w{i}" for i in range(120)], [], near_dup.companions
    docs = [(i, " ".join([*base[: i + 20], f"new{i}", *base[i + 21 :]])) for i in range(60)]
    monkeypatch.setattr(near_dup, "companions", lambda nodes, trees, depth, parts: depths.append(depth) or own(nodes, trees, depth, parts))
    got = sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert depths == [5] and got == sorted(pairs_of(docs))


def test_small_trie_nodes_are_shortened_by_all_texts(spark):
    """A node of few texts is met by 3 values, a larger one by 4 or 5; where a node may go on elsewhere, by 5."""
    made = lambda *v: np.array([*v, *range(900, 916 - len(v))], ">u2").tobytes()
    first, last, pair = [made(0, 0, 0, 0, 1), made(0, 0, 0, 0, 2)], [made(9, 9, 9, 9, 1), made(9, 9, 9, 9, 2)], [made(1, 2, 3, 4, 5), made(1, 2, 3, 6, 7)]
    large = [made(5, 5, 5, k // 2, k) for k in range(40)]
    labels = first + pair + large + last
    nodes = spark.createDataFrame([(i.to_bytes(2, "big"), f) for i, f in enumerate(labels)], "digest binary, forest binary")
    met = Counter(bytes(r.prefix) for r in near_dup.companions(nodes, 1, 5, 1).collect())
    assert {k: n for k, n in met.items() if n > 1} == {pair[0][:6]: 2} | {f[:8]: 2 for f in large}
    assert near_dup._levels(np.array([0, 4, 4, 0]), 5, 2).tolist() == [5] * 5 and near_dup._levels(np.array([0, 4, 4, 0]), 5, 3).tolist() == [5, 3, 3, 3, 5]


def test_tries_and_ties_of_texts_that_share_boilerplate(spark, monkeypatch):
    """A common half makes texts share trie nodes, not groups; nodes that lie across tasks are found whole."""
    common_half = [f"c{i}" for i in range(60)]
    docs = [(i, " ".join(common_half + [f"own{i}x{j}" for j in range(60)])) for i in range(120)]
    docs += [(1000 + i, " ".join(common_half + [f"own{i}x{j}" for j in range(59)])) for i in range(0, 120, 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dup.near_duplicates(df).collect())
    assert got == sorted(pairs_of(docs))
    rows = near_dup.sketches(df.selectExpr("doc_id id", "text text_body"), 5, 20)
    for parts in (1, 7):
        met = near_dup.companions(rows, 20, 3, parts)
        shared = Counter((r.tree, bytes(r.prefix)) for r in met.collect())
        labels = [np.frombuffer(r.forest, ">u2").reshape(20, 16)[:, :3] for r in rows.collect()]
        want = Counter((t, x[t].tobytes()) for x in labels for t in range(20))
        assert {k: n for k, n in shared.items() if n > 1} == {k: n for k, n in want.items() if n > 1}
    edges = near_dup.ties(rows, near_dup.companions(rows, 20, 3, 4), 20, 0.8, 4)
    assert max(Counter(r.root for r in common.components(edges).collect()).values()) <= 4
    monkeypatch.setattr(near_dup, "RUN", 2)
    assert sorted(tuple(r) for r in near_dup.near_duplicates(df).collect()) == got


def test_different_texts_under_one_key_are_documents_of_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (1, a)], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_duplicates(df).collect()) == [(1, 1, 1)] * 3 + [(2, 1, 1)]
    twenty = " ".join(f"t{i}" for i in range(20))
    rows = substring_dedup.cut_repeats(spark.createDataFrame([(1, twenty + " x"), (1, twenty + " y")], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in rows) == [0, 20]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut(docs, size=20):
    """Brute-force (key, n_words, n_removed, sha) of rows in order of key; equal rows are one document."""
    seen, done = {}, {}
    for k, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in seen:
                gone.update(range(i, i + size))
            seen[tuple(w[i : i + size])] = True
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        done[k, t] = (k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return Counter(done[d] for d in docs)


def test_substring_dedup_equals_brute_force(spark, sf, corpus):
    assert Counter(tuple(r) for r in catalogue.queries()["op3_substring_dedup"](spark, sf).collect()) == cut([(i, t) for i, t, _ in corpus])


def test_substring_dedup_of_odd_documents(spark):
    df = odd_documents(spark)
    found = substring_dedup.cut_repeats(df)
    got = Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())
    assert got == cut([(r.doc_id, r.text) for r in df.collect()])
    spans = {r.doc_id: r.spans for r in found.where("doc_id in (8, 9)").collect()}
    assert spans[8] == [] and spans[9] == [[0, 120]] or spans[9][0][0] == 0
    assert substring_dedup.cut_repeats(empty(spark)).count() == 0


def test_repeats_of_a_bucket_hold_little_of_windows_that_occur_once():
    """Of 400,000 windows in 40 blocks, of which few repeat, hashes are held, not texts and starts."""
    draw, packed, want = np.random.default_rng(4), [], []
    for k in range(40):
        ids, digests, doc = np.arange(k, k + 2, dtype=np.int64), np.array([7, 9], np.int64), np.repeat([0, 1], 5_000)
        start = np.r_[np.arange(5_000), np.arange(5_000)]
        h = draw.integers(0, 2**63, 10_000).astype(np.uint64)
        h[7] = 5
        want.append((k, 7, 7))
        packed.append(substring_dedup._pack(k, h, ids, digests, doc, start)[1:])
    tracemalloc.start()
    try:
        found = substring_dedup._repeats(packed)
        assert tracemalloc.get_traced_memory()[1] < 40 * 400_000
    finally:
        tracemalloc.stop()
    assert sorted(zip(*(x.tolist() for x in found))) == want[1:]
    assert substring_dedup._repeats(packed[:1]) is None


def test_intervals_merge():
    assert substring_dedup.intervals(np.array([0, 1, 5, 26, 47]), 20).tolist() == [0, 25, 26, 46, 47, 67]
    assert substring_dedup.intervals(np.array([0, 20, 41]), 20).tolist() == [0, 40, 41, 61] and not len(substring_dedup.intervals(np.zeros(0, int), 20))


@pytest.fixture(scope="module")
def coder():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, sf, corpus, coder):
    got = {r.doc_id: tuple(r)[1:] for r in catalogue.queries()["op5_byte_bpe"](spark, sf).collect()}
    for i, t, _ in corpus:
        ids = coder[1].encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_of_odd_documents(spark, coder):
    df = odd_documents(spark)
    coded = byte_bpe.decode(byte_bpe.encode(df, coder[0], public_tokenizers.PATTERN), coder[0])
    got = Counter((r.doc_id, tuple(r["ids"]), bytes(r.decoded)) for r in coded.collect())
    assert got == Counter((r.doc_id, tuple(coder[1].encode_ordinary(r.text or "")), (r.text or "").encode()) for r in df.collect())
    assert byte_bpe.encode(empty(spark), coder[0], public_tokenizers.PATTERN).count() == 0


def test_bpe_replay_and_long_parts(coder, monkeypatch):
    words = ["a" * n for n in range(1, 80)] + ["", "ab" * 300, "é" * 33, " hello", "mississippi" * 9, "\n \t " * 40]
    texts = [*words, None, " ".join(words), LONG[:30_000]]
    merges = byte_bpe.Merges(coder[0])
    for most, at_once in ((1_500_000, 900_000), (300, 100)):
        monkeypatch.setattr(byte_bpe, "REPLAY_BYTES", most)
        codes, new = byte_bpe.cut(texts, regex.compile(public_tokenizers.PATTERN), coder[0], at_once)
        ids = [np.frombuffer(x, np.int32) for x in byte_bpe.replayed(new, merges)]
        assert len(set(new)) == len(new) and not set(new) & set(coder[0])
        flat, end = byte_bpe.fill(np.concatenate(codes), np.concatenate(ids), np.array([len(x) for x in ids]))
        ends = np.r_[0, np.r_[0, end][np.cumsum([len(c) for c in codes])]]
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [coder[1].encode_ordinary(t or "") for t in texts]


def test_bpe_over_many_blocks_and_decoding_beside_a_column_of_that_name(spark, coder, monkeypatch):
    draw = np.random.default_rng(8)
    texts = [(i, " ".join(f"q{draw.integers(0, 500)}zx" for _ in range(40)) + " shared-passage " * 3) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 1_000)
    coded = byte_bpe.encode(df, coder[0], public_tokenizers.PATTERN)
    assert {r.doc_id: r["ids"] for r in coded.collect()} == {i: coder[1].encode_ordinary(t) for i, t in texts}
    again = byte_bpe.decode(coded.withColumn("decoded", F.lit("own")), coder[0])
    assert again.columns == ["doc_id", "ids", "decoded", "_decoded"] and all(bytes(r[3]).decode() == texts[r[0]][1] and r[2] == "own" for r in again.collect())


def test_bpe_fills_a_block_in_parts(coder):
    """A block of 2 million codes: its batches and what is held beside them stay small."""
    draw, size = np.random.default_rng(14), [300] * 3_000 + [0, 100_000] + [100] * 10_000
    codes, known = draw.integers(0, 50_000, sum(size)).astype(np.int32), draw.integers(0, 50_000, 9).astype(np.int32)
    hole = draw.random(len(codes)) < 0.05
    codes[hole] = byte_bpe.HOLE + draw.integers(0, 4, hole.sum())
    texts = pa.table({"body": [byte_bpe._pack(codes)], "ends": [byte_bpe._pack(np.array(size))], "keys": [list(range(len(size)))]})
    found = pa.table({"first": [0], "ids": [byte_bpe._pack(known)], "many": [byte_bpe._pack(np.array([2, 0, 3, 4]))]})
    run = byte_bpe._joining(SimpleNamespace(value=coder[0]), "doc_id", pa.int64(), True)
    tracemalloc.start()
    try:
        out = run(texts, found)
        assert tracemalloc.get_traced_memory()[1] < 75_000_000
    finally:
        tracemalloc.stop()
    assert max(len(pc.list_flatten(b.column(1))) for b in out.to_batches()) < 700_000
    token, pieces, at = {r: t for t, r in coder[0].items()}, np.split(known.tolist(), [2, 2, 5]), 0
    assert out.column("doc_id").to_pylist() == list(range(len(size)))
    for n, ids, raw in zip(size, out.column("ids"), out.column("decoded")):
        want = [y for x in codes[at : at + n].tolist() for y in (pieces[x - byte_bpe.HOLE].tolist() if x >= byte_bpe.HOLE else [x])]
        assert ids.as_py() == want and raw.as_py() == b"".join(map(token.__getitem__, want))
        at += n


def rowset(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = catalogue.queries()[name](spark, sf)
    found = c.execute(catalogue.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(n) for n in df.columns]
    assert rowset(df) == sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("limit", [1, 300, 100_000, 1 << 40])
def test_shards_fit_and_are_prefix_free(spark, limit):
    df = odd_documents(spark).union(odd_documents(spark)).union(spark.createDataFrame([(i, "t" * (i % 90), None, "", "", "", "", 0, 0, "") for i in range(300)], KIND))
    rows = sharding.shards(df, limit).collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for name, own in by.items():
        assert {(r.shard_bytes, r.shard_docs, r.depth) for r in own} == {(sum(r.bytes for r in own), len(own), len(name))}
        assert sum(r.bytes for r in own) <= limit or len(own) == 1
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert sharding.shards(empty(spark), limit).count() == 0


def test_shards_written_keep_rows(spark, tmp_path):
    df = odd_documents(spark)
    sharding.write_shards(df, str(tmp_path / "s"), 400)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(repr, back.select("doc_id", "text").collect())) == sorted(map(repr, df.select("doc_id", "text").collect()))


def test_mix_of_odd_documents(spark):
    df = odd_documents(spark)
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == df.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    total = sum(r["size"] for r in rows)
    own, want, got = Counter(), {}, Counter()
    for r in rows:
        own[r.source] += r["size"]
        want[r.source] = r.target
        got[r.source] += r.taken
    assert all(r.source_size == own[r.source] for r in rows) and all(want[s] <= 3 * own[s] + 1e-6 for s in own)
    assert sum(want.values()) == pytest.approx(total) and sum(got.values()) <= total
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_mix_comes_near_targets(spark, sf):
    rows = catalogue.queries()["op10_weighted_fair_mix"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("longest")).collect()
    assert all(abs(r.taken - r.target) <= 2 * r.longest for r in rows)


def test_fingerprints_of_documents(spark, sf, corpus):
    got = {r.doc_id: r for r in catalogue.queries()["op2_order_minhash"](spark, sf).collect()}
    back = corpus[::-1]
    for k, (i, t, _) in enumerate(back):
        after, n, r = back[(k + 1) % len(back)], len(t), got[i]
        edited = t[: n - n // 3] + after[1][: n // 3]
        parts = lambda x: [x[j : j + 8] for j in range(0, 256, 8)]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == pytest.approx(np.mean([a == b for a, b in zip(parts(r.fingerprint), parts(got[after[0]].fingerprint))]))
        assert r.near_edited == pytest.approx(np.mean([a == b for a, b in zip(parts(r.fingerprint), parts(r.edited_fingerprint))]))
    assert np.mean([r.near_edited for r in got.values()]) > 0.15 > np.mean([r.near_next for r in got.values()])
    texts = {}
    assert all(texts.setdefault(t, got[i].fingerprint) == got[i].fingerprint for i, t, _ in corpus)


def test_fingerprints_of_odd_documents(spark):
    df = odd_documents(spark)
    rows = order_minhash.fingerprints(df).collect()
    assert len(rows) == df.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].fingerprint == by[4].fingerprint == "0" * 256 and by[1].fingerprint == by[2].fingerprint and by[5].fingerprint == "0" * 256
    assert len({by[i].fingerprint for i in (9, 12, 14)}) == 3
    assert by[7].near_next > 0.9, by[7].near_next
    one = order_minhash.fingerprints(df.where("doc_id = 10")).first()
    assert one.near_next == 1.0 and order_minhash.fingerprints(empty(spark)).count() == 0


def test_fingerprints_know_order_and_repetition(spark):
    w = [f"w{i}" for i in range(300)]
    texts = [(1, " ".join(w)), (2, " ".join(w[150:] + w[:150])), (3, " ".join(w[:270])), (4, " ".join(w + w))]
    df = spark.createDataFrame(texts, "id long, body string").withColumn("n", F.col("id"))
    sig = {r.id: r.sig for r in order_minhash.signatures(df, ["id", "n"], "body", 256, 2).collect()}
    near = lambda a, b: np.mean([x == y for x, y in zip(sig[a], sig[b])])
    assert near(1, 3) > near(1, 2) > 0.2 and near(1, 3) > 0.7 and 0.05 < near(1, 4) < 0.6


def order_minhash_plainly(text, tuples=32, k=2):
    """The tuples of a text as (first k-mer, its occurrence number, second, its number), by a sort of all k-mers; hashes
    and permutations are the operator's, by Spark's own xxhash64 over a table of the k-mers."""
    items = [x for w in WORD.findall(text) for x in ([" " + c for c in w] if len(w) > 24 else [w])]
    grams = [tuple(items[i : i + (8 if items[i][0] == " " else k)]) for i in range(max(1, len(items) - k + 1))] if items else []
    seen = Counter()
    return [(g, seen.update([g]) or seen[g] - 1, i) for i, g in enumerate(grams)]


def test_order_minhash_equals_a_plain_one(spark):
    texts = ["a b c d a b c a b", "x", "", "one two", " ".join(f"w{i % 37}" for i in range(400)), "d c b a", "b c d a b c a b a", "y" * 24 + " " + "y" * 25 + " a b", "".join(chr(0x4E00 + i * i % 50) for i in range(90)), "z" * 31]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = {r.id: r.sig for r in order_minhash.signatures(df, ["id"], "body", 32, 2).collect()}
    grams = sorted({g for t in texts for g, _, _ in order_minhash_plainly(t)})
    of = {len(g): spark.createDataFrame([list(x) for x in grams if len(x) == len(g)], ", ".join(f"w{j} string" for j in range(len(g)))) for g in grams}
    first = {tuple(r)[:-1]: r.h for n, d in of.items() for r in d.select("*", F.xxhash64(*d.columns).alias("h")).collect()}
    low = order_minhash.LOW
    need = sorted({(first[g] & ~low, n) for t in texts for g, n, _ in order_minhash_plainly(t) if n})
    numbered = {(r.v, r.n): r.h for r in spark.createDataFrame(need, "v long, n int").select("v", "n", F.xxhash64("v", "n").alias("h")).collect()}
    pairs, want = set(), {}
    for i, t in enumerate(texts):
        values = [((first[g] if n == 0 else numbered[first[g] & ~low, n]) & ~low, at) for g, n, at in order_minhash_plainly(t)]
        assert len({v for v, _ in values}) == len(values)
        want[i] = [tuple(v for v, _ in sorted(sorted(values, key=lambda x: x[0] ^ m)[:2], key=lambda x: x[1])) for m in order_minhash._masks(32)]
        pairs |= set(want[i])
    two = {(r.a, r.b): r.h & 0xFFFFFFFF for r in spark.createDataFrame([p for p in pairs if len(p) == 2], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    one = {(r.a,): r.h & 0xFFFFFFFF for r in spark.createDataFrame([p for p in pairs if len(p) == 1], "a long").select("a", F.xxhash64("a").alias("h")).collect()}
    for i in want:
        assert got[i] == [(two | one)[p] if p else 0 for p in want[i]], i


def test_fingerprints_of_shared_keys_and_texts_without_blanks(spark):
    han = "".join(chr(0x4E00 + (7 * i * i) % 900) for i in range(300))
    rows = [(5, f"own text number {i} " * 6) for i in range(40)] + [(None, "lone"), (None, "lone"), (9, han), (3, han[:200] + "x")]
    got = order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t in rows)
    prints = {r.n_chars: r.fingerprint for r in got if r.doc_id in (9, 3)}
    assert sum(prints[300][j : j + 8] == prints[201][j : j + 8] for j in range(0, 256, 8)) > 3


def test_likeness_has_no_edge_at_long_words(spark):
    """Likeness falls with what is added, whatever the length of words is on average before and after."""
    words = [f"{i:022d}" for i in range(200)]
    added = ["".join(chr(97 + i * i * 7 % 26) for i in range(n)) for n in (0, 30, 100, 300, 600)]
    texts = [" ".join(words + [x]) for x in added] + [" ".join(words[:100] + [words[100] + "abc"] + words[101:])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    sig = {r.id: r.sig for r in order_minhash.signatures(df, ["id"], "body", 256, 2).collect()}
    near = [np.mean([x == y for x, y in zip(sig[0], sig[i])]) for i in range(len(texts))]
    assert near[0] == 1.0 and min(near[1], near[5]) > 0.6
    assert all(a > b > 0.01 for a, b in zip(near, near[1:5]))
    rows = [(2, " ".join(words)), (1, " ".join(words + [added[3]]))]
    assert order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 256).where("doc_id = 2").first().near_next > 0.05


def test_language_model_counts(spark, sf, corpus):
    got = {r.doc_id: r for r in catalogue.queries()["op9_class_lm"](spark, sf).collect()}
    tokens = {i: (t or "").encode().lower().split() + ["END"] for i, t, _ in corpus}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, words = sum(c.values()), len(c)
    bits = Counter()
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (words + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base)
        if held[i]:
            bits["base"] += r.base_score
            bits["class"] += r.score
    assert bits["class"] > bits["base"]


def test_class_model_is_normalised(spark):
    """Over every known word and the unseen one of each class, what may follow a word sums to 1."""
    texts = [(i, " ".join(f"a{(i + j) % 7} b{j % 5}" for j in range(30))) for i in range(40)]
    words = sorted({w for _, t in texts for w in t.split()})
    probe = [(1000 + k, w) for k, w in enumerate(words)] + [(999, None)]
    df = spark.createDataFrame(texts + probe, "doc_id long, text string")
    docs = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), (F.col("doc_id") >= 999).alias("held_out"), F.col("text").alias("text_body"))
    vocab = class_lm.vocabulary(class_lm.word_counts(docs), 1e-3)
    vocab["n"][vocab["end"]], vocab["distinct"][vocab["end"]] = 40, 1
    m = class_lm.model(class_lm.itemised(docs, vocab), vocab, 6, 3)
    n = np.bincount(m["of"], vocab["n"], 6)
    v = np.bincount(m["of"], vocab["distinct"], 6)
    given = (n + 0.1 * v + 0.1) / (n + 0.1 * (v + 1))
    assert np.allclose((10 ** m["trans"]).sum(1), 1) and np.allclose(given, 1)


def test_clustered_vocabulary_grows_with_the_corpus(spark):
    """What occurs often enough is an item, however little of the corpus it is."""
    counts = spark.createDataFrame([("common", 10_000_000), ("seldom", 8), ("rarely", 7)], "word string, n long")
    vocab = class_lm.vocabulary(counts, class_lm.LEAST)
    assert len(vocab["words"]) == 2 and vocab["n"].tolist() == [10_000_000, 8, 7, 0] and vocab["distinct"].tolist() == [1, 1, 1, 0]
    many = [spark.createDataFrame([(f"w{i}", 8) for i in range(n)], "word string, n long") for n in (500, 5000)]
    assert [len(class_lm.vocabulary(c, class_lm.LEAST)["words"]) for c in many] == [500, 5000]


def test_exchange_in_chunks_equals_a_plain_one(spark, monkeypatch):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"{'ab'[j % 2]}{draw.zipf(1.5) % 300}" for j in range(draw.integers(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text_body string").selectExpr("id", "xxhash64(text_body) digest", "id % 9 = 0 held_out", "text_body")
    vocab = class_lm.vocabulary(class_lm.word_counts(df), 2)
    end, classes, sweeps = vocab["end"], 6, 4
    vocab["n"][end], vocab["distinct"][end] = df.where("not held_out").count(), 1
    items = class_lm.itemised(df, vocab)
    for tokens, held in ((2_000_000, 4_000_000), (150, 100)):
        monkeypatch.setattr(class_lm, "CHUNK_TOKENS", tokens)
        monkeypatch.setattr(class_lm, "HELD", held)
        got = class_lm.model(items, vocab, classes, sweeps)
        flat = np.array([i for r in items.where("not held_out").collect() for i in r["items"]])
        of = np.arange(end + 1) % (classes - 1)
        of[end] = classes - 1
        rising, kept = [], None
        for sweep in range(sweeps + 1):
            c = of[flat]
            before, after, counts = np.zeros((end + 1, classes)), np.zeros((end + 1, classes)), np.zeros((classes, classes))
            np.add.at(before, (flat, np.r_[classes - 1, c[:-1]]), 1)
            np.add.at(after, (flat, np.r_[c[1:], classes - 1]), 1)
            np.add.at(counts, (np.r_[classes - 1, c[:-1]], c), 1)
            log = lambda x: (x * np.log(np.maximum(x, 1))).sum()
            now = log(counts) - log(counts.sum(0)) - log(counts.sum(1))
            if rising and now <= rising[-1]:
                break
            rising.append(now)
            trans = np.log10((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * classes))
            kept = of, trans
            if sweep == sweeps:
                break
            size, low = np.bincount(c, minlength=classes), 0.5 * classes
            gain = before @ trans + after @ trans.T - before.sum(1)[:, None] * np.log10(np.maximum(size, 1))
            for i in range(end + 1):  # staying: without the item's own occurrences
                a, n = of[i], before[i].sum()
                stay = sum(before[i, k] * math.log10((max(counts[k, a] - before[i, k], 0) + 0.5) / (counts[k].sum() + low)) for k in range(classes))
                stay += sum(after[i, k] * math.log10((max(counts[a, k] - after[i, k], 0) + 0.5) / max(counts[a].sum() + low - n, low)) for k in range(classes))
                gain[i, a] = stay - n * math.log10(max(size[a] - n, 1))
            gain[:, -1] = -np.inf
            rows, best = np.arange(end + 1), gain.argmax(1)
            move = (gain[rows, best] > gain[rows, of] + 1e-9) & (rows != end) & ((rows + sweep) % 2 == 0 if 0 < sweep < sweeps - 1 else True)
            of = np.where(move, best, of)
        assert got["of"].tolist() == kept[0].tolist() and np.allclose(got["trans"], kept[1])
        assert len(got["likelihood"]) > 1 and np.allclose(got["likelihood"], rising) and (np.diff(got["likelihood"]) > 0).all()


def test_items_of_many_words_and_packed_ones_equal_plain_ones(spark):
    """Words are looked up together, in a table that forgets; packed items are the same numbers."""
    texts = [f"Common words walk{'ing' * (i % 3)} x{i} ça日本語" for i in range(50)] + ["", None, "one\u00a0two \ud7ff", "common " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text_body string").selectExpr("id", "xxhash64(text_body) digest", "false held_out", "text_body")
    vocab = class_lm.vocabulary(class_lm.word_counts(df), 8)
    words = [w for t in texts for w in class_lm.tokens_of(t)] + [b"\xff\xfe", b"\xed\xa0\x80"]
    plain = class_lm.Items(vocab["words"], vocab["ends"], vocab["other"])
    want = [plain[w] for w in words]
    assert len(set(want)) > 5 and vocab["other"] in want
    for most in (1_000, 7):
        table = class_lm.Items(vocab["words"], vocab["ends"], vocab["other"], most)
        assert table.of(words).tolist() == want and table.of(words[::-1]).tolist() == want[::-1] and len(table) <= most
    lists = {r.id: list(r["items"]) for r in class_lm.itemised(df, vocab).collect()}
    assert lists == {i: [*(plain[w] for w in class_lm.tokens_of(t)), vocab["end"]] for i, t in enumerate(texts)}
    packed = class_lm.itemised(df, vocab, packed=True)
    assert {r.id: np.frombuffer(r["items"], np.int32).tolist() for r in packed.collect()} == lists
    of = np.arange(vocab["end"] + 1) % 5
    assert (class_lm.transitions(packed, of, 5) == class_lm.transitions(class_lm.itemised(df, vocab), of, 5)).all()


def test_class_score_by_hand(spark):
    """Scores from the fitted classes and transitions, token by token."""
    texts = [(i, " ".join(f"{'ab'[j % 2]}{(i * j) % 11}" for j in range(30))) for i in range(60)] + [(60, "a1 unseen b2"), (61, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    made = {}
    own = class_lm.model

    def spy(items, vocab, *rest):
        made.update(vocab=vocab, fitted=own(items, vocab, *rest))
        return made["fitted"]

    class_lm.model = spy
    try:
        rows = {r.doc_id: r for r in class_lm.score_texts(df, "doc_id >= 60", classes=5, sweeps=2).collect()}
    finally:
        class_lm.model = own
    vocab, of, trans = made["vocab"], made["fitted"]["of"], made["fitted"]["trans"]
    item = class_lm.Items(vocab["words"], vocab["ends"], vocab["other"])
    seen = Counter(w for i, t in texts if i < 60 for w in class_lm.tokens_of(t))
    for i, t in texts:
        words, at, total = class_lm.tokens_of(t), int(of[vocab["end"]]), 0.0
        for w in [*words, None]:
            x = vocab["end"] if w is None else item[w]
            n, k = (60 if w is None else seen[w]), int(of[x])
            size = sum(vocab["n"][of == k]) + 0.1 * (sum(vocab["distinct"][of == k]) + 1)
            total += trans[at, k] + math.log10((n + 0.1) / size)
            at = k
        assert rows[i].score == pytest.approx(total)


def test_language_model_of_odd_documents(spark):
    df = odd_documents(spark)
    rows = class_lm.score_texts(df, "doc_id % 4 = 0").collect()
    assert len(rows) == df.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[3].score == by[4].score == by[5].score
    alone = class_lm.score_texts(df, "true").collect()
    assert all(r.base_score == pytest.approx(0) and r.train_tokens == 0 for r in alone)
    assert class_lm.score_texts(empty(spark), "false").count() == 0


def neighbours(rows, k):
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            near = sorted(((-float(np.dot(v, w)), j) for j, w in rows if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_neighbours_recall(spark, sf):
    rows = [(i, np.array(v, float)) for i, v in duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()]
    true, got = neighbours(rows, 20), {}
    for r in catalogue.queries()["op6_cross_polytope"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vecs = dict(rows)
    assert all([x[0] for x in g] == list(range(1, len(g) + 1)) and [x[2] for x in g] == sorted((x[2] for x in g), reverse=True) for g in got.values())
    assert all(abs(float(np.dot(vecs[q], vecs[v])) - s) < 1e-12 for q, g in got.items() for _, v, s in g)
    assert np.mean([len({j for j, _ in t} & {v for _, v, _ in got[q]}) / 20 for q, t in true.items()]) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=5) * (1 + i % 3)]) for i in range(41)] + [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(60, 101)]
    odd = [(200, None), (220, [0.0] * 5), (240, [1.0, None, 0.0, 0.0, 0.0]), (260, [float("nan")] * 5), (280, [float("inf")] * 5), (300, [1.0]), (None, [1.0] * 5), (320, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("ids", F.lit("x"))
    got = {}
    for r in ann.nearest(df, "vec_id % 20 = 0", probes=10, target=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score)))
    assert got == neighbours([(i, np.array(v)) for i, v in rows], 20)
    paired = ann.nearest(df, "vec_id % 20 = 0", k=5, probes=40, joint=2, target=1.0).groupBy("query_id").count().collect()
    assert all(r["count"] == 5 for r in paired)
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), "vec_id % 20 = 0", probes=10, target=1.0)
    assert few.count() == 2 and ann.nearest(df.where("false"), "true").count() == 0


def test_pairs_of_axes_find_neighbours(spark, monkeypatch):
    """joint=2 against brute force, over more rows than the fit sees."""
    fit, used = ann.fit, []
    monkeypatch.setattr(ann, "FIT_ROWS", 1000)
    monkeypatch.setattr(ann, "fit", lambda *a: used.append(fit(*a)) or used[-1])
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(60, 32))
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(centres[draw.integers(0, 60, 3000)] + 0.7 * draw.normal(size=(3000, 32)))]
    df, got = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>"), {}
    for r in ann.nearest(df, "vec_id % 20 = 0", k=10, joint=2).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    true = neighbours(rows, 10)
    assert [i.joint for i, _ in used] == [2]
    assert np.mean([len({j for j, _ in t} & got.get(q, set())) / 10 for q, t in true.items()]) >= 0.9


def test_a_missed_fit_becomes_a_scan(spark):
    """Wide vectors without near neighbours: finer buckets miss the target, so all are compared."""
    draw = np.random.default_rng(12)
    vectors = draw.normal(size=(300, 768))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    assert isinstance(ann.fit(vectors, 1.0, True, 5, 4, 2, 0.95, 4, 8)[0], ann.Scan)
    rows = list(enumerate(vectors))
    df, got = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>"), {}
    for r in ann.nearest(df, "vec_id % 20 = 0", k=5, joint=2, target=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score)))
    assert got == neighbours(rows, 5)


def test_width_of_buckets_follows_the_work():
    draw = np.random.default_rng(13)
    sample = draw.normal(size=(20, 16))[draw.integers(0, 20, 2000)] + 0.3 * draw.normal(size=(2000, 16))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    few, _ = ann.chosen(sample, 1.0, True, 10, 4, 0.95, 2000, 100)
    many, probes = ann.chosen(sample, 1.0, True, 10, 4, 0.95, 3_000_000, 3_000_000)
    assert few.joint == 1 and many.joint == 2 and (many.tables, probes) == (lambda i, p: (i.tables, p))(*ann.fit(sample, 1.0, True, 10, 4, 2, 0.95))
