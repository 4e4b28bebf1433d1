"""N-gram Jaccard self-join: MinHash LSH forest, then exact verification."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import WordHash, batch, blocks, bucket_count, components, documents, lean, rolling, saved, trim, words_of

#: A block of candidates holds about this many texts and shingles at most; a text beyond that is a block of its own.
BLOCK_TEXTS, BLOCK_SHINGLES = 384, 1_500_000
#: Values of a tree's label, and of the shortest prefix of a small trie node; texts that make a node small.
LONGEST, FLOOR, FEW = 16, 3, 16
#: Width of a stratum of similarity, and links that theory counts for in each.
STRATUM, BELIEF = 0.05, 200
#: Bits of the map of wanted texts: 4 MB.
FILTER = 1 << 25
#: Texts of a trie node that are compared in one block.
RUN = 1_024


def shingles(words: list[bytes], hashes: WordHash, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; fewer words than n make one shingle, none make none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.sort(rolling(hashes.array(words), min(size, len(words))))
    return h[np.r_[True, h[1:] != h[:-1]]]


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240501)
    return draw.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, dtype=np.uint64)


def signature(shingle: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One 16-bit MinHash for each (mul, add): the least of 32-bit hashes, folded."""
    x = (shingle ^ (shingle >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (mul[:, None] * x[at : at + 512] + add[:, None]).min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def sketches(docs: DataFrame, n: int, trees: int) -> DataFrame:
    """(id, digest, n_shingles, forest) of each row; forest has the trees' labels of LONGEST values, big-endian, joined."""
    mul, add = (x.astype(np.uint32) for x in _seeds(trees * LONGEST))
    mul |= np.uint32(1)
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("forest", pa.binary())])

    def run(batches):
        hashes = WordHash()
        for rows in blocks(batches, 2_000_000, "text_body"):
            digest, count, forest = [], [], []
            for text in rows["text_body"]:
                s = shingles(words_of(text), hashes, n)
                digest.append(hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest())
                count.append(len(s))
                forest.append(signature(s, mul, add).astype(">u2").tobytes() if len(s) else None)
            yield batch(schema, rows["id"], digest, count, forest)

    return docs.mapInArrow(lean(run), "id long, digest binary, n_shingles long, forest binary")


def _common_prefix(same: np.ndarray) -> np.ndarray:
    """Number of leading trues along the last axis."""
    return np.where(same.all(-1), same.shape[-1], same.argmin(-1))


def shortened(found: dict[tuple[int, int], int], trees: int, threshold: float, target: float) -> int:
    """The depth to which matched prefixes are shortened: from LONGEST on, one value at a time, until in every
    stratum of similarity the share of links that share so long a prefix reaches the target.

    found counts links by (stratum, longest prefix shared in any tree); BELIEF links at a stratum's lower edge, found
    as often as theory has it, are added to each. near_classes gives none, so that no counted link can lengthen the
    prefix: it is then what finds a pair at the threshold, whatever the table, and more similar ones more surely."""
    strata = range(max(1, round((1 - threshold) / STRATUM)))
    for depth in range(LONGEST, 1, -1):
        for k in strata:
            total = sum(n for (s, _), n in found.items() if s == k)
            hit = sum(n for (s, d), n in found.items() if s == k and d >= depth)
            theory = 1 - (1 - (threshold + k * STRATUM) ** depth) ** trees
            if hit + BELIEF * theory < target * (total + BELIEF):
                break
        else:
            return depth
    return 1


def _levels(common: np.ndarray, depth: int, few: int) -> np.ndarray:
    """Per row the prefix that it is met by, given the values that each row shares with the next.

    A node is shortened from `depth` on to FLOOR values while it has `few` texts at most; one that reaches the first
    or last row may go on elsewhere, and is not shortened. All rows of a node get the same."""
    level = np.full(len(common) + 1, depth)
    for d in range(depth - 1, FLOOR - 1, -1):
        node = np.cumsum(np.r_[False, common < d])
        size = np.bincount(node)
        size[[0, -1]] = few + 1
        level[size[node] <= few] = d
    return level


def companions(nodes: DataFrame, trees: int, depth: int, parts: int) -> DataFrame:
    """(tree, prefix, digest) of the texts that share a trie node with another, and few more.

    A tree's labels in sorted order are its trie: neighbours that share `depth` values or more are in one
    node. Where a node has FEW texts at most, its prefix is shortened on, to FLOOR values, as long as that holds: all
    texts of the table decide that, and it only adds companions. Labels are range-sorted over all tasks, so a large
    node may lie across several; a task's first and last labels go on unconditionally, as their neighbours are
    elsewhere."""
    wide = 2 * LONGEST
    labels = nodes.where("forest is not null").select("digest", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "forest").select("tree", F.expr(f"substring(forest, tree * {wide} + 1, {wide})").alias("label"), "digest")
    ranked = labels.repartitionByRange(parts, "tree", "label", "digest").sortWithinPartitions("tree", "label", "digest")
    schema = pa.schema([("tree", pa.int32()), ("prefix", pa.binary()), ("digest", pa.binary())])
    few = FEW

    def run(batches):
        held = None

        def out(rows, first, last):
            tree, label = rows.column(0).to_numpy(), np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint16).reshape(-1, LONGEST)
            common = np.where(tree[1:] == tree[:-1], _common_prefix(label[1:] == label[:-1]), 0)
            level = _levels(common, depth, few)
            near = common >= np.minimum(level[1:], level[:-1])
            at = np.flatnonzero(np.r_[first, near] | np.r_[near, last])
            raw = label.tobytes()
            yield batch(schema, tree[at], [raw[wide * i : wide * i + 2 * n] for i, n in zip(at.tolist(), level[at].tolist())], rows.column(2).take(pa.array(at)))

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            rows = rows.combine_chunks().to_batches()[0]
            if held is None:
                yield from out(rows.slice(0, 1), True, True)
            if rows.num_rows > 1:
                yield from out(rows, False, False)
            held = pa.Table.from_batches([rows.slice(rows.num_rows - 1, 1)])
        if held is not None:
            yield from out(held.to_batches()[0], True, True)

    return ranked.mapInArrow(lean(run), "tree int, prefix binary, digest binary").distinct()


def ties(nodes: DataFrame, matched: DataFrame, trees: int, threshold: float, parts: int) -> DataFrame:
    """Edges (a, b) of digests that tie candidate texts together.

    In a trie node of at most RUN texts, signatures are compared in one block, and what is within five standard
    errors of the threshold is tied; so texts that meet by chance don't chain groups together. The texts of a
    larger node are all tied to its least."""
    runs = matched.groupBy("tree", "prefix").agg(F.count("*").alias("m"), F.min("digest").alias("head")).where("m > 1")
    both = matched.join(runs, ["tree", "prefix"])
    large = both.where((F.col("m") > RUN) & (F.col("digest") != F.col("head"))).select(F.col("digest").alias("a"), F.col("head").alias("b"))
    small = both.where(F.col("m") <= RUN).select("tree", "prefix", "digest").join(nodes.select("digest", "forest"), "digest").withColumn("task", F.pmod(F.xxhash64("tree", "prefix"), F.lit(4 * parts)))
    floor = threshold - 5 * math.sqrt(threshold * (1 - threshold) / (trees * LONGEST))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        tree, prefix, digest = (table.column(n).to_pylist() for n in ("tree", "prefix", "digest"))
        forest = table.column("forest")
        by: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(tree, prefix)):
            by.setdefault(key, []).append(i)
        a, b = [], []
        for own in by.values():
            f = np.frombuffer(b"".join(forest[i].as_py() for i in own), np.uint16).reshape(len(own), -1)
            root = np.arange(len(own))
            for i in range(len(own) - 1):
                rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
                for j in rest[(f[rest] == f[i]).mean(1) >= floor]:
                    if (old := root[j]) != root[i]:
                        a.append(digest[own[i]])
                        b.append(digest[own[j]])
                        root[root == old] = root[i]
        trim()
        return pa.Table.from_batches([batch(schema, a, b)])

    return large.union(small.groupBy("task").applyInArrow(run, "a binary, b binary"))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, columns: int = 8192):
    """Index pairs (i in left, j in right) with Jaccard similarity of sets[i], sets[j] at the threshold or above.

    Exact: intersection sizes come from products of 0/1 matrices over the shingles that two sets share,
    some columns at a time.
    """
    both = np.concatenate([left, right])
    size = np.array([len(sets[i]) for i in both])
    flat, count = np.unique(np.concatenate([sets[i] for i in both]), return_counts=True)
    shared = flat[count > 1]
    common = np.zeros((len(left), len(right)), np.float32)
    owner = np.repeat(np.arange(len(both)), size)
    value = np.searchsorted(shared, values := np.concatenate([sets[i] for i in both]))
    value[value == len(shared)] = 0
    ok = shared[value] == values if len(shared) else np.zeros(len(values), bool)
    owner, value = owner[ok], value[ok]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    for at in range(0, len(shared), columns):
        lo, hi = np.searchsorted(value, [at, at + columns])
        m = np.zeros((len(both), min(columns, len(shared) - at)), np.float32)
        m[owner[lo:hi], value[lo:hi] - at] = 1
        common += m[: len(left)] @ m[len(left) :].T
    a, b = size[: len(left), None], size[None, len(left) :]
    i, j = np.nonzero(common >= threshold * (a + b - common) - 1e-6)
    return left[i], right[j]


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, digest, shingles) of the rows of docs that are among wanted (id, digest), and of a few more.

    A bitmap of FILTER bits, made by Spark and of that size whatever the corpus, tells where texts are read what is
    not wanted; so texts are not exchanged, only the shingles of what passes."""
    slot = F.pmod(F.xxhash64("id", "digest"), F.lit(FILTER)) + 1
    maps = wanted.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("page")).agg(F.bitmap_construct_agg(F.expr("bitmap_bit_position(slot)")).alias("bits")).collect()
    found = np.zeros(FILTER // 8, np.uint8)
    for page, bits in maps:
        found[(page - 1) * len(bits) : page * len(bits)] = np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    own = docs.where("id is not null and text_body is not null").select("id", "text_body", F.unhex(F.md5("text_body")).alias("digest")).select("*", (slot - 1).alias("slot"))
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("shingles", pa.binary())])

    def run(batches):
        hashes, found = WordHash(), shared.value

        def passed():
            for b in batches:
                at = b.column(3).to_numpy()
                yield b.filter(pa.array((found[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

        for r in blocks(passed(), 2_000_000, "text_body"):
            yield batch(schema, r["id"], r["digest"], [shingles(words_of(t), hashes, n).tobytes() for t in r["text_body"]])

    return own.mapInArrow(lean(run), "id long, digest binary, shingles binary")


def _verify(table: pa.Table, threshold: float):
    """Rows (node, root, links) of the texts with a link; root joins what is linked within one block pair."""
    t = {n: table.column(n).to_pylist() for n in ("part", "node", "weight", "first", "second", "shingles")}
    by: dict[tuple, list[int]] = {}
    for k, key in enumerate(t["part"]):
        by.setdefault(key, []).append(k)
    for rows in by.values():
        sets = [np.frombuffer(t["shingles"][k], np.uint64) for k in rows]
        names = sorted({t["node"][k] for k in rows})
        number = {x: i for i, x in enumerate(names)}
        node = np.array([number[t["node"][k]] for k in rows], np.int64)
        weight = np.array([t["weight"][k] for k in rows], np.int64)
        first = np.array([t["first"][k] for k in rows], bool)
        second = np.array([t["second"][k] for k in rows], bool)
        left, right = np.flatnonzero(first), np.flatnonzero(second)
        if not len(left) or not len(right):
            continue
        i, j = linked(sets, left, right, threshold)
        apart = node[i] != node[j]
        i, j = i[apart], j[apart]
        links = np.bincount(i, weight[j], len(node)).astype(np.int64)
        if not first[right].all():  # two different blocks: count for both
            links += np.bincount(j, weight[i], len(node)).astype(np.int64)
        root = np.arange(len(node))
        while True:
            least = root.copy()
            np.minimum.at(least, i, root[j])
            np.minimum.at(least, j, root[i])
            least = least[least]
            if (least == root).all():
                break
            root = least
        lowest = np.full(len(node), len(names))
        np.minimum.at(lowest, root, node)
        for k in np.flatnonzero(links):
            yield names[node[k]], names[lowest[root[k]]], int(links[k])


def near_classes(df: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 20, target: float = 0.9995, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, digest, root, class_id, n_links) of each row: near_duplicates with the MD5 of the row's text and that of
    its class's root text, which tell rows and classes apart where keys don't."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text_body"))
    parts = bucket_count(docs, "text_body")
    rows = saved(sketches(docs, n, trees), "sketches")
    nodes = saved(rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("n_shingles").alias("n_shingles"), F.first("forest").alias("forest")), "nodes")

    depth = shortened({}, trees, threshold, target)
    matched = saved(companions(nodes, trees, depth, parts), "companions")
    group = components(ties(nodes, matched, trees, threshold, parts))

    members = saved(group.join(nodes.select(F.col("digest").alias("node"), "id", "weight", "n_shingles"), "node"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total")).withColumn("n_blocks", F.ceil(F.greatest(F.col("m") / BLOCK_TEXTS, F.col("total") / BLOCK_SHINGLES)).cast("int")).select("root", "n_blocks")
    placed = members.join(sizes, "root").select(F.col("node").alias("digest"), "id", "root", "weight", "n_blocks", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block"))
    # one row carries a text: one of those with its least key
    sets = shingle_sets(docs, placed.select("id", "digest"), n).join(placed, ["id", "digest"]).dropDuplicates(["id", "digest"]).withColumnRenamed("digest", "node")
    dealt = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("with")).selectExpr(
        "node", "weight", "shingles", f"case when n_blocks = 1 then pmod(xxhash64(root), {4 * parts}) else xxhash64(root, least(block, with), greatest(block, with)) end as task",
        "concat_ws(':', hex(root), least(block, with), greatest(block, with)) as part", "block <= with as first", "block >= with as second")

    def verify(table: pa.Table) -> pa.Table:
        found = list(_verify(table, threshold))
        node, root, links = zip(*found) if found else ((), (), ())
        trim()
        return pa.table({"node": pa.array(node, pa.binary()), "root": pa.array(root, pa.binary()), "links": pa.array(links, pa.int64())})

    checked = saved(dealt.groupBy("task").applyInArrow(verify, "node binary, root binary, links long"), "links")
    classes = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy(F.col("node").alias("digest")).agg(F.sum("links").alias("links"))
    own = saved(classes.withColumnRenamed("node", "digest").join(nodes.select("digest", "id"), "digest").join(links, "digest", "left"), "classes")
    least = own.groupBy("root").agg(F.min("id").alias("class_id"))
    of = nodes.select("digest", "id", "weight").join(own.drop("id").join(least, "root"), "digest", "left").select(
        "digest", F.coalesce("root", "digest").alias("root"), F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = rows.where("id is not null").select("id", "digest").join(of, "digest").select("id", "digest", "root", "class_id", "n_links")
    return known.union(rows.where("id is null").selectExpr("id", "digest", "digest as root", "cast(null as long) as class_id", "0L as n_links"))


def near_duplicates(df: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 20, target: float = 0.9995, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, n_links): the classes of texts joined by links, a link being a Jaccard similarity
    of word n-gram sets at the threshold or above.

    Forest: each distinct text has one label of 16 MinHash values per tree; the sorted labels of a tree are
    its prefix trie. Matched prefixes are shortened from 16 values on, one at a time, until any pair at the threshold
    shares so long a prefix with probability `target` (shortened), and in trie nodes of few texts further,
    by the sizes of the whole table's nodes (companions). Nothing is taken from a sample. Texts of one node are compared by
    signature, and those that come near the threshold are tied (ties); a node of more than RUN texts is tied
    whole, by a pre-aggregated minimum. All pairs of tied texts are then verified exactly on their shingle
    sets, in blocks of bounded size, so a large group becomes many block pairs; a block pair gives one row
    per linked text, never the pairs.

    Results: equal texts are one node and never expanded; n_links counts the other rows that a row is
    linked to, copies included; class_id is the least key of the class. Fewer than n words make one
    shingle of them all. A null, empty or blank text has no shingle, and is linked to nothing but an
    equal text. A null key takes no part (null class, 0 links). Different texts under one key are documents
    of their own, one row each. An empty table gives no rows. Other columns, whatever their names, are left
    out. Shingles are compared as 64-bit hashes, texts as MD5.
    """
    return near_classes(df, n, threshold, trees, target, text, key).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM w, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c)
      UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON coalesce(a.text, '') = coalesce(b.text, '') AND a.doc_id <> b.doc_id),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM e WHERE e.x = r.a) AS n_links FROM r GROUP BY a
"""
