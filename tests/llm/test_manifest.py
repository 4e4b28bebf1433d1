"""The Merkle manifest against trees built level by level."""

import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loamwork.llm import catalogue, merkle


def hexed(parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree_of(nodes):
    """All levels of a tree of runs of three."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hexed(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append((level[run:at], level[at + 1 : run + 3]))
        at //= 3
    return out


def leaf_of(row, text):
    values = [None if v is None else str(v).encode() for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)]
    return sha256(b"".join(b"-" if v is None else b"%d:" % len(v) + v for v in values)).hexdigest()


def manifest_of(rows):
    """Every column of the contract, by brute force."""
    groups = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, own = [], []
    for g in groups:
        mine = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])), k) for k, r in enumerate(rows) if r["source"] == g)
        trees.append(tree_of([x[2] for x, _ in mine]))
        own.append([rows[k] for _, k in mine])
    top = tree_of([t[-1][0] for t in trees])
    out = []
    for g, (tree, mine) in enumerate(zip(trees, own)):
        for at, r in enumerate(mine):
            path = path_of(tree, at) + path_of(top, g)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf_of(r, r["text"].replace("\n", "")) if hit else tree[0][at]
            for before, after in path:
                node = hexed([*before, node, *after])
            out.append((r["doc_id"], tree[0][at], tree[-1][0], top[-1][0], hexed([x for b, a in path for x in (*b, *a)]), node, node == top[-1][0]))
    return Counter(out)


def found(df, levels=merkle.LEVELS):
    text = F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0"), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return Counter(tuple(r) for r in merkle.manifest(df, text, levels=levels).collect())


@pytest.mark.parametrize("levels", [1, 2, 3, 5])
def test_traversal_gives_every_path_and_the_root(levels):
    for n in [*range(1, 30), 80, 81, 82, 240, 243]:
        if n > 3**levels:
            continue
        nodes = [sha256(bytes([i % 251, n % 251])).digest() for i in range(n)]
        tree = tree_of([x.hex() for x in nodes])
        while len(tree) <= levels:  # a block of a larger tree goes on to its full height
            tree.append([hexed(tree[-1])])
        assert merkle.root_of(nodes, levels).hex() == tree[-1][0]
        got = list(merkle.traverse(nodes, levels))
        assert len(got) == n
        for i, path in enumerate(got):
            assert [([x.hex() for x in b], [x.hex() for x in a]) for b, a in path] == path_of(tree, i)
            assert merkle.fold(nodes[i], path).hex() == tree[-1][0]


def test_a_stack_holds_two_nodes_a_level_at_most():
    stack, most = merkle.Stack(6), 0
    for i in range(3**6):
        stack.push(b"%d" % i, i == 3**6 - 1)
        most = max(most, max(Counter(level for level, _ in stack.nodes).values(), default=0))
    assert most == 2 and len(stack.done) == 1


def test_manifest_of_the_table(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in catalogue.queries()["op11_merkle_manifest"](spark, sf).collect())
    assert got == manifest_of(rows)
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_groups_of_many_blocks_and_odd_rows(spark, levels):
    rows = [(i, "big", "en", 3, f"t{i}\nx") for i in range(100)] + [(7, "big", "en", 3, "t7\nx")] * 5 + [(1, None, None, None, None), (None, None, "de", 1, "a\n"), (None, "lone", "x", 0, ""), (2, "é", "x", 9, "b\n\nc"), (2, "zz", "x", 9, "b"), (2, "", "x", 9, "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    odd = df.withColumn("tree", F.lit("x")).withColumn("place", F.lit(1)).withColumn("size", F.lit(2)).withColumn("grp", F.lit(0)).withColumn("first", F.lit("f"))
    assert found(odd, levels) == manifest_of([r.asDict() for r in df.collect()])


def test_one_leaf_is_the_root_and_no_rows_give_none(spark):
    df = spark.createDataFrame([(2, "s", "en", 1, "a")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = found(df)
    assert row[1] == row[2] == row[3] == row[5] and row[4] == sha256(b"").hexdigest() and row[6]
    assert not found(df.where("false"))
