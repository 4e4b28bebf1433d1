"""Merkle manifest of a dataset: roots per group and over all, and each row's authentication path, by Merkle's traversal."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import batch, documents, lean, saved
from loamwork.operators.numbering import numbered

#: Children of a node, and levels of a block: an aligned block has WAYS ** LEVELS leaves.
WAYS, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(digests: list[bytes]) -> bytes:
    """SHA-256 of digests written as lowercase hex, one after another."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


class Stack:
    """A treehash stack: takes leaves in order, holds at most two nodes of a level, gives nodes of level `top`."""

    def __init__(self, top: int):
        self.top, self.nodes, self.done = top, [], []

    def push(self, leaf: bytes, last: bool) -> None:
        """`last`: no leaf follows, so that runs of fewer than three, even of one, are nodes too."""
        nodes = self.nodes
        nodes.append((0, leaf))
        while nodes[-1][0] < self.top:
            level, run = nodes[-1][0], 1
            while run < len(nodes) and nodes[-1 - run][0] == level:
                run += 1
            if run < WAYS and not last:
                return
            parent = h([d for _, d in nodes[-run:]])
            del nodes[-run:]
            nodes.append((level + 1, parent))
        self.done.append(nodes.pop()[1])


def height(n: int) -> int:
    """Levels above n nodes until one remains."""
    up = 0
    while n > 1:
        n, up = -(-n // WAYS), up + 1
    return up


def root_of(leaves: list[bytes], levels: int) -> bytes:
    stack = Stack(levels)
    for i, leaf in enumerate(leaves, 1):
        stack.push(leaf, i == len(leaves))
    return stack.done[0]


def traverse(leaves: list[bytes], levels: int):
    """Of each leaf in turn its authentication path: per level the siblings before and after it.

    Held beside the leaves: the current run of each level, and one stack per level that makes the run to come, at
    most two nodes a level. While the leaves of a run go by, its level's stack takes the leaf as far into the next
    run, from that run's second node on; the first one is known when it is left, from the run below it. So a leaf
    costs a step of each stack, and none looks back.
    """
    n = len(leaves)
    stacks = [Stack(k) for k in range(levels)]
    runs: list[list[bytes | None]] = []

    def feed(k: int, at: int) -> None:
        if at < n and at % WAYS ** (k + 1) >= WAYS**k:
            stacks[k].push(leaves[at], at == n - 1)

    for k in range(levels):
        for at in range(WAYS ** (k + 1)):
            feed(k, at)
        runs.append([None, *stacks[k].done])
        stacks[k].done = []
    for i in range(n):
        yield [(run[: (p := i // WAYS**k % WAYS)], run[p + 1 :]) for k, run in enumerate(runs)]
        for k in range(levels):
            feed(k, i + WAYS ** (k + 1))
        left = leaves[i]  # the node left behind, level by level
        for k in range(levels):
            if (i + 1) % WAYS**k:
                break
            if i // WAYS**k % WAYS == 0:
                runs[k][0] = left
            if (i + 1) % WAYS ** (k + 1):
                break
            left = h(runs[k])
            runs[k], stacks[k].done = [None, *stacks[k].done], []


def fold(node: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a node and its siblings lead to."""
    for before, after in path:
        node = h([*before, node, *after])
    return node


_BIN, _BINS = pa.binary(), pa.list_(pa.binary())
_PACKED = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("nodes", _BINS), ("others", _BINS), ("root", _BIN)])
_PACKED_DDL = "tree long, block long, size long, keys array<long>, nodes array<binary>, others array<binary>, root binary"


def _levels(size: int, most: int) -> int:
    """Levels of a block of a tree of so many leaves: all of the tree's, if it is one block, so that no level is empty."""
    return height(size) if size <= WAYS**most else most


def _pack(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (tree, at, size, key, node, other) as one row per aligned block, with its root."""

    def pack(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_pylist() for c in ("tree", "block", "at", "size", "key", "node", "other")}
        order = sorted(range(len(t["at"])), key=t["at"].__getitem__)
        own = {c: [t[c][i] for i in order] for c in ("key", "node", "other")}
        root = root_of(own["node"], _levels(t["size"][0], levels))
        return pa.Table.from_batches([batch(_PACKED, [t["tree"][0]], [t["block"][0]], [t["size"][0]], [own["key"]], [own["node"]], [own["other"]], [root])])

    return nodes.withColumn("block", F.expr(f"at div {WAYS**levels}")).groupBy("tree", "block").applyInArrow(pack, _PACKED_DDL)


#: A path is an array of levels, a level the nodes before and after, each of them joined.
_PATH_DDL = "array<struct<before: binary, after: binary>>"
_LEVEL = pa.struct([("before", _BIN), ("after", _BIN)])


def _split(raw: bytes) -> list[bytes]:
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


def _with_tops(packed: DataFrame, levels: int) -> DataFrame:
    """Blocks and, of each, the path from its root to its tree's (`upper`), and that root (`top`): blocks of block
    roots are climbed the same way, one round per `levels` levels."""
    leaves = WAYS**levels
    if (packed.agg(F.max("size").alias("n")).first()["n"] or 0) <= leaves:
        return packed.select("*", F.expr(f"cast(array() as {_PATH_DDL})").alias("upper"), F.col("root").alias("top"))
    many = packed.where(F.col("size") > leaves)
    roots = many.select("tree", F.col("block").alias("at"), F.expr(f"(size + {leaves - 1}) div {leaves}").alias("size"), F.lit(None).cast("long").alias("key"), F.col("root").alias("node"), F.lit(None).cast("binary").alias("other"))
    known = paths(roots, levels).select("tree", F.col("at").alias("block"), "path", F.col("top").alias("_top"))
    both = packed.join(known, ["tree", "block"], "left")
    return both.select(*[packed[c] for c in packed.columns], F.coalesce("path", F.expr(f"cast(array() as {_PATH_DDL})")).alias("upper"), F.coalesce("_top", "root").alias("top"))


def paths(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, at, path, top) of nodes (tree, at, size, key, node, other): each one's siblings up to its tree's root."""

    def climb(batches):
        schema = pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("path", pa.list_(_LEVEL)), ("top", _BIN)])
        for b in batches:
            for row in b.to_pylist():
                at = row["block"] * WAYS**levels
                found = [[{"before": b"".join(x), "after": b"".join(y)} for x, y in p] + row["upper"] for p in traverse(row["nodes"], _levels(row["size"], levels))]
                yield batch(schema, [row["tree"]] * len(found), list(range(at, at + len(found))), found, [row["top"]] * len(found))

    tops = _with_tops(saved(_pack(nodes, levels), "blocks"), levels)
    return tops.select("tree", "block", "size", "nodes", "upper", "top").mapInArrow(lean(climb), f"tree long, at long, path {_PATH_DDL}, top binary")


def leaf_of(text: Column, others: list[Column]) -> Column:
    """Hex SHA-256 of the columns: `-` for null, else the bytes' count, `:` and the value in UTF-8."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in [*others, text]]), 256)


def manifest(df: DataFrame, tampered: Column, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, text: str = "text", levels: int = LEVELS) -> DataFrame:
    """One row per row of df: `key` (as doc_id), leaf, subroot, root, proof_sha256, folded_root, verified, all hex.

    A leaf is the hash of the row's `fields`, the last of which is `text`. The leaves of a group, by key, are a tree
    of runs of three, its root is the group's subroot; the subroots, by group, are a tree likewise. proof_sha256
    hashes a leaf's siblings on the way to the root; folded_root is what they make of the leaf of `tampered`, the text as a
    reader found it, and verified says whether that is the root.

    Leaves are numbered within their groups by range partitions and dealt into aligned blocks of 3 ** `levels` (2,187), a row each:
    a group of any size is many blocks, and no task holds more than one at a time. Block roots, much fewer, are climbed
    the same way; then each block is traversed once, its leaves' paths going on with its own.

    Null groups come first, null keys come first in their group; equal keys are ordered by leaf, so that repeated rows
    are leaves of their own next to each other; null fields are `-`, which no value is. An empty text is `0:`. A lone leaf
    is its group's subroot, and the root if no other group is there: its proof is the hash of nothing. Further columns,
    whatever their names, are left out. An empty table gives no rows.
    """
    others = [F.col(c).cast("string") for c in fields if c != text]
    rows = df.select(
        F.col(group).alias("grp"), F.col(key).cast("long").alias("key"), F.unhex(leaf_of(F.col(text), others)).alias("node"),
        F.when(~tampered.eqNullSafe(F.col(text)), F.unhex(leaf_of(tampered, others))).alias("other"))
    nodes = numbered(saved(rows, "leaves"), [F.col("key").asc_nulls_first(), F.col("node"), F.rand(11)], within=["grp"])
    blocks = _with_tops(saved(_pack(nodes.select(F.col("first").alias("tree"), F.col("place").alias("at"), "size", "key", "node", "other"), levels), "blocks"), levels)
    blocks = saved(blocks, "climbed")
    # a tree's name is the number of leaves before it, so trees are in the order of their groups
    subroots = saved(blocks.where("block = 0").select("tree", F.col("top").alias("node")), "subroots")
    trees = numbered(subroots, [F.col("tree")])
    named = saved(trees.select("tree", "place", "size", "node"), "trees")
    over = paths(named.select(F.lit(0).cast("long").alias("tree"), F.col("place").alias("at"), "size", F.lit(None).cast("long").alias("key"), "node", F.lit(None).cast("binary").alias("other")), levels)
    over = named.join(over.select(F.col("at").alias("place"), F.col("path").alias("over"), F.col("top").alias("all")), "place").select("tree", "over", "all")

    def prove(batches):
        schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [("verified", pa.bool_())])
        for b in batches:
            for row in b.to_pylist():
                above = [(_split(x["before"]), _split(x["after"])) for x in row["upper"] + row["over"]]
                tail = "".join(d.hex() for x, y in above for d in (*x, *y))
                top, known, out = row["all"], {}, []
                for doc, leaf, other, path in zip(row["keys"], row["nodes"], row["others"], traverse(row["nodes"], _levels(row["size"], levels))):
                    proof = sha256(("".join(d.hex() for x, y in path for d in (*x, *y)) + tail).encode()).hexdigest()
                    block = fold(leaf if other is None else other, path)
                    if block not in known:  # all untouched leaves of a block lead to its root
                        known[block] = fold(block, above)
                    out.append((doc, leaf.hex(), row["top"].hex(), top.hex(), proof, known[block].hex(), known[block] == top))
                yield batch(schema, *zip(*out))

    ready = blocks.join(over, "tree").select("keys", "nodes", "others", "size", "upper", "top", "over", "all")
    return ready.mapInArrow(lean(prove), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0"), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(documents(spark, sf_dir), found)


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
own AS (
  SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM documents, crc_table),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other FROM own),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM hashed),
level AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS node FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM level WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
subroots AS (SELECT tree, lvl AS tree_height, node AS subroot FROM level WHERE n = 1),
uppers AS (
  SELECT 0 AS lvl, tree - 1 AS pos, (SELECT count(*) FROM subroots) AS n, subroot AS node FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM uppers WHERE n > 1 GROUP BY lvl, pos // 3, n),
numbered AS (SELECT *, row_number() OVER () AS id FROM leaves),
spread AS (SELECT id, tree, pos, unnest(range(tree_height)) AS lvl FROM numbered JOIN subroots USING (tree)),
siblings AS (
  SELECT id, s.lvl, l.pos - s.pos // (3 ** s.lvl)::BIGINT AS side, node
  FROM spread s JOIN level l ON l.tree = s.tree AND l.lvl = s.lvl AND l.pos // 3 = s.pos // (3 ** (s.lvl + 1))::BIGINT
  UNION ALL
  SELECT id, s.tree_height + s.up, o.pos - s.pos // (3 ** s.up)::BIGINT, node
  FROM (SELECT id, tree - 1 AS pos, tree_height, unnest(range((SELECT max(lvl) FROM uppers))) AS up FROM numbered JOIN subroots USING (tree)) s
  JOIN uppers o ON o.lvl = s.up AND o.pos // 3 = s.pos // (3 ** (s.up + 1))::BIGINT),
steps AS (
  SELECT id, lvl, coalesce(string_agg(node, '' ORDER BY side) FILTER (WHERE side < 0), '') AS pre, coalesce(string_agg(node, '' ORDER BY side) FILTER (WHERE side > 0), '') AS post
  FROM siblings GROUP BY id, lvl),
proofs AS (SELECT id, sha256(string_agg(pre || post, '' ORDER BY lvl)) AS proof, count(*) AS many FROM steps GROUP BY id),
folded AS (
  SELECT id, 0 AS lvl, coalesce(other, leaf) AS node FROM numbered
  UNION ALL
  SELECT f.id, f.lvl + 1, sha256(pre || f.node || post) FROM folded f JOIN steps s ON s.id = f.id AND s.lvl = f.lvl)
SELECT doc_id, leaf, subroot, (SELECT node FROM uppers WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, f.node AS folded_root,
       f.node = (SELECT node FROM uppers WHERE n = 1) AS verified
FROM numbered JOIN subroots USING (tree) LEFT JOIN proofs USING (id) JOIN folded f ON f.id = numbered.id AND f.lvl = coalesce(many, 0)
"""
