"""Approximate nearest neighbours: multiprobe cross-polytope hashing, exact reranking."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.llm.common import batch, documents, saved

#: Vectors of the sample that the number of tables is fitted on, and its queries.
FIT_ROWS, FIT_QUERIES = 16_000, 120
#: Comparisons of two vectors that take as long as the exchange of one row, about.
ROW_WORK = 200
#: Distinct vectors that one block of a bucket holds, about.
BLOCK = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """Tables of `joint` pseudo-rotations each: three rounds of random signs and a Hadamard transform."""

    def __init__(self, width: int, tables: int, longest: float, even: bool, joint: int = 1, seed: int = 4242):
        self.longest, self.even, self.joint, self.tables = longest, even, joint, tables
        self.size = 1 << max(0, (width + (not even) - 1).bit_length())
        draw = np.random.default_rng(seed)
        self.signs = draw.choice([-1.0, 1.0], (tables, joint, 3, self.size))

    def _unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors; of unequal ones a further component makes the inner product decide, not the angle."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query or self.even:
            x, rest = x / norm, np.zeros((len(x), 1))
        else:
            x = x / self.longest
            rest = np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        out = np.zeros((len(x), self.size))
        out[:, : x.shape[1]] = x
        if not self.even:
            out[:, x.shape[1]] = rest[:, 0]
        return out

    def _sides(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        for s in self.signs[table, part]:
            x = hadamard(x * s)
        return np.concatenate([x, -x], 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table: the nearest signed axis."""
        u = self._unit(x, False)
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for j in range(self.joint):
                out[:, t] = out[:, t] * 2 * self.size + self._sides(u, t, j).argmax(1)
        return out

    def probes(self, x: np.ndarray, many: int) -> np.ndarray:
        """The `many` best buckets of each query in each table, by the sum of its nearness to their axes."""
        u = self._unit(x, True)
        out = np.zeros((len(x), self.tables, many), np.int64)
        for t in range(self.tables):
            code, value = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for j in range(self.joint):
                side = self._sides(u, t, j)
                best = np.argsort(-side, axis=1, kind="stable")[:, :many]
                code = (code[:, :, None] * 2 * self.size + best[:, None, :]).reshape(len(x), -1)
                value = (value[:, :, None] + np.take_along_axis(side, best, 1)[:, None, :]).reshape(len(x), -1)
            order = np.argsort(-value, axis=1, kind="stable")[:, :many]
            out[:, t, : order.shape[1]] = np.take_along_axis(code, order, 1)
        return out


class Scan:
    """One bucket of all: every query meets every vector, in blocks."""

    tables = 1

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.zeros((len(x), 1), np.int64)

    def probes(self, x: np.ndarray, many: int) -> np.ndarray:
        return np.zeros((len(x), 1, 1), np.int64)


def fit(sample: np.ndarray, longest: float, even: bool, k: int, probes: int, joint: int, target: float, most: int = 48, most_probes: int = 256) -> tuple[CrossPolytope | Scan, int]:
    """As few tables as find `target` of the sample's true neighbours, and the probes that takes: these double
    while `most` tables don't suffice. Brute force on the sample is the measure. If `most_probes` don't suffice
    either, or the sample has too few rows to tell, a scan of all.

    A sample's neighbours lie farther off than the whole table's, so this is on the safe side."""
    index = CrossPolytope(sample.shape[1], most, longest, even, joint)
    if len(sample) <= 4 * k:
        return Scan(), 1
    most_probes = min(most_probes, (2 * index.size) ** joint)
    probes = min(probes, most_probes)
    asked = np.arange(min(FIT_QUERIES, len(sample)))
    near = sample[asked] @ sample.T
    near[asked, asked] = -np.inf
    true = np.argpartition(-near, k, axis=1)[:, :k]
    codes = index.codes(sample)
    while True:
        wanted, found = index.probes(sample[asked], probes), np.zeros(true.shape, bool)
        for t in range(most):
            found |= (codes[true, t][:, :, None] == wanted[:, t][:, None, :]).any(2)
            if found.mean() >= target:
                index.tables = t + 1
                return index, probes
        if probes >= most_probes:
            return Scan(), 1
        probes = min(2 * probes, most_probes)


def work(index: CrossPolytope, probes: int, sample: np.ndarray, rows: int, asked: int) -> tuple[float, float]:
    """Comparisons, and exchanged rows as comparisons, for so many rows and queries; by the sample's buckets."""
    looks = index.probes(sample[:FIT_QUERIES], probes)
    codes, met = index.codes(sample), 0
    for t in range(index.tables):
        used, n = np.unique(codes[:, t], return_counts=True)
        at = np.minimum(np.searchsorted(used, looks[:, t]), len(used) - 1)
        met += np.where(used[at] == looks[:, t], n[at], 0).sum()
    return asked * rows * met / len(looks) / len(sample), float(ROW_WORK) * index.tables * (rows + asked * probes)


def chosen(sample: np.ndarray, longest: float, even: bool, k: int, probes: int, target: float, rows: int, asked: int) -> tuple[CrossPolytope | Scan, int]:
    """The index of one axis a bucket; or of pairs of axes, if that meets the target too with less work. It can
    be so only where comparisons outweigh the exchange, so only there it is fitted."""
    index, many = fit(sample, longest, even, k, probes, 1, target)
    if isinstance(index, Scan):
        return index, many
    compared, exchanged = work(index, many, sample, rows, asked)
    if compared > exchanged:
        finer, more = fit(sample, longest, even, k, probes, 2, target)
        if not isinstance(finer, Scan) and sum(work(finer, more, sample, rows, asked)) < compared + exchanged:
            return finer, more
    return index, many


def nearest(df: DataFrame, queries: str, k: int = 20, key: str = "vec_id", vector: str = "embedding", probes: int = 4, joint: int | None = None, target: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows for which SQL `queries` holds, the k found with the largest inner product.

    Every vector is in one bucket per table: its nearest signed axis after a pseudo-rotation (`joint` of
    them for finer buckets; by default one, or two if that takes less work at the table's size). A query looks into the `probes` nearest buckets of each table. All vectors of
    these are compared exactly, in double precision; a bucket's vectors are dealt over blocks of a
    bounded size, each met by the bucket's queries, and a block returns its k + 1 best per query, so
    pairs never leave it. The number of tables, and if need be more probes, are fitted on a bounded
    sample to a recall of `target`; if that is missed, each query is compared with every vector, in blocks.

    Equal vectors are one entry with its k + 1 least ids, which is all that k neighbours can need; equal
    queries are asked once. Ties go to the smaller id; a query's own row is no candidate; fewer
    candidates give fewer ranks. Null, zero and empty vectors, ones with null or non-finite components, ones
    of another than the most frequent length, and null ids take no part. A repeated id counts as one per
    vector. An empty table gives no rows. Other columns are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.expr(f"coalesce({queries}, false)").alias("asked"))
    rows = rows.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("most"), F.min(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("least"))
    common = widths.orderBy(F.desc("n"), F.desc("w")).limit(1).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, longest = common["w"], float(np.sqrt(common["most"]))
    even = common["least"] >= common["most"] * (1 - 1e-5)
    rows = rows.where(F.size("v") == width)
    keep = k + 1

    def gather(batches):  # per task: least ids of each distinct vector
        schema = pa.schema([("digest", pa.binary()), ("v", pa.binary()), ("ids", pa.list_(pa.int64())), ("asked", pa.bool_())])
        own: dict[bytes, list] = {}

        def out():
            vs = list(own)
            for a in range(0, len(vs), 5000):
                part = vs[a : a + 5000]
                yield batch(schema, [hashlib.md5(v).digest() for v in part], part, [sorted(own[v][0]) for v in part], [own[v][1] for v in part])
            own.clear()

        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) + 0.0
            for i, v, q in zip(b.column(0).to_pylist(), flat, b.column(2).to_pylist()):
                x = own.setdefault(v.tobytes(), [set(), False])
                x[0].add(i)
                x[1] |= q
                if len(x[0]) > keep:
                    x[0].remove(max(x[0]))
            if len(own) > 100_000:
                yield from out()
        yield from out()

    entries = rows.mapInArrow(gather, "digest binary, v binary, ids array<long>, asked boolean").groupBy("digest").agg(
        F.first("v").alias("v"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"), F.max("asked").alias("asked"))
    entries = saved(entries, "vectors")
    asked = rows.where("asked").select(F.col("id").alias("query_id"), "v")

    def digest(batches):
        schema = pa.schema([("query_id", pa.int64()), ("digest", pa.binary())])
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) + 0.0
            yield batch(schema, b.column(0).to_pylist(), [hashlib.md5(v.tobytes()).digest() for v in flat])

    asked = asked.mapInArrow(digest, "query_id long, digest binary").distinct()
    drawn = entries.orderBy("digest").limit(FIT_ROWS).select("v").collect()
    sample = np.array([np.frombuffer(r["v"]) for r in drawn])
    if joint:
        index, probes = fit(sample, longest, even, k, probes, joint, target)
    else:
        index, probes = chosen(sample, longest, even, k, probes, target, entries.count(), entries.where("asked").count())
    shared = spark.sparkContext.broadcast(index)
    tables = index.tables

    def place(batches):
        schema = pa.schema([("digest", pa.binary()), ("v", pa.binary()), ("ids", pa.list_(pa.int64())), ("asked", pa.bool_()), ("codes", pa.list_(pa.int64())), ("probes", pa.list_(pa.int64()))])
        index = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                x = np.array([np.frombuffer(v) for v in part.column(1).to_pylist()])
                ask = np.array(part.column(3).to_pylist(), bool)
                looks = [None] * len(x)
                for i, p in zip(np.flatnonzero(ask), index.probes(x[ask], probes) if ask.any() else ()):
                    looks[i] = p.ravel().tolist()
                yield batch(schema, *[part.column(i) for i in range(4)], index.codes(x)[:, :tables].tolist(), looks)

    placed = saved(entries.mapInArrow(place, "digest binary, v binary, ids array<long>, asked boolean, codes array<long>, probes array<long>"), "placed")
    # one row for each bucket in use
    sizes = placed.select(F.posexplode("codes").alias("t", "code")).groupBy("t", "code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    base = placed.select("digest", "v", F.col("ids")[0].alias("least"), F.posexplode("codes").alias("t", "code")).join(sizes, ["t", "code"]).select(
        "t", "code", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("query"), "digest", "v", "least")
    look = placed.where("asked").select("digest", "v", F.posexplode("probes").alias("at", "code")).select("digest", "v", (F.col("at") / probes).cast("int").alias("t"), "code").join(sizes, ["t", "code"]).select(
        "t", "code", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("query"), "digest", "v", F.lit(None).cast("long").alias("least"))
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.union(look).withColumn("task", F.pmod(F.xxhash64("t", "code", "block"), F.lit(parts)))

    def compare(table: pa.Table) -> pa.Table:
        t = {n: table.column(n).to_pylist() for n in ("t", "code", "block", "query", "digest", "v", "least")}
        by: dict[tuple, tuple[list, list]] = {}
        for i, where in enumerate(zip(t["t"], t["code"], t["block"])):
            by.setdefault(where, ([], []))[t["query"][i]].append(i)
        out_q, out_c, out_s = [], [], []
        for own, ask in by.values():
            if not own or not ask:
                continue
            own.sort(key=t["least"].__getitem__)
            x, q = (np.array([np.frombuffer(t["v"][i]) for i in at]) for at in (own, ask))
            near = q @ x.T
            for row, i in enumerate(ask):
                s = near[row]
                if len(own) > 2 * keep:  # all that could be among the best, ties and rounding included
                    edge = np.partition(s, len(s) - keep)[len(s) - keep]
                    at = np.flatnonzero(s >= edge - 1e-9 * max(1.0, abs(edge)))
                else:
                    at = np.arange(len(own))
                exact = (x[at] * q[row]).sum(1)
                order = np.lexsort((at, -exact))[:keep]
                out_q += [t["digest"][i]] * len(order)
                out_c += [t["digest"][own[j]] for j in at[order]]
                out_s += exact[order].tolist()
        return pa.table({"q": pa.array(out_q, pa.binary()), "c": pa.array(out_c, pa.binary()), "score": pa.array(out_s, pa.float64())})

    best = dealt.groupBy("task").applyInArrow(compare, "q binary, c binary, score double").groupBy("q", "c").agg(F.max("score").alias("score"))
    named = best.join(entries.select(F.col("digest").alias("c"), "ids"), "c")
    top = named.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("n") <= keep)
    found = asked.join(top.select(F.col("q").alias("digest"), "score", "ids"), "digest").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(documents(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
