"""What the corpus operators share: words, hashing, blocks of documents, shared storage, components."""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Characters of text that one bucket of a bucketed exchange is meant to hold.
BUCKET_CHARS = 24_000_000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table; one that fills fewer scan tasks than there are cores is dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly the six characters of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHash(dict):
    """64-bit hashes by word; forgets all once it holds `most`, so memory stays bounded."""

    def __init__(self, most: int = 400_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that linear structure in a rolling hash does not survive."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(x: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of each run of `size` values."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, b = np.zeros(n, np.uint64), np.uint64(base)
    for k in range(size):
        h *= b
        h += x[k : k + n]
    return mix(h)


def blocks(batches, most_chars: int = 4_000_000, text: str = "text"):
    """Groups Arrow batches' rows into column lists holding about most_chars characters each."""
    rows: dict[str, list] = {}
    held = 0
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(i) for i in range(len(names))]
        at, of = 0, names.index(text)
        t = columns[of].to_pylist()
        sizes = [len(x) if x is not None else 0 for x in t]
        others = [t if i == of else c.to_pylist() for i, c in enumerate(columns)]
        rows = rows or {n: [] for n in names}
        for end, size in enumerate(sizes, 1):
            held += size + 8
            if held >= most_chars:
                for n, c in zip(names, others):
                    rows[n] += c[at:end]
                yield rows
                rows, held, at = {n: [] for n in names}, 0, end
        for n, c in zip(names, others):
            rows[n] += c[at:]
    if rows and any(rows.values()):
        yield rows


def trim() -> None:
    """Gives back the memory that allocators keep, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run):
    """run over batches, then trim."""

    def through(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return through


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def bucket_count(docs: DataFrame, text: str = "text", chars: int = BUCKET_CHARS) -> int:
    """Buckets of an exchange over all texts: they grow with the corpus, so that each stays of one size."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // chars))


_written: dict[str, SparkSession] = {}
_named: dict[str, str] = {}
#: As many buckets as Spark lets a table have, by default.
MOST_BUCKETS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the setting is missing, a local one, as in tests: only on a local master."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        at = spark.sparkContext.getCheckpointDir()
    return at


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_forget_all)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def saved_by(df: DataFrame, tag: str, by: str, parts: int) -> DataFrame:
    """As saved(), in buckets of the column `by`: what groups by it reads them without an exchange."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("path", path).bucketBy(min(parts, MOST_BUCKETS), by).saveAsTable(name)
    if not _written:
        atexit.register(_forget_all)
    _written[path], _named[path] = spark, name
    out = spark.table(name)
    out.saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table of saved() that nothing reads any more."""
    _delete(df.saved_at, _written.pop(df.saved_at))


def _delete(path: str, spark: SparkSession) -> None:
    if path in _named:
        spark.sql(f"drop table if exists {_named.pop(path)}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _forget_all() -> None:
    for path, spark in _written.items():
        try:
            _delete(path, spark)
        except Exception:  # the session has ended
            return


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, in any case: `name`, with underscores before it if need be."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def _meet(rows: DataFrame, least: DataFrame, on: str, edges: int) -> DataFrame:
    """rows with each one's m. The few centres of many edges, at most HEAVY of them, are broadcast, so that no task
    gets one centre's edges."""
    heavy = least.where(F.col("n") >= max(16, 2 * edges // HEAVY)).select(F.col(on).alias("_h"), F.col("m").alias("_hm"))
    split = rows.join(F.broadcast(heavy), F.col(on) == F.col("_h"), "left").drop("_h")
    light = split.where("_hm is null").drop("_hm").join(least.drop("n"), on)
    return light.select(*rows.columns, "m").union(split.where("_hm is not null").select(*rows.columns, F.col("_hm").alias("m")))


#: Centres whose edges are not exchanged, at most: those with this share of all edges' ends.
HEAVY = 1_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of any one orderable type: one row (node, root) per node, root the least node.

    Alternates large-star and small-star steps until the edges no longer change. A step gives each
    node's neighbours to the least of them: a pre-aggregated minimum and an equi-join, of which the centres with
    most edges are broadcast, so no node's neighbours are gathered in one task. Loops and nulls are dropped; no
    edges give no rows.
    """
    e = saved(edges.selectExpr("greatest(a, b) a", "least(a, b) b").where("a <> b").distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.selectExpr("a u", "b v").union(e.selectExpr("b u", "a v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _meet(both, least, "u", now[0]).where("v > u and v <> m").selectExpr("v a", "m b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _meet(large, least, "a", now[0]).where("b <> m").selectExpr("b a", "m b").union(least.selectExpr("a", "m b")).distinct()
        old, e = e, saved(small, "edges")
        forget(old)
    pairs = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return pairs.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(pairs, "node", "left_anti"))
