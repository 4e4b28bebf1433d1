"""Sharding by extendible hashing, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.llm.common import documents, fresh, saved

#: Bits of hash in use.
BITS = 60
LIMIT = 1 << 20


def shards(df: DataFrame, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, digest, copy, bytes, shard, depth, shard_bytes, shard_docs: the shard of each row.

    A shard is a prefix of hash bits, written as 0s and 1s; depth is its length. The directory begins
    with one empty prefix; each prefix whose rows have more than `limit` bytes of UTF-8 text is split
    on one bit more, the others stay. Bytes are summed by cells of a fine prefix first (partial sums,
    then one row per cell), and all splits of a round are decided on cells; rows of cells that are
    still too large go on to a round with more bits.

    The hash is of key, text and number among equal rows, so no key and no group of copies is bound to
    one shard. Should several rows share all BITS bits and still be over the limit, it raises ValueError. A single row above the limit is a shard of its own. Null and empty texts have 0 bytes;
    a null key is hashed as the word null. An empty table gives no rows. Other columns are left out.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("bytes")))
    hashed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", "copy"))
    rows = saved(rows.withColumn("h", F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")), "hashed")

    total = rows.agg(F.sum("bytes")).first()[0] or 0
    fine = min(BITS, max(1, (total // limit).bit_length() + 3))
    left, base, done = rows, 0, []
    while True:
        cells = left.groupBy(F.expr(f"shiftright(h, {BITS - fine})").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        levels = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(base), F.lit(fine))).alias("d")).withColumn("prefix", F.expr(f"shiftright(cell, {fine} - d)"))
        sums = levels.groupBy("d", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        full = sums.where((F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)).select("d", "prefix")
        deep = levels.join(full, ["d", "prefix"], "left_semi").groupBy("cell").agg((F.max("d") + 1).alias("depth"))
        found = cells.select("cell").join(deep, "cell", "left").select("cell", F.coalesce("depth", F.lit(base)).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {fine} - depth)"))
        known = saved(found.join(sums.withColumnRenamed("d", "depth"), ["depth", "prefix"], "left"), "directory")
        own = left.withColumn("cell", F.expr(f"shiftright(h, {BITS - fine})")).join(known, "cell")
        done.append(own.where(F.col("depth") <= fine))
        if known.where(F.col("depth") > fine).isEmpty():
            break
        if fine == BITS:
            raise ValueError(f"more than {limit} bytes of several rows share all {BITS} bits of hash")
        left = own.where(F.col("depth") > fine).select(*rows.columns)
        base, fine = fine + 1, min(BITS, fine + 12)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    shard = F.expr("if(depth = 0, '', lpad(bin(prefix), depth, '0'))")
    return out.select("doc_id", "digest", "copy", "bytes", shard.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")


def write_shards(df: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> None:
    """Writes df as Parquet, one folder per shard (shard=<prefix>), its rows in one file. A column of df named shard
    is written as shard_ (with more of these if need be); other columns keep their names."""
    of = shards(df, limit, text, key).select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), F.col("copy").alias("of_copy"), F.col("shard").alias("of_shard"))
    digest, copy, named = fresh(df, "digest"), fresh(df, "copy"), "shard_"
    while named in df.columns:
        named += "_"
    own = df.withColumn(digest, F.md5(F.coalesce(F.col(text), F.lit(""))))
    own = own.withColumn(copy, F.row_number().over(Window.partitionBy(key, digest).orderBy(F.lit(1))))
    both = own.join(of, own[key].eqNullSafe(of["of_id"]) & (own[digest] == of["of_digest"]) & (own[copy] == of["of_copy"]))
    both.select(*[own[c].alias(named if c == "shard" else c) for c in df.columns], of["of_shard"].alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir)).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs")


OP8_SQL = f"""
WITH numbered AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(strlen(text), 0)::BIGINT AS bytes,
         row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, ''))) AS copy FROM documents),
rows AS (SELECT *, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), digest, copy::VARCHAR)), 1, 15))::BIGINT AS h FROM numbered),
levels AS (SELECT d, h >> ({BITS} - d) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
           FROM rows, (SELECT unnest(range(0, 33))::INT AS d) GROUP BY ALL),
own AS (SELECT doc_id, bytes, h, digest, copy, coalesce(max(d) + 1, 0)::INT AS depth
        FROM rows LEFT JOIN (SELECT * FROM levels WHERE shard_bytes > {LIMIT} AND shard_docs > 1) f ON h >> ({BITS} - d) = f.prefix
        GROUP BY ALL)
SELECT doc_id, bytes, CASE WHEN own.depth = 0 THEN '' ELSE right(lpad(bin(l.prefix), 64, '0'), own.depth) END AS shard, own.depth, shard_bytes, shard_docs
FROM own JOIN levels l ON l.d = own.depth AND l.prefix = own.h >> ({BITS} - own.depth)
"""
