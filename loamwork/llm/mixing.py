"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.llm.common import WORD, documents, saved

#: A document is taken this often at most, so a source's target is at most as many times its size.
MOST = 3
#: Parts of the shuffled order and of the unit of virtual time, over which sums are pre-aggregated.
SLICES = 4096


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with each source's target words.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...; together they share the sum of all
    sizes. A target stops at MOST times its source's size; what is over goes to the others by weight,
    until none is above: with sources in order of cap / weight, level is what is left over a unit of
    the weights that are left, at the first source that it doesn't fill. One row per source.
    """
    names = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    return (
        sizes.withColumn("weight", (F.row_number().over(names) - 1) % 3 + 1)
        .withColumn("cap", MOST * F.col("source_size"))
        .withColumn("level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(from_here))
        .withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.row_number().over(fill).alias("i"), "level"))).over(all_)["level"])
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))
    )


def mix_sources(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """doc_id, digest, copy, source, size, source_size, target, n_taken, taken: how often the mix takes each row.

    Each source's rows are shuffled by a hash of key, text and pass; passes go on while the target is
    not reached, MOST at most. A row's virtual finish time is the source's words up to and with it, over
    the target. Rows of all sources in order of that time are taken until the sum of all sizes is
    reached. Running sums are two-level: sums by slice of the order first, then rows within a slice,
    so no source's rows meet in one task; only the slice of time that holds the cut is sorted by row.

    Size is the number of words of the whole text (null: 0). Equal rows are told apart by number (copy).
    A null source is a source. Null keys hash as the word null. Where there are no words, nothing is
    taken. An empty table gives no rows. Equal input gives equal output, however it is partitioned.
    Other columns are left out.
    """
    rows = df.select(
        F.col(key).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "digest", "source").orderBy("size")))
    rows = saved(rows, "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = plan.withColumn("passes", F.when(F.col("target") > 0, F.ceil(F.col("target") / F.col("source_size")).cast("int")).otherwise(1))
    due = rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    due = due.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", "copy", "pass")))
    due = due.withColumn("slice", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))

    each = ["source", "pass"]
    sums = due.groupBy(*each, "slice").agg(F.sum("size").alias("words"))
    offset = sums.select(F.col("source").alias("of"), F.col("pass").alias("in"), F.col("slice").alias("at"), (F.sum("words").over(Window.partitionBy(*each).orderBy("slice")) - F.col("words")).alias("offset"))
    order = Window.partitionBy(*each, "slice").orderBy("key", "doc_id", "digest", "copy")
    timed = due.join(offset, F.col("source").eqNullSafe(F.col("of")) & (F.col("pass") == F.col("in")) & (F.col("slice") == F.col("at"))).drop("of", "in", "at")
    timed = timed.withColumn("time", F.when(F.col("target") > 0, (F.col("pass") * F.col("source_size") + F.col("offset") + F.sum("size").over(order)) / F.col("target")))
    timed = saved(timed.withColumn("moment", F.least(F.floor(F.col("time") * SLICES), F.lit(1 << 20)).cast("int")).drop("offset", "slice", "passes"), "timed")

    budget = rows.agg(F.sum("size")).first()[0] or 0
    moments = timed.where("moment is not null").groupBy("moment").agg(F.sum("size").alias("words"))
    run = moments.select("moment", "words", F.sum("words").over(Window.orderBy("moment")).alias("till"))
    cut = run.where(F.col("till") > budget).orderBy("moment").limit(1).selectExpr("moment", "till - words as before").first()
    last, before = (cut["moment"], cut["before"]) if cut else (1 << 30, 0)
    inside = Window.orderBy("time", F.col("source").isNull(), "source", "pass", "key", "doc_id", "digest", "copy")
    edge = timed.where(F.col("moment") == last).withColumn("take", F.when(before + F.sum("size").over(inside) <= budget, 1).otherwise(0))
    rest = timed.where(F.col("moment").isNull() | (F.col("moment") != last)).withColumn("take", F.when(F.col("moment") < last, 1).otherwise(0))
    return edge.unionByName(rest).groupBy("doc_id", "digest", "copy", "source", "size", "source_size", "target").agg(F.sum("take").alias("n_taken")).withColumn("taken", F.col("n_taken") * F.col("size"))


def op10_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest, source ORDER BY size) AS copy FROM sized),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM numbered GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS l,
        row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS i FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((arg_min(l, i) FILTER (WHERE cap >= l * weight) OVER ()) * weight, 0)) AS target FROM f),
due AS (SELECT n.*, t.source_size, t.target, p.pass,
           md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), digest, copy::VARCHAR, p.pass::VARCHAR)) AS key
        FROM numbered n JOIN t ON n.source IS NOT DISTINCT FROM t.source
        JOIN (SELECT unnest([0, 1, 2]) AS pass) p ON p.pass < CASE WHEN target > 0 THEN ceil(target / source_size) ELSE 1 END),
timed AS (SELECT *, CASE WHEN target > 0 THEN (pass * source_size + sum(size) OVER (PARTITION BY source, pass ORDER BY key, doc_id, digest, copy
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / target END AS time FROM due),
run AS (SELECT *, sum(size) OVER (ORDER BY time, source IS NULL, source, pass, key, doc_id, digest, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till
        FROM timed WHERE time IS NOT NULL)
SELECT n.doc_id, n.size, t.source_size, t.target, coalesce(r.taken, 0)::BIGINT AS taken
FROM numbered n JOIN t ON n.source IS NOT DISTINCT FROM t.source
LEFT JOIN (SELECT doc_id, digest, source, copy, sum(CASE WHEN till <= (SELECT sum(size) FROM numbered) THEN size ELSE 0 END) AS taken
           FROM run GROUP BY ALL) r
ON n.doc_id IS NOT DISTINCT FROM r.doc_id AND n.digest = r.digest AND n.source IS NOT DISTINCT FROM r.source AND n.copy = r.copy
"""
