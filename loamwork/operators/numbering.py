"""Dense numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.sources.shared import kept

#: monotonically_increasing_id() holds the row's place in its partition in so many bits, the partition above them.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """df and three longs: `first` (rows before the row's group), `place` (0-based within the group), `size` (rows of
    the group). Groups are runs of equal values of `within`, nulls being equal; without it all rows are one group.

    Rows are range partitioned by `within` and `order` and sorted there; the partition and place of each row are
    written down once. Then only rows per (partition, group) are counted and summed up, and meet the rows again by
    (partition, group): a group may hold any share of all rows. Numbers depend on the order alone, not on the number of
    partitions or on retries, as far as the order is total; rows that it leaves equal get some order. A third of all
    rows being equal in all of `order` would be one partition: end such an order with something that varies.
    """
    within = within or []
    keys = [F.col(c).asc_nulls_first() for c in within]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = kept(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    runs = rows.groupBy("_part", *within).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    # one number per partition: as many as the exchange had, not as the rows
    parts = sorted((r["_part"], r["n"]) for r in runs.groupBy("_part").agg(F.sum("_n").alias("n")).collect())
    before, done = [], 0
    for part, n in parts:
        before.append((part, done))
        done += n
    offsets = df.sparkSession.createDataFrame(before, "_of long, _before long")
    runs = runs.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).withColumn("_first", F.expr(f"_before + (_from & ((1L << {PLACE_BITS}) - 1))"))
    groups = runs.groupBy(*within).agg(F.min("_first").alias("first"), F.sum("_n").alias("size"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in within]
    runs = runs.alias("r").join(groups.alias("g"), same or F.lit(True)).select("r._part", *[F.col(f"r.{c}").alias(f"_k{i}") for i, c in enumerate(within)], "_from", "_first", "first", "size")
    on = (rows["_part"] == runs["_part"]) if not within else [rows["_part"] == runs["_part"], *[rows[c].eqNullSafe(runs[f"_k{i}"]) for i, c in enumerate(within)]]
    return rows.join(runs, on).select(*[rows[c] for c in df.columns], "first", F.expr("_first + _at - _from - first").alias("place"), "size")


def dense_ids(df: DataFrame, order: list[Column], name: str = "id", after: int = 0) -> DataFrame:
    """df and `name`: after + 1, after + 2, ... in `order`; an empty table gives no rows."""
    return numbered(df, order).select(*df.columns, (F.col("place") + 1 + after).alias(name))
