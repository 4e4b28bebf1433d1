"""Dense numbers: in order, whole, and the same under any number of partitions."""

import pytest
from pyspark.sql import functions as F

from loamwork.operators.numbering import dense_ids, numbered


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ids_do_not_depend_on_partitions(spark, parts):
    rows = [(k * 37 % 200, k % 3) for k in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = dense_ids(spark.createDataFrame(rows, "t int, k int").repartition(parts), [F.col("t")], after=5).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.id, r.t) for r in got] == [(6 + i, i) for i in range(200)]


def test_numbers_within_groups_of_any_size(spark):
    groups = [None] * 3 + ["a"] * 500 + ["b"] + ["é"] * 40
    df = spark.createDataFrame([(g, i * 7919 % 100_003) for i, g in enumerate(groups)], "g string, t int")
    got = numbered(df, [F.col("t")], within=["g"]).collect()
    want, first = {}, 0
    for g in (None, "a", "b", "é"):
        own = sorted(i * 7919 % 100_003 for i, x in enumerate(groups) if x == g)
        want |= {(g, t): (first, k, len(own)) for k, t in enumerate(own)}
        first += len(own)
    assert {(r.g, r.t): (r["first"], r.place, r.size) for r in got} == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, t int")
    assert numbered(df, [F.col("t")], within=["g"]).count() == 0 and dense_ids(df, [F.col("t")]).count() == 0
