"""Residual fields and the merge that fills them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def residual_fields(found: DataFrame, known: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """(by, field): fields that the known records fill in some sample and the found ones in none of these.

    Both sides have by, sample and the fields; a page may have several records. One aggregate per side and
    sample, one join, one aggregate per field. The sides, a row a sample and field, meet sorted: neither goes through the driver.
    """
    def has(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(by, "sample").agg(*[F.bool_or(F.col(f).isNotNull()).alias(f) for f in fields]).unpivot([by, "sample"], fields, "field", side)

    both = has(known, "known").join(has(found, "found").hint("merge"), [by, "sample", "field"], "left").where("known")
    return both.groupBy(by, "field").agg(F.bool_or(F.coalesce("found", F.lit(False))).alias("some")).where("not some").select(by, "field")


def merge_records(records: DataFrame, tail: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """records with nulls filled from the page's tail record, and the tail's other fields added to every item."""
    t = tail.select(by, *[F.col(f).alias(f"_t_{f}") for f in fields])
    own = [F.coalesce(F.col(f), F.col(f"_t_{f}")).alias(f) if f in records.columns else F.col(f"_t_{f}").alias(f) for f in fields]
    rest = [c for c in records.columns if c not in fields]
    return records.join(t, by, "left").select(*rest, *own)
