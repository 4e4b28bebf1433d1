"""Stored pages, fixtures and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.text import snapshot_name


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def snapshots(fetched: DataFrame) -> DataFrame:
    """(url, name, html): the last page stored for each URL; fetched has url, html and an order column ord."""
    last = fetched.groupBy("url").agg(F.max_by("html", "ord").alias("html"))
    return last.select("url", snapshot_name(F.col("url")).alias("name"), "html")


def write_snapshots(fetched: DataFrame, path: str) -> None:
    snapshots(fetched).write.mode("overwrite").parquet(path)


def pair_fixtures(files: DataFrame) -> DataFrame:
    """(family, sample, html, expected): golden pages with their records, from files (family, name, body).

    sample_*.html goes with sample_*.json; unpaired ones are left out; order is that of the names.
    """
    stem = F.regexp_extract("name", r"^(sample_.*)\.(html|json)$", 1)
    named = files.withColumn("sample", stem).where(F.col("sample") != "")
    html = named.where(F.col("name").endswith(".html")).select("family", "sample", F.col("body").alias("html"))
    records = named.where(F.col("name").endswith(".json")).select("family", "sample", F.col("body").alias("expected"))
    return html.join(records, ["family", "sample"])


def save_fixtures(fixtures: DataFrame, path: str) -> None:
    """Replaces the fixtures of the families in the frame; other families' stay."""
    fixtures.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("family").parquet(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines, as an audit mirror."""
    rows.write.mode("append").json(path)
