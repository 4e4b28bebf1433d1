"""Streaming forms of validation and run counters (an extension: records arrive as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamwork.operators.route import rate_slots
from loamwork.operators.validate import validate
from loamwork.sources.schemas import Schema
from loamwork.sources.shared import kept


def validate_stream(items: DataFrame, schema: Schema, path: str, checkpoint: str, by: str = "page_id") -> StreamingQuery:
    """Validates each micro-batch and appends its reports to Parquet; a replayed batch overwrites its own part."""

    def write(batch: DataFrame, n: int) -> None:
        validate(batch, schema, by).drop("fill_rates").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_runs(runs: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, family, runs, successes) from a stream of (ts, family, ok); rows later than `late` are dropped."""
    return runs.withWatermark("ts", late).groupBy(F.window("ts", width), "family").agg(F.count("*").alias("runs"), F.count_if("ok").alias("successes"))


def slots_stream(requests: DataFrame, path: str, checkpoint: str, max_rps: float = 1.0) -> StreamingQuery:
    """Slots of a stream of requests (host, ord), over its batches as if they were one: `path`/slots has them, `path`/counts the
    requests of each host and batch, of which earlier batches' say where a host goes on. A replayed batch overwrites its own
    parts and reads only those of batches before it."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        kind = "host string, n long, batch long"
        counts = spark.read.schema(kind).option("basePath", f"{path}/counts").parquet(*[f"{path}/counts/batch={k}" for k in range(n)]) if n else spark.createDataFrame([], kind)
        own = kept(batch, "requests")
        own.groupBy("host").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={n}")
        taken = counts.groupBy("host").agg(F.sum("n").alias("n"))
        rate_slots(own, max_rps, taken).write.mode("overwrite").parquet(f"{path}/slots/batch={n}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
