"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from py4j.protocol import Py4JError

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is missing, a local one, as in tests: only on a local master."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        at = spark.sparkContext.getCheckpointDir()
    return at


_made: dict[str, SparkSession] = {}


def temporary(spark: SparkSession, tag: str) -> str:
    """A folder's path in the shared folder, of its own name; the folder is deleted when this process ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_delete_all)
    _made[path] = spark
    return path


def _delete_all() -> None:
    for path, spark in _made.items():
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except (Py4JError, OSError, AttributeError, TypeError):  # the session has ended
            return


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: its lineage ends there, so what is lost of later
    work is made anew from the file, never from a second run of df. The file stays until this process ends."""
    path = temporary(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
