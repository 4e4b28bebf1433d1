"""One heal in flight per family: drift events claim it, later ones are dropped until it is done or has timed out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from loamwork.operators import registry
from loamwork.sources.store import Change, Snapshot, Store

CLAIMS = "family string, claimed_at timestamp, url string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HealGuard(StatefulProcessor):
    """State of a family: when it was claimed. A claim ends with a `done` event, or `timeout` seconds after it was made: for
    events that come later at once, and by a timer, which frees the state once the watermark has passed."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "at_us long")

    def _free(self) -> None:
        if self.claim.exists():
            self.claim.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a batch's events of a family, by time; of one moment, what ends a heal comes first
        events = pd.concat(list(rows), ignore_index=True)
        events = events.assign(us=events["ts"].astype("datetime64[us]").astype("int64"), first=(events["event"] != "done").astype(int)).sort_values(["us", "first", "url"], kind="stable", na_position="first")
        at = self.claim.get()[0] if self.claim.exists() else None
        made = []
        for ts, us, event, url in zip(events["ts"], events["us"], events["event"], events["url"]):
            if at is not None and us >= at + self.timeout * 1_000_000:
                at = None
            if event == "done":
                at = None
            elif event == "drift" and at is None:
                at = us
                made.append((key[0], ts, url))
        self._free()
        if at is not None:
            self.claim.update((at,))
            self.handle.registerTimer(at // 1000 + self.timeout * 1000)
        yield pd.DataFrame(made, columns=["family", "claimed_at", "url"]).astype({"claimed_at": "datetime64[us]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._free()
        return iter([])

    def close(self) -> None:
        pass


def claims(events: DataFrame, timeout: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(family, claimed_at, url): of a stream of (family, event, url, ts) those drift events that start a heal.

    `event` is drift or done; others, and rows without a family or time, change nothing. A family has one claim until its
    done event, or for `timeout` seconds: what drifts meanwhile is dropped, over any number of batches and restarts, as the
    state is checkpointed. Events later than the watermark are dropped. Needs the RocksDB state store (use_rocksdb)."""
    rows = events.where("family is not null and ts is not null and event in ('drift', 'done')").withWatermark("ts", late)
    return rows.select("family", "event", "url", "ts").groupBy("family").transformWithStateInPandas(statefulProcessor=HealGuard(timeout), outputStructType=CLAIMS, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def guard(events: DataFrame, store: Store, checkpoint: str, timeout: int = 3600, late: str = "10 minutes", now: str | None = None) -> StreamingQuery:
    """Claims of a stream, kept in the registry: the family becomes `regenerating`, and the audit has one heal_claimed row
    for each claim. A batch that is replayed after a failure writes nothing twice: a claim's row names its time."""

    def write(batch: DataFrame, n: int) -> None:
        made = batch.persist()
        try:
            names = [r["family"] for r in made.select("family").distinct().limit(1001).collect()]
            if not names:
                return

            def change(s: Snapshot) -> Change:
                at = F.date_format("claimed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                new = made.select("family", F.lit("heal_claimed").alias("event"), F.struct(at.alias("claimed_at"), "url").alias("data"))
                seen = s.table("audit").where("event = 'heal_claimed'").select("family", F.get_json_object("data", "$.claimed_at").alias("_at"))
                new = new.join(seen, (new["family"] == seen["family"]) & (new["data.claimed_at"] == seen["_at"]), "left_anti")
                last = s.table("audit").agg(F.max("id")).first()[0] or 0
                families = s.table("families").join(made.select("family").distinct().withColumn("_c", F.lit(True)), "family", "left")
                families = families.withColumn("status", F.when(F.col("_c"), "regenerating").otherwise(F.col("status"))).drop("_c")
                return Change({"families": families}, {"audit": registry.audit_rows(new, last, now)}, frozenset(names if len(names) <= 1000 else "*"))

            store.update(change)
        finally:
            made.unpersist()

    return claims(events, timeout, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
