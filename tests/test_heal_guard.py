"""The heal guard over replayed batches."""

import datetime as dt
import json

import pytest

from loamwork.sources.store import TABLES, Change, Store
from loamwork.streaming import heal_guard

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
KIND = "family string, event string, url string, ts timestamp"


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    heal_guard.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder))


def test_one_claim_per_family_until_done_or_timed_out(spark, tmp_path, rocksdb):
    inbox, store = tmp_path / "in", Store(spark, str(tmp_path / "registry"))
    store.update(lambda s: Change({"families": spark.createDataFrame([(f, [], "Quote@1", "healthy", "t") for f in "abc"], TABLES["families"])}))

    def batch(*rows):
        feed(spark, inbox, list(rows))
        heal_guard.guard(spark.readStream.schema(KIND).parquet(str(inbox)), store, str(tmp_path / "checkpoint"), timeout=100, late="1 hour", now="t").awaitTermination()

    batch(("a", "drift", "u1", at(5)), ("a", "drift", "u0", at(3)), ("b", "drift", "v0", at(4)), ("a", "drift", "u2", at(6)), (None, "drift", "x", at(1)), ("b", "other", "x", at(1)))
    batch(("a", "drift", "u3", at(50)), ("b", "done", None, at(60)), ("b", "drift", "v1", at(61)), ("b", "drift", "v2", at(62)), ("c", "done", None, at(1)))
    batch(("a", "drift", "u4", at(102)), ("a", "drift", "u5", at(103)), ("a", "drift", "u6", at(104)), ("b", "drift", "v3", at(160)))
    batch(("b", "done", None, at(161)), ("b", "drift", "v4", at(161)))

    now = store.read()
    rows = [(r.family, json.loads(r["data"])) for r in now.table("audit").orderBy("id").collect()]
    got = sorted((f, d["claimed_at"][11:19], d["url"]) for f, d in rows)
    assert got == [("a", "12:00:03", "u0"), ("a", "12:01:43", "u5"), ("b", "12:00:04", "v0"), ("b", "12:01:01", "v1"), ("b", "12:02:41", "v4")]
    assert {r.family: r.status for r in now.table("families").collect()} == {"a": "regenerating", "b": "regenerating", "c": "healthy"}
    assert [r.id for r in now.table("audit").orderBy("id").collect()] == [1, 2, 3, 4, 5]


def test_a_replayed_batch_claims_nothing_twice(spark, tmp_path, rocksdb):
    """The stream starts anew from an empty checkpoint, as after a lost one: the registry has each claim once."""
    inbox, store = tmp_path / "in", Store(spark, str(tmp_path / "registry"))
    feed(spark, inbox, [("a", "drift", "u0", at(3)), ("b", "drift", "v0", at(4))])
    for n in range(2):
        heal_guard.guard(spark.readStream.schema(KIND).parquet(str(inbox)), store, str(tmp_path / f"checkpoint{n}"), now="t").awaitTermination()
    assert store.read().table("audit").count() == 2


def test_timers_free_the_state(spark, tmp_path, rocksdb):
    """Once the watermark has passed a claim's end its family has no state left."""
    inbox, out = tmp_path / "in", tmp_path / "out"

    def batch(*rows):
        feed(spark, inbox, list(rows))
        q = heal_guard.claims(spark.readStream.schema(KIND).parquet(str(inbox)), timeout=10, late="0 seconds").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    batch(("a", "drift", "u0", at(0)))
    batch(("z", "done", None, at(1000)))
    batch(("z", "done", None, at(1001)))
    state = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "claim").load()
    assert state.count() == 0
    batch(("a", "drift", "u1", at(2000)))
    assert sorted(r.url for r in spark.read.parquet(str(out)).collect()) == ["u0", "u1"]
