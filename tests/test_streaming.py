"""Streams give what the batch gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.streaming import ledger

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(hours=7 * i), i % 5, "click" if i % 3 else "error", float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.where("event_id < 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("event_id >= 25").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # five events come twice
    return str(tmp_path / "in"), df, tmp_path


def run(stream, name, mode, tmp):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_windows(spark, folder):
    path, df, tmp = folder
    run(ledger.windowed(ledger.once(ledger.events(spark, path, 10), "60 days"), late=None), "w", "append", tmp)
    run(ledger.windowed(ledger.events(spark, path, 10)), "c", "complete", tmp)
    got = {(r.start, r.event_type): r.n for r in spark.table("c").collect()}
    assert sum(r.n for r in spark.table("w").collect()) <= 60  # each event once; the last window is still open
    twice = df.unionByName(df.where("event_id BETWEEN 25 AND 29"))
    want = {(r.s, r.event_type): r.n for r in twice.groupBy(F.date_trunc("day", "ts").alias("s"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_append_is_idempotent(spark, folder):
    path, df, tmp = folder
    for _ in range(2):
        q = ledger.append_pending(ledger.events(spark, path, 1), str(tmp / "ledger"), str(tmp / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [r.event_id for r in spark.read.parquet(str(tmp / "ledger")).collect()]
    assert sorted(got) == list(range(60))


def test_latest_state(spark, folder):
    path, df, tmp = folder
    run(ledger.latest(ledger.events(spark, path, 1)), "l", "update", tmp)
    got = {}
    for r in spark.table("l").collect():
        got[(r.user_id, r.event_type)] = max(got.get((r.user_id, r.event_type), -1), r.event_id)
    want = {(r.user_id, r.event_type): r.e for r in df.groupBy("user_id", "event_type").agg(F.max("event_id").alias("e")).collect()}
    assert got == want
