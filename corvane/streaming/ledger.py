"""The event ledger as streams: append-only ingest, idempotent apply, windowed counts, current state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Events as they arrive in a folder; event time as a timestamp, which watermarks need."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, window: str = "1 day", slide: str | None = None, late: str | None = "2 days") -> DataFrame:
    """Counts and sums by window and kind; events later than `late` are dropped by the watermark (None: the stream has one)."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    marked = stream if late is None else stream.withWatermark("ts", late)
    out = marked.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once, however often it is delivered within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def append_pending(stream: DataFrame, ledger: str, checkpoint: str):
    """Append to a ledger the events it doesn't hold. A replayed or empty batch changes nothing: each batch has its own folder, overwritten when run again."""

    def take(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["event_id"])
        try:
            held = spark.read.parquet(ledger).where(F.col("batch") != no).select("event_id")
            new = new.join(held, "event_id", "left_anti")
        except Exception as e:  # the first batch: nothing is there
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{ledger}/batch={no}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def latest(stream: DataFrame) -> DataFrame:
    """user_id, event_type, event_id, value, changes: the state in force of each key, by a custom stateful operator.

    An event replaces the state if it is later (ties: the larger id); the state is a few numbers a key.
    """
    schema = "user_id long, event_type string, event_id long, value double, changes long"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, who, value, changes = state.get if state.exists else (-(2**62), -1, 0.0, 0)
        for p in parts:
            for t, i, v in zip(p["ts"].astype("int64"), p["event_id"], p["value"]):
                if (int(t), int(i)) > (at, who):
                    at, who, value, changes = int(t), int(i), float(v), changes + 1
        state.update((at, who, value, changes))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "event_id": [who], "value": [value], "changes": [changes]})

    keyed = stream.select("user_id", "event_type", "event_id", "ts", "value").groupBy("user_id", "event_type")
    return keyed.applyInPandasWithState(step, schema, "at long, who long, value double, changes long", "update", GroupStateTimeout.NoTimeout)
