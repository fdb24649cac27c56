"""Structured Streaming over event tables, and the batch twins of what streams keep.

The same transformations run on static and streaming frames; ts is cast from a zone-less timestamp, which watermarks need.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files; in production the same schema comes from a broker."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) by event time."""
    per = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return per.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    per = events.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, started, ended, n): runs of a user's events less than `gap` apart; ended is the last event's time plus the gap."""
    per = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event_id once within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def last_values(events: DataFrame) -> DataFrame:
    """(user_id, event_type, last_ts, last_value): telemetry as the last value by key; ties go to the larger event_id."""
    top = F.max_by("value", F.struct("ts", "event_id"))
    return events.groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"), top.alias("last_value"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, eid, value, n = state.get if state.exists else (0, -1, 0.0, 0)
    for b in batches:
        for t, i, v in zip(b["micros"], b["event_id"], b["value"], strict=True):
            n += 1
            if (t, i) > (at, eid):
                at, eid, value = int(t), int(i), float(v)
    state.update((at, eid, value, n))
    yield pd.DataFrame([{"user_id": key[0], "event_type": key[1], "last_value": value, "seen": n}])


def telemetry(events: DataFrame) -> DataFrame:
    """A stream of (user_id, event_type, last_value, seen), updated as events come: custom state per key, not per project in one process."""
    e = events.select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "value")
    return e.groupBy("user_id", "event_type").applyInPandasWithState(
        _fold, "user_id long, event_type string, last_value double, seen long", "at long, eid long, value double, n long", "update", GroupStateTimeout.NoTimeout
    )


def run_once(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> None:
    """Drain what is there into a parquet sink; a second call goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
