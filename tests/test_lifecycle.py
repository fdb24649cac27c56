"""Jobs' lives: the stream equals the batch, also after a restart; the rule on a few events."""

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from lexiloom.streaming import lifecycle

EVENT = "event_id long, ts timestamp, project_id string, kind string, node_id string"
START = datetime(2024, 1, 1)
STATE = "spark.sql.streaming.stateStore.providerClass"


def told(df):
    return sorted((r["project_id"], r["micros"], r["kind"], r["before"], r["after"], r["nodes_reset"], r["event_id"] or 0) for r in df.collect())


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_the_rule(spark):
    rows = [
        (1, at(0), "p", "PAUSE", None), (2, at(1), "p", "START", None), (3, at(2), "p", "NODE_STARTED", "a"), (4, at(3), "p", "NODE_FAILED", "b"), (5, at(4), "p", "START", None), (6, at(5), "p", "PAUSE", None),
        (7, at(90), "p", "RESUME", None), (8, at(91), "p", "HEARTBEAT", None), (9, at(150), "p", "RETRY", None), (10, at(151), "p", "STOP", None), (11, at(152), "p", "STOP", None), (12, at(153), None, "FINISHED", None),
    ]
    got = [x[2:6] for x in told(lifecycle.transitions(spark.createDataFrame(rows, EVENT)))]
    assert got == [("START", "IDLE", "RUNNING", 0), ("PAUSE", "RUNNING", "PAUSED", 0), ("RESUME", "PAUSED", "RUNNING", 0), ("STALE", "RUNNING", "IDLE", 1), ("RETRY", "IDLE", "RUNNING", 1), ("STOP", "RUNNING", "STOPPED", 0)]
    one = spark.createDataFrame(rows[1:2], EVENT)
    assert [x[2] for x in told(lifecycle.transitions(one, now=at(40)))] == ["START", "STALE"] and [x[2] for x in told(lifecycle.transitions(one, now=at(31)))] == ["START"]
    assert lifecycle.transitions(one.limit(0)).count() == 0


def test_the_stream_equals_the_batch_and_restarts(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["START", "START", "PAUSE", "RESUME", "STOP", "FINISHED", "RETRY", "HEARTBEAT", "NODE_STARTED", "NODE_STARTED", "NODE_DONE", "NODE_FAILED", "NODE_REVIEW"]
    clock, rows = 0.0, []
    for i in range(400):
        clock += rng.expovariate(1 / 4)
        rows.append((i, at(clock), rng.choice(["p", "q", "r", None]), rng.choice(kinds), rng.choice(["a", "b", "c", None])))
    end = clock + 400
    rows.append((1000, at(end), "clock", "HEARTBEAT", None))  # the watermark passes the last timers
    for k in range(4):
        part = rows[k * 101 : (k + 1) * 101]
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    old = spark.conf.get(STATE)
    spark.conf.set(STATE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for take in ("{0,1}", "*"):  # the second run goes on from the first one's checkpoint
            stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / take))
            q = lifecycle.transitions_stream(stream, late="0 seconds").writeStream.outputMode("append").format("parquet")
            q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.set(STATE, old)
    got = told(spark.read.parquet(str(tmp_path / "out")))
    want = told(lifecycle.transitions(spark.createDataFrame(rows, EVENT), now=at(end)))
    assert got == want
    assert {x[2] for x in want} == {"START", "PAUSE", "RESUME", "STOP", "FINISHED", "RETRY", "STALE"} and any(x[5] for x in want)
