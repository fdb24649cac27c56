"""The life of jobs as a stream of their events: a state machine per project with a map of its nodes and a timer for its heartbeat.

An event is (event_id, ts, project_id, kind, node_id). START (also from PAUSED) and RESUME lead to RUNNING, PAUSE to PAUSED,
STOP to STOPPED, FINISHED to IDLE; nodes are STARTED, DONE, FAILED or sent to REVIEW. A job that runs and gives no sign of life
for as long as `stale` has crashed: it is IDLE again. Whatever was under way then, or when a job starts, waits again; RETRY
also sends failed nodes and those under review back.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a kind of event does to a job: the states it applies in (None: any) and the state it leads to.
MOVES = {
    "START": (("IDLE", "STOPPED", "PAUSED"), "RUNNING"), "RETRY": (("IDLE", "STOPPED", "PAUSED"), "RUNNING"), "PAUSE": (("RUNNING",), "PAUSED"),
    "RESUME": (("PAUSED",), "RUNNING"), "STOP": (None, "STOPPED"), "FINISHED": (("RUNNING",), "IDLE"),
}
NODE_STATES = {"NODE_STARTED": "TRANSLATING", "NODE_DONE": "TRANSLATED", "NODE_FAILED": "FAILED", "NODE_REVIEW": "NEEDS_REVIEW"}
#: Events that send nodes back to PENDING, and from which states.
RESET = {"START": ("TRANSLATING",), "STALE": ("TRANSLATING",), "RETRY": ("TRANSLATING", "FAILED", "NEEDS_REVIEW")}
TRANSITIONS = "project_id string, micros long, event_id long, kind string, before string, after string, nodes_reset long"


class Job:
    """One project's job. nodes is a dict of states, or anything with items(), get and item assignment."""

    def __init__(self, status: str, last: int, nodes: Any, stale: int) -> None:
        self.status, self.last, self.nodes, self.stale = status, last, nodes, stale

    def _reset(self, kind: str) -> int:
        back = [n for n, s in self.nodes.items() if s in RESET.get(kind, ())]
        for n in back:
            self.nodes[n] = "PENDING"
        return len(back)

    def silent(self, now: int) -> list[tuple]:
        """The transition of a crash, where the job has been silent for too long by now."""
        if self.status != "RUNNING" or now - self.last <= self.stale:
            return []
        self.status = "IDLE"
        return [(self.last + self.stale, None, "STALE", "RUNNING", "IDLE", self._reset("STALE"))]

    def take(self, micros: int, event_id: int, kind: str, node: str | None) -> list[tuple]:
        """(micros, event_id, kind, before, after, nodes_reset) of the transitions that an event brings, a crash before it included."""
        out = self.silent(micros)
        self.last = max(self.last, micros)
        if kind in NODE_STATES and node is not None:
            self.nodes[node] = NODE_STATES[kind]
        if kind in MOVES:
            where, after = MOVES[kind]
            if where is None and self.status != after or where and self.status in where:
                out.append((micros, event_id, kind, self.status, after, self._reset(kind)))
                self.status = after
        return out


class _Nodes:
    """Map state as the dict that Job wants."""

    def __init__(self, state: Any) -> None:
        self.state = state

    def items(self) -> Iterator[tuple[str, str]]:
        return ((k[0], v[0]) for k, v in self.state.iterator())

    def __setitem__(self, node: str, status: str) -> None:
        self.state.updateValue((node,), (status,))


class Lifecycle(StatefulProcessor):
    """Keeps a job's status and last sign of life as a value, its nodes as a map, and one event-time timer at the time it would be stale."""

    def __init__(self, stale_micros: int) -> None:
        self.stale = stale_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, last long")
        self.nodes = handle.getMapState("nodes", "node_id string", "status string")

    def _load(self) -> Job:
        status, last = self.job.get() if self.job.exists() else ("IDLE", 0)
        return Job(status, last, _Nodes(self.nodes), self.stale)

    def _keep(self, project: str, job: Job, out: list[tuple]) -> Iterator[pd.DataFrame]:
        self.job.update((job.status, job.last))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if job.status == "RUNNING":
            self.handle.registerTimer((job.last + self.stale) // 1000 + 1)
        if out:
            yield _frame([(project, *t) for t in out])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, out = self._load(), []
        for r in pd.concat(rows).sort_values(["micros", "event_id"]).itertuples(index=False):
            out += job.take(int(r.micros), int(r.event_id), r.kind, r.node_id if isinstance(r.node_id, str) else None)
        yield from self._keep(key[0], job, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job = self._load()
        out = job.silent(int(expiredTimerInfo.getExpiryTimeInMs()) * 1000)
        yield from self._keep(key[0], job, out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in TRANSITIONS.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"event_id": "Int64"})


def _events(events: DataFrame) -> DataFrame:
    return events.select(F.coalesce(F.col("project_id").cast("string"), F.lit("")).alias("project_id"), "ts", F.unix_micros("ts").alias("micros"), "event_id", "kind", F.col("node_id").cast("string").alias("node_id"))


def transitions_stream(events: DataFrame, stale: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """TRANSITIONS of a stream of events (event_id, ts, project_id, kind, node_id); ts is a timestamp. Needs the RocksDB state store.

    Events of a trigger are taken in the order of their time; those later than `late` are dropped by the watermark's rule, and
    of those between, each is taken when it comes. A silent job's crash is told when the watermark passes it, or by the next
    event, at the same time either way. A restart goes on from the checkpoint. A project is one key, so its events are one
    task's work; its nodes are rows of the state store and not held in memory.
    """
    micros = int(pd.Timedelta(stale).total_seconds() * 1_000_000)
    e = _events(events.withWatermark("ts", late))
    return e.groupBy("project_id").transformWithStateInPandas(Lifecycle(micros), TRANSITIONS, "append", "EventTime")


def transitions(events: DataFrame, stale: str = "30 minutes", now: datetime | None = None) -> DataFrame:
    """TRANSITIONS of all events at once, in the order of their time; crashes after a job's last event are told up to `now`, where it is given.

    Rows of a project come to one task sorted and are folded as they stream by; only its nodes' states are held. Null
    projects are one; an unknown kind is a sign of life and no more.
    """
    micros = int(pd.Timedelta(stale).total_seconds() * 1_000_000)
    end = None if now is None else int(now.replace(tzinfo=now.tzinfo or UTC).timestamp() * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, job = None, None
        for b in batches:
            out: list[tuple] = []
            for p, at, event, kind, node in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if job is None or p != project:
                    out += [(project, *t) for t in job.silent(end)] if job and end is not None else []
                    project, job = p, Job("IDLE", 0, {}, micros)
                out += [(p, *t) for t in job.take(at, event, kind, node)]
            if out:
                yield _batch(out)
        if job and end is not None and (out := [(project, *t) for t in job.silent(end)]):
            yield _batch(out)

    e = _events(events).select("project_id", "micros", "event_id", "kind", "node_id")
    return e.repartition("project_id").sortWithinPartitions("project_id", "micros", "event_id").mapInArrow(run, TRANSITIONS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in TRANSITIONS.split(", ")]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in TRANSITIONS.split(", ")])
