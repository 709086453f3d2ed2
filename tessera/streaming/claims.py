"""Exclusive claims on a queue's jobs, and timers for silent ones, as keyed state of a stream.

A queue is a key: its events meet in one task in the order of time, so a job that is claimed is claimed once, whoever else
asks. State and checkpoint advance together; a batch that runs again starts from the state before it and gives the
same claims. A queue's jobs are a map in its state, one entry a job that hasn't ended; deal jobs to many queues.

Each claim and each beat sets an event-time timer. When the watermark passes it, running jobs that have been silent for longer than
allowed go back to the queue, or fail if that was their last attempt.

Events: enqueue (priority, most_attempts), claim (worker), beat (worker, job), done (worker, job), fail (worker, job, retryable).
Defined cases: a claim that finds no job gives nothing; a beat or an end by a worker that doesn't hold the job changes nothing; a job
enqueued again while it hasn't ended stays as it is; of events at one time the smaller id comes first; events later than the watermark allows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

STALE_MILLIS = 300_000
EVENTS = "queue long, event_id long, at timestamp, kind string, job long, worker string, priority int, most_attempts int, retryable boolean"
CHANGES = "queue long, job long, status string, worker string, attempt int, at_millis long, event_id long"
_JOB = StructType([StructField("status", StringType()), StructField("worker", StringType())] + [StructField(n, LongType()) for n in ("priority", "created", "beat")] + [StructField(n, IntegerType()) for n in ("attempt", "most")])


class Claims(StatefulProcessor):
    """The jobs of a queue, changed by its events and timers; gives a row for each change of a job's status."""

    def __init__(self, stale_millis: int = STALE_MILLIS):
        self.stale_millis = stale_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", StructType([StructField("id", LongType())]), _JOB)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        held = {k[0]: dict(zip(_JOB.names, v, strict=True)) for k, v in self.jobs.iterator()}
        before, out, millis = {k: dict(v) for k, v in held.items()}, [], 0
        for e in events.itertuples(index=False):
            millis = int(e.at.value // 1_000_000)
            changed = self._change(held, e, millis)
            if changed is not None:
                job, state = changed
                out.append((key[0], job, state["status"], state["worker"], state["attempt"], millis, e.event_id))
        self._keep(before, held)
        for due in {j["beat"] + self.stale_millis + 1 for j in held.values() if j["status"] == "RUNNING"} - {before[k]["beat"] + self.stale_millis + 1 for k in before if before[k]["status"] == "RUNNING"}:
            self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = {k[0]: dict(zip(_JOB.names, v, strict=True)) for k, v in self.jobs.iterator()}
        before, out = {k: dict(v) for k, v in held.items()}, []
        for job, state in sorted(held.items()):
            if state["status"] == "RUNNING" and state["beat"] + self.stale_millis < now:
                self._give_up(state, True)
                out.append((key[0], job, state["status"], None, state["attempt"], now, -1))
        self._keep(before, held)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def _change(self, held: dict, e, millis: int) -> tuple[int, dict] | None:
        state = held.get(e.job) if pd.notna(e.job) else None
        if e.kind == "enqueue":
            if state is None or state["status"] in ("SUCCEEDED", "FAILED"):
                held[int(e.job)] = {"status": "QUEUED", "worker": None, "priority": int(e.priority), "created": millis, "beat": 0, "attempt": 0, "most": int(e.most_attempts)}
                return int(e.job), held[int(e.job)]
        elif e.kind == "claim":
            queued = [(s["priority"], s["created"], j) for j, s in held.items() if s["status"] == "QUEUED"]
            if queued:
                job = min(queued)[2]
                held[job] |= {"status": "RUNNING", "worker": e.worker, "attempt": held[job]["attempt"] + 1, "beat": millis}
                return job, held[job]
        elif state is not None and state["status"] == "RUNNING" and state["worker"] == e.worker:
            if e.kind == "beat":
                state["beat"] = millis
            elif e.kind == "done":
                state["status"] = "SUCCEEDED"
                return int(e.job), state
            elif e.kind == "fail":
                self._give_up(state, bool(e.retryable))
                return int(e.job), state
        return None

    @staticmethod
    def _give_up(state: dict, retryable: bool) -> None:
        """Back to the queue while attempts are left, else failed for good; either way nobody holds the job."""
        state |= {"status": "QUEUED" if retryable and state["attempt"] < state["most"] else "FAILED", "worker": None}

    def _keep(self, before: dict, held: dict) -> None:
        """Write what has changed; jobs that have ended leave the state."""
        for job, state in held.items():
            if state["status"] in ("SUCCEEDED", "FAILED"):
                if job in before:
                    self.jobs.removeKey((job,))
            elif before.get(job) != state:
                self.jobs.updateValue((job,), tuple(state[n] for n in _JOB.names))

    def close(self) -> None:
        pass


def claims(events: DataFrame, late: str = "1 minute", stale_millis: int = STALE_MILLIS) -> DataFrame:
    """The changes of jobs' states, from a stream of EVENTS; the session's state store has to be the one of RocksDB."""
    keyed = events.withWatermark("at", late).groupBy("queue")
    return keyed.transformWithStateInPandas(Claims(stale_millis), CHANGES, "Append", "EventTime")
