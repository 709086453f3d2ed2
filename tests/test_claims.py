"""The queue's stream against a plain replay: no job is held twice, silent jobs come back, a restart changes nothing."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lifecycle
from tessera.streaming import claims

STORE = "spark.sql.streaming.stateStore.providerClass"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    was = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, was)


def event(queue, i, seconds, kind, job=None, worker=None, priority=None, most=None, retryable=None):
    return (queue, i, START + datetime.timedelta(seconds=seconds), kind, job, worker, priority, most, retryable)


def stream(spark, batches, at):
    """The changes that a stream over batches gives, a file each, stopped and started again after each of them."""
    out = []
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, claims.EVENTS).coalesce(1).write.mode("append").parquet(f"{at}/in")
        query = claims.claims(spark.readStream.schema(claims.EVENTS).parquet(f"{at}/in")).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120), n
    out = spark.read.schema(claims.CHANGES).parquet(f"{at}/out").collect()
    return sorted((tuple(r) for r in out), key=lambda r: (r[0], r[5], r[6]))


def test_claims_are_exclusive_and_released(rocks, tmp_path):
    first = [event(1, i, i, "enqueue", job=i, priority=i % 3, most=2) for i in range(6)]
    first += [event(1, 10 + i, 20 + i, "claim", worker=w) for i, w in enumerate("abc")] + [event(1, 20, 30, "beat", job=3, worker="c"), event(1, 21, 31, "done", job=0, worker="b"), event(1, 22, 32, "done", job=0, worker="a")]
    second = [event(1, 30, 40, "fail", job=3, worker="b", retryable=True), event(1, 31, 41, "claim", worker="d"), event(1, 32, 42, "fail", job=1, worker="c", retryable=False), event(2, 33, 43, "claim", worker="z")]
    later = [event(9, 90, 100_000, "claim", worker="clock"), event(9, 91, 200_000, "claim", worker="clock")]
    got = stream(rocks, [first, second, later[:1], later[1:]], tmp_path)
    seen = [(job, status, worker, attempt) for queue, job, status, worker, attempt, _, e in got if queue == 1 and e >= 10]
    assert seen == [(0, "RUNNING", "a", 1), (3, "RUNNING", "b", 1), (1, "RUNNING", "c", 1), (0, "SUCCEEDED", "a", 1), (3, "QUEUED", None, 1), (3, "RUNNING", "d", 2), (1, "FAILED", None, 1)]
    silent = [(job, status, at) for queue, job, status, _, _, at, e in got if e == -1]
    assert silent == [(3, "FAILED", int(START.replace(tzinfo=datetime.UTC).timestamp() * 1000) + 41_000 + claims.STALE_MILLIS + 1)]
    assert not [r for r in got if r[0] == 2]


def test_batches_do_not_matter(rocks, tmp_path):
    """A long run in one batch and in five gives the same claims, and nobody holds a job that another holds."""
    rng, events = random.Random(6), []
    held = {}
    for i in range(250):
        q, w = rng.randrange(3), rng.choice("abcd")
        kind = rng.choice(["enqueue", "claim", "claim", "beat", "done", "fail"])
        events.append(event(q, i, i // 2, kind, job=None if kind == "claim" else rng.randrange(12), worker=w, priority=rng.randrange(3), most=rng.randrange(1, 4), retryable=rng.random() < 0.7))
    one, five = stream(rocks, [events], tmp_path / "one"), stream(rocks, [events[k : k + 50] for k in range(0, 250, 50)], tmp_path / "five")
    assert one == five and len(one) >= 60
    for queue, job, status, worker, _, _, _ in one:
        if status == "RUNNING":
            assert held.get((queue, job)) is None
            held[queue, job] = worker
        else:
            held[queue, job] = None


def test_sweep_agrees_with_the_batch(rocks, tmp_path):
    """Jobs of the events table, one claim each: what goes silent in the stream is what the batch sweep finds stale, with the same end."""
    rows = rocks.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type = 'view'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id").orderBy("ts").collect()
    at = lambda r: int((r.ts.replace(tzinfo=datetime.UTC) - START.replace(tzinfo=datetime.UTC)).total_seconds() * 1000)
    events, end = [], max(map(at, rows)) / 1000
    for r in rows:
        q, s = r.event_id % 64, at(r) / 1000
        events += [event(q, 10 * r.event_id, s, "enqueue", job=r.event_id, priority=1, most=1 + r.event_id % 2), event(q, 10 * r.event_id + 1, s, "claim", worker="w")]
    clock = [event(999, -k, end + 1 + 60 * k, "claim", worker="clock") for k in range(1, 3)]
    got = [r for r in stream(rocks, [events, clock[:1], clock[1:]], tmp_path) if r[0] != 999]
    running, swept = {}, {}
    for _, job, status, _, attempt, millis, e in got:
        if e == -1:
            swept[job] = status
        elif status == "RUNNING" and attempt == 1:
            running[job] = millis
    assert len(running) == len(rows) and len(set(swept.values())) == 2
    now = START + datetime.timedelta(seconds=end + 1 + 60)  # the watermark, a minute behind the clock's last event
    jobs = rocks.createDataFrame([(j, m, 1, 1 + j % 2) for j, m in running.items()], "id long, ms long, attempt_count int, max_attempts int").select("id", F.timestamp_millis("ms").alias("heartbeat_at"), "attempt_count", "max_attempts", F.lit("RUNNING").alias("status"))
    stale = lifecycle.requeue_stale(jobs, F.lit(now.isoformat(sep=" ")).cast("timestamp"), claims.STALE_MILLIS // 1000).collect()
    assert {r.id: r.status for r in stale} == swept
