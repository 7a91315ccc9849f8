"""Timers of jobs in streams that run."""

import time
from datetime import datetime, timedelta

import pytest

from jalur.streaming import jobs, timers

START = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    before = spark.conf.get(timers.STORE[0])
    spark.conf.set(*timers.STORE)
    yield
    spark.conf.set(timers.STORE[0], before)


def put(spark, folder, rows):
    spark.createDataFrame([(j, e, START + timedelta(seconds=k)) for j, e, k in rows], "job_id string, event string, at timestamp").coalesce(1).write.mode("append").parquet(folder)


def until(query, done, seconds=90):
    end = time.time() + seconds
    while not done():
        assert query.isActive and time.time() < end, query.exception()
        time.sleep(0.3)


def test_a_stale_job_is_swept_and_recovers(spark, store, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, folder, [("a", "uploaded", 0), ("a", "queue", 1), ("a", "claim", 2), ("b", "uploaded", 0), ("b", "queue", 1), ("b", "claim", 2), ("b", "complete", 9), ("c", "complete", 1)])
    events = spark.readStream.schema("job_id string, event string, at timestamp").parquet(folder)
    query = timers.timed_moves(events, stale=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    rows = lambda: [tuple(r)[:5] + (r.seconds, r.recoveries) for r in spark.read.schema(timers.MOVE).parquet(out).orderBy("at", "event").collect()] if (tmp_path / "out" / "_spark_metadata").exists() else []
    try:
        until(query, lambda: any(r[1] == "sweep" for r in rows()))
        put(spark, folder, [("a", "claim", 500), ("a", "complete", 507)])
        until(query, lambda: any(r[:2] == ("a", "complete") for r in rows()))
        time.sleep(4)  # no sweep of what is over
    finally:
        query.stop()
    got = rows()
    assert [r for r in got if r[1] == "sweep"] == [("a", "sweep", "running", "queued", True, None, 1)]
    assert ("a", "claim", "queued", "running", True, None, 1) in got and ("a", "complete", "running", "completed", True, 7.0, 1) in got
    assert ("b", "complete", "running", "completed", True, 7.0, 0) in got and ("c", "complete", None, None, False, None, 0) in got


def test_once_forgets(spark, store, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def go(kept):
        events = spark.readStream.schema("job_id string, event string, at timestamp").parquet(folder)
        jobs.run_once(timers.once(events, "job_id", kept), out, f"{tmp_path}/c")
        return sorted(r.job_id for r in spark.read.schema("job_id string").parquet(out).collect())

    put(spark, folder, [("a", "x", 0), ("a", "x", 1), ("b", "x", 0)])
    assert go(3) == ["a", "b"]
    put(spark, folder, [("c", "x", 0)])
    assert go(3) == ["a", "b", "c"]
    time.sleep(4)
    put(spark, folder, [("a", "x", 5)])
    assert go(3) == ["a", "a", "b", "c"]


def test_moves_of_many_jobs_are_those_of_single_ones(spark, tmp_path, monkeypatch):
    """Over several batches, with states written anew in between, late events, unknown jobs and a job that goes stale."""
    monkeypatch.setattr(jobs, "WHOLE", 2)
    batches = [
        [("a", "uploaded", 0), ("a", "queue", 1), ("a", "claim", 2), ("b", "complete", 1), ("c", "uploaded", 0), (None, "uploaded", 3)],
        [("a", "fail", 9), ("c", "claim", 1), ("c", "queue", 2), ("c", "claim", 3)],
        [("a", "queue", 12), ("a", "claim", 5), ("b", "uploaded", 0), ("a", "odd", 13)],
        [("c", "complete", 8), ("c", "complete", 8), ("a", "claim", 20), (None, "queue", 4)],
    ]
    folder, want, out = f"{tmp_path}/in", f"{tmp_path}/want", f"{tmp_path}/out"
    for rows in batches:
        put(spark, folder, rows)
        events = jobs.messages(spark, folder, "job_id string, event string, at timestamp", 1, "parquet")
        jobs.run_once(jobs.moves(events), want, f"{want}-c")
        jobs.run_moves(events, out, f"{out}-c")
    plain = lambda df: sorted(map(str, df.select("job_id", "event", "from_status", "to_status", "accepted", "at", "seconds", "recoveries").collect()))
    assert plain(jobs.kept_moves(spark, out)) == plain(spark.read.parquet(want)) and len(plain(jobs.kept_moves(spark, out))) == 18
    time.sleep(1.1)
    put(spark, folder, [("z", "uploaded", 0)])
    jobs.run_moves(events, out, f"{out}-c", stale=1)
    put(spark, folder, [("a", "claim", 90), ("a", "complete", 97)])
    jobs.run_moves(events, out, f"{out}-c", stale=1)
    got = [tuple(r)[:5] + (r.seconds, r.recoveries) for r in jobs.kept_moves(spark, out).where("job_id = 'a'").orderBy("recoveries", "at").collect()]
    assert got[-3:] == [("a", "claim", "queued", "running", True, None, 1), ("a", "complete", "running", "completed", True, 7.0, 1), ("a", "sweep", "running", "queued", True, None, 1)]
