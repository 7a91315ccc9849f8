"""Job events: decoding, routing, the state of each job, and effects that happen once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Events and the states that they lead from and to.
INGEST, SEARCH = "bulk_ingest_requested", "search_sync_requested"
MOVES = {
    "uploaded": ({None}, "uploaded"),
    "queue": ({"uploaded", "failed", "interrupted"}, "queued"),
    "claim": ({"queued"}, "running"),
    "complete": ({"running"}, "completed"),
    "fail": ({"running"}, "failed"),
    "interrupt": ({"running"}, "interrupted"),
}
EVENT = "event_type string, event_id string, job_id string, requested_at string, object_name string, source_type string, config_path string, load_to_db boolean, schema_name string, es_index string, recreate_index boolean"
STATE = "status string, updated_at timestamp, started_at timestamp, recoveries int"
MOVE = "job_id string, event string, from_status string, to_status string, accepted boolean, at timestamp, seconds double, recoveries int"

#: Batches after which all states are written anew, not just those that changed.
WHOLE = 20
_KEPT = "job_id string, event string, from_status string, to_status string, accepted boolean, at long, seconds double, recoveries int, started long, heard long, what string"
_KEPT_ARROW = pa.schema([("job_id", pa.string()), ("event", pa.string()), ("from_status", pa.string()), ("to_status", pa.string()), ("accepted", pa.bool_()), ("at", pa.int64()), ("seconds", pa.float64()), ("recoveries", pa.int32()), ("started", pa.int64()), ("heard", pa.int64()), ("what", pa.string())])


def messages(spark: SparkSession, path: str, schema, files: int = 1, fmt: str = "json", names: str = "*") -> DataFrame:
    """Files of a folder, of these names, as they come, so many at a time; what was read is in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).format(fmt).load(path)


def decoded(lines: DataFrame, body: str = "value") -> DataFrame:
    """The fields of each message; problem tells why one can't be used."""
    rows = lines.withColumn("e", F.from_json(body, EVENT)).select("*", "e.*").drop("e")
    wrong = F.when(F.col("event_type").isNull(), "unreadable").when(~F.col("event_type").isin(INGEST, SEARCH), "unknown event").when(F.col("job_id").isNull(), "no job")
    return rows.withColumn("problem", wrong)


def routed(events: DataFrame) -> dict[str, DataFrame]:
    """Events by what handles them, and those that nothing does."""
    good = events.where("problem is null")
    return {"ingest": good.where(F.col("event_type") == INGEST), "search": good.where(F.col("event_type") == SEARCH), "dead": events.where("problem is not null")}


def chained(results: DataFrame) -> DataFrame:
    """A search event for every job whose rows were loaded; a failure leads to none."""
    body = F.to_json(F.struct(F.lit(SEARCH).alias("event_type"), F.concat(F.lit("search-"), F.col("job_id")).alias("event_id"), "job_id"))
    return results.where((F.col("status") == "completed") & F.col("loaded")).select(body.alias("value"))


def first_of_key(events: DataFrame, key: str, at: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first event of a key; with a time, keys are forgotten after the delay."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if at else events.dropDuplicates([key])


def publish(messages: DataFrame, path: str, batch: int) -> None:
    """K9: a batch's messages (value) as lines of a folder that messages() reads; a batch that is done again replaces itself."""
    messages.select("value").write.mode("overwrite").option("compression", "none").text(f"{path}/batch-{batch}")


def publish_to_broker(messages: DataFrame, servers: str, topic: str, key: str = "job_id") -> None:
    """K9: messages (value, and a key) to a topic; needs the connector of the broker to be installed."""
    messages.select(F.col(key).alias("key"), "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def broker_messages(spark: SparkSession, servers: str, topic: str, at_most: int = 10_000) -> DataFrame:
    """Messages of a topic (value as text); what was read is in the query's checkpoint."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", at_most).load()
    return rows.select(F.col("value").cast("string").alias("value"))


def chain(results: DataFrame, path: str, checkpoint: str, topic: str) -> None:
    """What there is of a stream of results (job_id, status, loaded): each job once, kept under path, and its search event published."""
    once = first_of_key(results, "job_id")
    run_once(once, path, checkpoint, lambda df, batch: publish(chained(df), topic, batch))


def _moves(stale: float):
    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        status, at, started, recoveries = state.get if state.exists else (None, None, None, 0)
        out = []
        if state.hasTimedOut:
            if status == "running":
                now = pd.Timestamp(state.getCurrentProcessingTimeMs(), unit="ms")
                out.append((key[0], "sweep", status, "queued", True, now, None, recoveries + 1))
                status, at, started, recoveries = "queued", now, None, recoveries + 1
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "event"], kind="stable")
            for event, when in zip(rows["event"], rows["at"], strict=True):
                before, after = MOVES.get(event, (set(), status))
                ok = status in before
                took = (when - started).total_seconds() if ok and status == "running" and started is not None else None
                out.append((key[0], event, status, after if ok else status, ok, when, took, recoveries))
                if ok:
                    status, at, started = after, when, when if after == "running" else started
        if status is None:
            state.remove()
        else:
            state.update((status, None if at is None else pd.Timestamp(at).to_pydatetime(), None if started is None else pd.Timestamp(started).to_pydatetime(), recoveries))
            if status == "running" and stale:
                state.setTimeoutDuration(int(stale * 1000))
        yield pd.DataFrame(out, columns=["job_id", "event", "from_status", "to_status", "accepted", "at", "seconds", "recoveries"])

    return run


def moves(events: DataFrame, stale: float = 300.0) -> DataFrame:
    """Every event (job_id, event, at) as a move of its job: from, to, whether it was allowed, and the seconds a run took.

    A job that has been running for `stale` seconds without an event goes back to the queue.
    Events of a job are taken in order of time within a batch.
    """
    return events.groupBy("job_id").applyInPandasWithState(_moves(stale), MOVE, STATE, "append", "ProcessingTimeTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append"):
    """What there is of the stream, then stop; a batch that is done again after a failure overwrites itself.

    Each batch has a folder under path, so the effect is the same however often it's tried.
    """

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if each:
            each(df, batch)

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # with timeouts by processing time there'd be another batch for ever
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()
    return query


def _walk(stale: int, now: int, whole: bool):
    """Rows of jobs in order, a job's states before its events; times in microseconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = touched = False
        job = status = at = started = heard = None
        recoveries = 0
        out: list[tuple] = []

        def end() -> None:
            if touched and status is not None:
                out.append((job, None, None, status, None, at, None, recoveries, started, now, "state"))
            elif status == "running" and stale and not touched and heard + stale <= now:
                out.append((job, "sweep", status, "queued", True, now, None, recoveries + 1, None, None, "move"))
                out.append((job, None, None, "queued", None, now, None, recoveries + 1, None, now, "state"))
            elif whole and status is not None:
                out.append((job, None, None, status, None, at, None, recoveries, started, heard, "state"))

        def flushed() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(_KEPT_ARROW)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEPT_ARROW, strict=True)], schema=_KEPT_ARROW)
            out.clear()
            return batch

        for rows in batches:
            for j, is_event, said, when, began, last, times in zip(*(rows.column(c).to_pylist() for c in ("job_id", "is_event", "said", "at", "started", "heard", "recoveries")), strict=True):
                if not some or j != job:
                    if some:
                        end()
                    some, touched, job, status, at, started, heard, recoveries = True, False, j, None, None, None, None, 0
                if not is_event:
                    status, at, started, heard, recoveries = said, when, began, last, times
                    continue
                touched = True
                before, after = MOVES.get(said, ((), status))
                ok = status in before
                took = (when - started) / 1e6 if ok and status == "running" and started is not None and when is not None else None
                out.append((job, said, status, after if ok else status, ok, when, took, recoveries, None, None, "move"))
                if ok:
                    status, at, started = after, when, when if after == "running" else started
            yield flushed()
        if some:
            end()
        yield flushed()

    return run


def run_moves(events: DataFrame, path: str, checkpoint: str, stale: float = 300.0):
    """What there is of a stream of events (job_id, event, at) as moves() says, for very many jobs; kept_moves() reads the moves.

    The states are rows beside the moves of each batch.  A batch's events and
    the states before it are sorted by job, and each task walks through its jobs,
    so that a job costs no call of its own.  A batch that is done again reads
    the states of the batches before it only, and overwrites itself.
    """
    spark = events.sparkSession

    def keep(df: DataFrame, batch: int) -> None:
        none = lambda kind: F.lit(None).cast(kind)
        rows = df.select("job_id", F.lit(True).alias("is_event"), F.lit(batch).cast("int").alias("batch"), F.col("event").alias("said"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), none("long").alias("started"), none("long").alias("heard"), none("int").alias("recoveries"))
        if batch:
            since = (batch - 1) // WHOLE * WHOLE
            states = spark.read.schema(f"{_KEPT}, batch int").parquet(path).where((F.col("what") == "state") & (F.col("batch") >= since) & (F.col("batch") < batch))
            rows = rows.unionByName(states.select("job_id", F.lit(False).alias("is_event"), "batch", F.col("to_status").alias("said"), "at", "started", "heard", "recoveries"))
        placed = rows.repartition("job_id").sortWithinPartitions("job_id", "is_event", "batch", F.col("at").asc_nulls_last(), F.col("said").asc_nulls_last())
        walked = placed.mapInArrow(_walk(int((stale or 0) * 1e6), time.time_ns() // 1000, batch % WHOLE == 0), _KEPT)
        walked.write.mode("overwrite").partitionBy("what").parquet(f"{path}/batch={batch}")

    query = events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return query


def kept_moves(spark: SparkSession, path: str) -> DataFrame:
    """The moves that run_moves() has kept under path."""
    rows = spark.read.schema(f"{_KEPT}, batch int").parquet(path).where("what = 'move'")
    return rows.select("job_id", "event", "from_status", "to_status", "accepted", F.timestamp_micros("at").alias("at"), "seconds", "recoveries")
