"""A log of messages as a Spark data source, and groups that acknowledge what they have handled.

Format `jalur_log`, option `path`: a folder that the driver and the executors
share as a mount.  Each task of a write makes one file of lines; the commit makes
one numbered entry that names them, so a write is seen whole or not at all, and a
write that failed leaves no message.  A stream's batch that is written again
finds its own entry and adds none.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from ..sources.tables import exists, swap, written

FORMAT, SCHEMA = "jalur_log", "message_id string, value string, written_at timestamp"
#: Seconds after which a message that isn't acknowledged may be claimed again, and how many at once.
IDLE, CLAIMED = 60.0, 10


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _entries(path: str) -> list[str]:
    try:
        return sorted(n for n in os.listdir(f"{path}/log") if n.isdigit())
    except FileNotFoundError:
        return []


@dataclass
class _Part(InputPartition):
    entry: str
    number: int
    name: str


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


def _parts(path: str, entries: list[str]) -> list[_Part]:
    out = []
    for entry in entries:
        with open(f"{path}/log/{entry}") as f:
            out += [_Part(entry, k, name) for k, name in enumerate(json.load(f)["parts"])]
    return out


def _read(path: str, part: _Part) -> Iterator[tuple]:
    at = datetime.fromtimestamp(os.stat(f"{path}/log/{part.entry}").st_mtime, timezone.utc)
    with open(f"{path}/parts/{part.name}") as f:
        for k, line in enumerate(f):
            yield f"{part.entry}-{part.number:05d}-{k:09d}", json.loads(line), at


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        return _parts(self.path, _entries(self.path))

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _read(self.path, partition) if isinstance(partition, _Part) else iter(())


class _StreamReader(DataSourceStreamReader):
    """An offset is the number of entries that are read."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        return {"entries": len(_entries(self.path))}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return _parts(self.path, _entries(self.path)[start["entries"] : end["entries"]])

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        """What was read is in the query's checkpoint; the log keeps its messages."""


class _Write:
    """What a task writes, and what the driver makes of it."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> _Written:
        os.makedirs(f"{self.path}/parts", exist_ok=True)
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        try:
            with open(f"{self.path}/parts/{name}", "w") as f:
                for row in rows:
                    f.write(json.dumps(row["value"]) + "\n")
                    n += 1
                f.flush()
                os.fsync(f.fileno())
        except BaseException:
            os.unlink(f"{self.path}/parts/{name}")
            raise
        return _Written(name, n)

    def remove(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(f"{self.path}/parts/{m.name}"):
                os.unlink(f"{self.path}/parts/{m.name}")

    def add(self, messages: list[_Written | None], key: str) -> None:
        """One entry for all tasks, once for each key; its number is the next that no other writer takes."""
        os.makedirs(f"{self.path}/log", exist_ok=True)
        os.makedirs(f"{self.path}/done", exist_ok=True)
        done = f"{self.path}/done/{key}"
        draft = f"{done}.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump({"parts": [m.name for m in messages if m is not None and m.rows]}, f)
        try:
            os.link(draft, done)
        except FileExistsError:  # the same batch was written before
            self.remove(messages)
        os.unlink(draft)
        while os.stat(done).st_nlink < 2:  # it has no number yet
            last = _entries(self.path)
            try:
                os.link(done, f"{self.path}/log/{int(last[-1]) + 1 if last else 0:012d}")
            except FileExistsError:
                continue


class _Writer(_Write, DataSourceWriter):
    def __init__(self, path: str):
        super().__init__(path)
        self.key = uuid.uuid4().hex

    def commit(self, messages: list[_Written | None]) -> None:
        self.add(messages, self.key)

    def abort(self, messages: list[_Written | None]) -> None:
        self.remove(messages)


class _StreamWriter(_Write, DataSourceStreamWriter):
    def __init__(self, path: str, name: str):
        super().__init__(path)
        self.name = name

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        self.add(messages, f"{self.name}-{batchId}")

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        self.remove(messages)


class LogSource(DataSource):
    """Options: path; for a stream's writer also `writer`, a name that no other stream into the log has."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        return _local(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._path())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self._path())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return _Writer(self._path())

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self._path(), self.options["writer"])


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LogSource)
    return spark


def publish(messages: DataFrame, path: str) -> None:
    """K9: append messages (value)."""
    registered(messages.sparkSession)
    messages.select("value").write.format(FORMAT).option("path", path).mode("append").save()


def messages(spark: SparkSession, path: str) -> DataFrame:
    """G1: the log as a stream of message_id, value and written_at; what was read is in the query's checkpoint."""
    return registered(spark).readStream.format(FORMAT).option("path", path).load()


def publish_stream(stream: DataFrame, path: str, writer: str, checkpoint: str):
    """K9: what there is of a stream (value), appended; a batch that is done again adds nothing."""
    registered(stream.sparkSession)
    query = stream.select("value").writeStream.format(FORMAT).option("path", path).option("writer", writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


PENDING = "message_id string, value string, delivered_at timestamp, deliveries int"


class Group:
    """A group of readers of a log, who get each message until one of them acknowledges it.

    A message is written to the group's pending table before it is delivered,
    and leaves it when the handler names it as done.  The table also says which
    batch of the stream was the last that it took, so a batch that comes again
    after a failure adds nothing, and what a handler, or the whole driver, failed
    over is still there after a restart.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, idle: float = IDLE, claimed: int = CLAIMED):
        self.spark, self.path, self.at, self.idle, self.claimed = spark, path, f"{path}/groups/{name}", idle, claimed

    def _table(self) -> DataFrame:
        table = f"{self.at}/pending"
        return self.spark.read.schema(PENDING).parquet(table) if exists(self.spark, table) else self.spark.createDataFrame([], PENDING)

    def pending(self) -> DataFrame:
        return self._table().where("message_id is not null")

    def _put(self, rows: DataFrame, batch: int | None = None) -> None:
        """rows in place of those of their message_id; batch: the last one taken, kept in a row without message_id."""
        table = self._table()
        mark = table.where("message_id is null") if batch is None else self.spark.createDataFrame([(None, str(batch), None, None)], PENDING)
        swap(table.join(rows.select("message_id"), "message_id", "anti").where("message_id is not null").select(table.columns).unionByName(rows).unionByName(mark), f"{self.at}/pending")

    def _take(self, df: DataFrame, batch: int, now: float) -> None:
        mark = self._table().where("message_id is null").first()
        if mark is None or int(mark["value"]) < batch:
            self._put(written(df.select("message_id", "value", F.timestamp_seconds(F.lit(now)).alias("delivered_at"), F.lit(0).alias("deliveries"))), batch)

    def _deliver(self, rows: DataFrame, handle: Callable[[DataFrame], DataFrame], now: float) -> None:
        given = written(rows.select("message_id", "value", F.timestamp_seconds(F.lit(now)).alias("delivered_at"), (F.col("deliveries") + 1).alias("deliveries")))
        self._put(given)
        done = written(handle(given).select("message_id").distinct())
        left = self._table().join(done, "message_id", "anti")
        swap(left.select(self._table().columns), f"{self.at}/pending")

    def poll(self, handle: Callable[[DataFrame], DataFrame], now: float | None = None) -> str:
        """Deliver once: first what has waited for `idle` seconds, `claimed` messages at most, else what is new.  Returns which ("claimed" or "new").

        handle gets message_id, value, delivered_at and deliveries, and returns the message_id of those that are done.
        """
        now = time.time() if now is None else now
        waited = self.pending().where(F.col("delivered_at") <= F.timestamp_seconds(F.lit(now - self.idle)))
        again = written(waited.orderBy("message_id").limit(self.claimed))
        if not again.isEmpty():
            self._deliver(again, handle, now)
            return "claimed"
        messages(self.spark, self.path).writeStream.foreachBatch(lambda df, batch: self._take(df, batch, now)).option("checkpointLocation", f"{self.at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        new = written(self.pending().where("deliveries = 0"))
        if not new.isEmpty():
            self._deliver(new, handle, now)
        return "new"
