"""The message log: whole writes, restarts, and messages that nobody acknowledged."""

import json
import os

import pytest
from pyspark.sql import functions as F

from jalur.streaming import log


def values(df):
    return sorted(r.value for r in df.collect())


def batch(spark, path):
    return log.registered(spark).read.format(log.FORMAT).option("path", path).load()


def test_write_and_read(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert batch(spark, path).count() == 0
    texts = ["a", 'b "quoted"\nline', "é", None, ""]
    for k in range(2):
        log.publish(spark.createDataFrame([(t,) for t in texts], "value string").repartition(3), path)
    rows = batch(spark, path).collect()
    assert sorted(r.value or "-" for r in rows) == sorted([t or "-" for t in texts] * 2)
    assert len({r.message_id for r in rows}) == 10 and all(r.written_at for r in rows)
    log.publish(spark.createDataFrame([], "value string"), path)
    assert batch(spark, path).count() == 10
    with pytest.raises(Exception, match="appended"):
        spark.range(1).selectExpr("'x' as value").write.format(log.FORMAT).option("path", path).mode("overwrite").save()


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log.publish(spark.createDataFrame([("first",)], "value string"), path)
    bad = spark.range(400).repartition(4).select(F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        log.publish(bad, path)
    assert values(batch(spark, path)) == ["first"]


def test_stream_batch_written_again_adds_nothing(spark, tmp_path):
    path = f"{tmp_path}/log"
    writer = log._StreamWriter(path, "w")
    one = [writer.write(iter([{"value": "a"}])), None, writer.write(iter([]))]
    writer.commit(one, 7)
    again = [writer.write(iter([{"value": "a"}]))]
    writer.commit(again, 7)
    os.unlink(f"{path}/log/000000000000")  # as if the driver had died before it gave the number
    writer.commit([writer.write(iter([{"value": "a"}]))], 7)
    writer.commit([writer.write(iter([{"value": "b"}]))], 8)
    gone = writer.write(iter([{"value": "c"}]))
    writer.abort([gone, None], 9)
    assert values(batch(spark, path)) == ["a", "b"] and len(os.listdir(f"{path}/parts")) == 3


def test_stream_restarts(spark, tmp_path):
    """A handler that dies in its second batch: after a restart everything is there once."""
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    seen = f"{tmp_path}/seen"

    def each(fail):
        def run(df, k):
            df.write.mode("overwrite").parquet(f"{seen}/batch={k}")
            if fail:
                raise RuntimeError("killed")

        return run

    def go(fail):
        log.messages(spark, a).writeStream.foreachBatch(each(fail)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    log.publish(spark.range(5).selectExpr("cast(id as string) as value"), a)
    go(False)
    log.publish(spark.range(5, 9).selectExpr("cast(id as string) as value"), a)
    with pytest.raises(Exception, match="killed"):
        go(True)
    log.publish(spark.range(9, 11).selectExpr("cast(id as string) as value"), a)
    for _ in range(2):  # the batch that failed, and then what is new
        go(False)
    assert sorted(int(r.value) for r in spark.read.parquet(seen).collect()) == list(range(11))
    for _ in range(2):
        log.publish_stream(log.messages(spark, a), b, "copy", f"{tmp_path}/c2")
    assert len(values(batch(spark, b))) == 11


def test_group(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log.publish(spark.range(14).selectExpr("cast(id as string) as value"), path)
    handled, broken = [], set(map(str, range(2, 14)))

    def handle(df):
        rows = df.collect()
        handled.append({r.value: r.deliveries for r in rows})
        return spark.createDataFrame([(r.message_id,) for r in rows if r.value not in broken], "message_id string")

    group = log.Group(spark, path, "g")
    assert group.poll(handle, 1000.0) == "new" and len(handled[-1]) == 14
    assert group.pending().count() == 12
    assert group.poll(handle, 1059.0) == "new" and len(handled) == 1  # nothing is new, nothing has waited long enough
    broken.clear()
    assert log.Group(spark, path, "g").poll(handle, 1060.0) == "claimed" and len(handled[-1]) == 10 and set(handled[-1].values()) == {2}
    assert group.poll(handle, 1060.0) == "claimed" and len(handled[-1]) == 2
    assert group.pending().count() == 0
    log.publish(spark.createDataFrame([("new",)], "value string"), path)
    assert group.poll(handle, 1061.0) == "new" and handled[-1] == {"new": 1}


def test_group_survives_its_driver(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log.publish(spark.range(3).selectExpr("cast(id as string) as value"), path)
    group, done = log.Group(spark, path, "g"), []

    def die(df):
        raise RuntimeError("killed")

    def handle(df):
        done.extend(r.value for r in df.collect())
        return df

    with pytest.raises(Exception, match="killed"):
        group.poll(die, 1000.0)
    assert group.pending().count() == 3
    assert group.poll(handle, 1070.0) == "claimed"
    assert group.poll(handle, 1071.0) == "new"
    assert sorted(done) == ["0", "1", "2"]


def test_group_takes_a_batch_once(spark, tmp_path):
    """The driver dies after the batch is in the table and before the stream has noted it."""
    path = f"file://{tmp_path}/log"
    log.publish(spark.range(3).selectExpr("cast(id as string) as value"), path)
    group, done, take = log.Group(spark, path, "g"), [], log.Group._take

    def handle(df):
        done.extend(r.value for r in df.collect())
        return df

    def die_after(df, batch, now):
        take(group, df, batch, now)
        raise RuntimeError("killed")

    group._take = die_after
    with pytest.raises(Exception, match="killed"):
        group.poll(handle, 1000.0)
    group = log.Group(spark, path, "g")
    assert group.poll(handle, 1070.0) == "claimed" and group.poll(handle, 1071.0) == "new" and group.poll(handle, 1072.0) == "new"
    assert sorted(done) == ["0", "1", "2"] and group.pending().count() == 0
    assert json.loads(open(f"{tmp_path}/log/log/000000000000").read())["parts"]
