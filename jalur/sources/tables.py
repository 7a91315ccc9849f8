"""Tables in the folder that all executors share, and snapshots that replace each other."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset on one machine, as in tests, a temporary folder."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="jalur-"))


def written(df: DataFrame) -> DataFrame:
    """df, written and read again: a short plan, and nothing to work out again if an executor is lost."""
    path = f"{scratch(df.sparkSession)}/jalur-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Remove what written() has written; only when no result still reads it."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/jalur-" in f}:
        fs, p = filesystem(df.sparkSession, name)
        fs.delete(p, True)


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def swap(df: DataFrame, path: str) -> None:
    """A new snapshot in place of the table at path: written beside it, then renamed."""
    spark, new, old = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, p = filesystem(spark, path)
    at = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    was = fs.exists(p)
    if was and not fs.rename(p, at(old)):
        raise OSError(f"{path} can't be moved; the new snapshot is at {new}")
    if not fs.rename(at(new), p):
        if was:
            fs.rename(at(old), p)
        raise OSError(f"{new} can't be moved to {path}")
    if was:
        fs.delete(at(old), True)


def checkpointed(make, spark: SparkSession, path: str, stage: str, job: str, fingerprint: str, resume: bool = True) -> DataFrame:
    """The stage's table at path, made unless it's complete and of the same input; a sidecar tells stage, job, rows and time."""
    side = f"{path}.metadata.json"
    if resume and exists(spark, f"{path}/_SUCCESS") and exists(spark, side):
        if json.loads(read_text(spark, side)).get("fingerprint") == fingerprint:
            return spark.read.parquet(path)
    df = make()
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    write_text(spark, side, json.dumps({"stage": stage, "job_id": job, "rows": out.count(), "written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "fingerprint": fingerprint}))
    return out


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())  # a small file


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = filesystem(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
