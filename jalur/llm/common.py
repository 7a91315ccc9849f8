"""Helpers that the operators share: scratch tables and batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch

_shipped: set[str] = set()
_DEFAULT_BATCH, BATCH = "67108864b", "8m"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, so that they needn't have it installed.

    Unless the session says otherwise, batches for Python have BATCH bytes at
    most, so that long texts don't fill a worker's memory.
    """
    sc, name = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == _DEFAULT_BATCH:
        spark.conf.set(name, BATCH)
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="jalur-")) / f"{package.name}_package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark


def _scratch(spark: SparkSession) -> str:
    return f"{scratch(spark)}/jalur-{uuid.uuid4().hex}"


class Table:
    """A result written to the shared folder; reading it has no lineage."""

    def __init__(self, df: DataFrame, compression: str | None = None):
        self.spark, self.path, schema = df.sparkSession, _scratch(df.sparkSession), df.schema
        df.write.parquet(self.path, compression=compression)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files; only for a table that no result still reads."""
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    return Table(df).df


def text_key(text: Column | str) -> Column:
    """With the document's id this tells documents apart (null text: empty)."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once a row.

    A plain reference may be inlined by the optimiser into a lambda and then be
    worked out for every element.
    """
    return F.transform(F.array(value), body)[0]


def binary_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives an empty value."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str, at_most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has about at_most bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        mean = max(1, batch.column(text).nbytes // batch.num_rows)
        step = max(1, at_most // mean)
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)
