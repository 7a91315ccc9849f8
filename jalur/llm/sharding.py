"""Dealing documents out to shards of near-equal size.

Method: longest-processing-time scheduling.  Rows with equal texts are a group
that stays together; groups, by size from the largest, go to the shard that has
the least so far, through a heap.  All groups can't pass through one heap at
scale, so the small ones are first packed by the same rule within each task
into bins, bins are packed into larger ones while they are still too many for
one heap, and the heap deals out the large groups and the bins.  A small group
is at most one bin's even share, so a shard is off the mean by about one bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table

#: Bins for each shard over all tasks, and groups or rows that one task packs or numbers.
BINS, ROWS = 512, 100_000
#: Bins that pass through the driver's heap at most (and then are broadcast: some 24 bytes each).
HEAP = 100_000


def schedule(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """The shard of each named size, longest first to the least loaded (ties: the lower shard)."""
    heap = [(0, s) for s in range(shards)]
    heapify(heap)
    out = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heap[0]
        out[name] = shard
        heapreplace(heap, (load + size, shard))
    return out


def _pack(bins: int):
    """Groups of each part into its bins, longest first to the least loaded; key decides ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("part", "ascending"), ("bytes", "descending"), ("key", "ascending")])
        out, heap, now = np.empty(table.num_rows, np.int32), [], None
        for i, (part, size) in enumerate(zip(table["part"].to_pylist(), table["bytes"].to_pylist(), strict=True)):
            if part != now:
                heap, now = [(0, b) for b in range(bins)], part
            load, b = heap[0]
            out[i] = b
            heapreplace(heap, (load + size, b))
        yield from table.append_column("bin", pa.array(out)).select(["key", "bytes", "part", "bin"]).to_batches(max_chunksize=50_000)

    return run


def _bin_key():
    """What names a bin where it is a group."""
    return F.concat_ws("/", F.lit("bin"), F.col("part").cast("string"), F.col("bin").cast("string")).cast("binary")


def homes(docs: DataFrame, shards: int = 24, text: str = "text", rows: int = ROWS, heap: int = HEAP) -> DataFrame:
    """One row a group of equal texts: key (SHA-256 of the text, binary) and shard."""
    spark = docs.sparkSession
    groups = Table(docs.select(_size(text).alias("size"), _key(text).alias("key")).groupBy("key").agg(F.sum("size").alias("bytes")))
    total, n = groups.df.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    large = total // (shards * BINS) + 1  # under shards * BINS groups are as large
    heavy = [(r["bytes"], bytes(r["key"])) for r in groups.df.where(F.col("bytes") >= large).collect()]
    light, levels = groups.df.where(F.col("bytes") < large), []
    while True:
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64, n), -(-n // rows))
        bins = max(2 * shards, min(shards * BINS, heap) // parts)
        packed = Table(light.select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")).repartition(parts, "part").mapInArrow(_pack(bins), "key binary, bytes long, part int, bin int"))
        levels.append(packed)
        # a bin is a group of the next level
        light = packed.df.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes")).withColumn("key", _bin_key())
        if parts * bins <= heap or parts == 1:
            break
        n = light.count()
    loads = [(r["bytes"], (r["part"], r["bin"])) for r in light.collect()]  # heap rows at most
    placed = schedule(heavy + loads, shards)
    of_bin = F.broadcast(spark.createDataFrame([(*k, s) for k, s in placed.items() if isinstance(k, tuple)], "part int, bin int, shard int"))
    of_key = spark.createDataFrame([(k, s) for k, s in placed.items() if isinstance(k, bytes)], "key binary, shard int")
    groups.drop()
    while True:
        out = levels.pop().df.join(of_bin, ["part", "bin"]).select("key", "shard")
        if not levels:
            return out.unionAll(of_key)
        below = levels[-1].df.select("part", "bin").distinct().withColumn("key", _bin_key())
        of_bin = below.join(out, "key").select("part", "bin", "shard")


def _text(text: str):
    return F.coalesce(F.col(text), F.lit(""))


def _size(text: str):
    return (F.octet_length(_text(text)) + 8).cast("long")


def _key(text: str):
    return F.unhex(F.sha2(_text(text).cast("binary"), 256))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id_col, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 8, and the law is `bytes`: shards
    have near-equal sums of sizes, as near as groups of equal texts allow.  A
    null text is the same group as an empty one.  Slots number a shard's rows
    from 0 without a gap; rows that agree in every respect may swap slots.
    grown_shard is null, as this law deals all rows out anew.
    """
    rows = Table(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).select("id", _size("text").alias("size"), F.crc32(_text("text").cast("binary")).alias("crc"), _key("text").alias("key")))
    of = Table(homes(docs.select(F.col(text).alias("text")), shards))
    steps = max(1, -(-rows.df.count() // ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = Table(rows.df.join(of.df, "key").select("id", "size", "crc", "shard", F.pmod(F.xxhash64("id", "size", "crc"), F.lit(steps)).cast("int").alias("step")))
    rows.drop()
    of.drop()
    before = dealt.df.groupBy("shard", "step").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = dealt.df.withColumn("nth", F.row_number().over(W.partitionBy("shard", "step").orderBy("id", "size", "crc")))
    return numbered.join(before, ["shard", "step"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, text: str = "text", column: str = "shard") -> None:
    """Write docs as Parquet with a folder for each shard."""
    of = Table(homes(docs, shards, text))
    keyed = docs.drop(column).withColumn("_jl_key", _key(text))
    keyed.join(of.df.select(F.col("key").alias("_jl_key"), F.col("shard").alias(column)), "_jl_key").drop("_jl_key").write.partitionBy(column).parquet(path)


