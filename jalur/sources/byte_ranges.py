"""Files cut by byte ranges whose start says nothing of where it is: states by a prefix scan, and records put together from pieces."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WHERE = ["file", "block"]


def before():
    """The ranges of a file before a range; there is one row for each."""
    return W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)


def ranges_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(file, block), whether it goes on from the batch before, and the columns' rows, of each batch's ranges."""
    now = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = batch["file"], batch["block"]
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        for lo, hi in pairwise([0, *(np.flatnonzero(new) + 1).tolist(), n]):
            where = file[lo].as_py(), block[lo].as_py()
            yield where, where == now, *(batch[c][lo:hi] for c in columns)
            now = where


def with_state(ranges: DataFrame) -> DataFrame:
    """ranges with `inside`, the state at a range's start; to0, to1: the state at its end from either state.

    Of the maps between the two states two are constant; since the last of them only the swaps count.
    """
    rows = ranges.withColumn("fixed", F.col("to0") == F.col("to1")).withColumn("era", F.coalesce(F.count_if("fixed").over(before()), F.lit(0)))
    rows = rows.withColumn("since", F.coalesce(F.max(F.when(F.col("fixed"), F.struct("block", "to0"))).over(before())["to0"], F.lit(False)))
    # a constant range is the last of its era, so no swap before it is lost
    swaps = F.coalesce(F.count_if(~F.col("fixed") & F.col("to0")).over(W.partitionBy("file", "era").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", F.col("since") != (swaps % 2 == 1)).drop("fixed", "era", "since")


def put_together(cut: DataFrame, states: DataFrame, glue: str) -> DataFrame:
    """file, block, n and text of every record; cut: those, and kind: 0 whole, 1 begun in the range, 2 gone on with in it.

    states: the range in which the record that is open at a range's start begins, as `origin`.
    """
    pieces = cut.where("kind > 0").join(states.select(*WHERE, "origin"), WHERE)
    start = F.when(F.col("kind") == 1, F.col("block")).otherwise(F.col("origin"))
    whole = pieces.groupBy("file", start.alias("start")).agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("p"))  # one record's pieces
    joined = whole.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["n"].alias("n"), F.array_join(F.transform("p", lambda x: x["text"]), glue).alias("text"))
    return cut.where("kind = 0").drop("kind").unionByName(joined)
