"""Objects of large JSON documents, read in byte ranges by all tasks.

Ranges are cut at closing braces.  Whether a range begins inside a text, and how
many braces are open there, a prefix scan over a file's ranges tells, from what
each range does under both states; then each range's objects are cut out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_ranges import WHERE, before, put_together, ranges_of, with_state
from .tables import written

_MARKS = re.compile(r'\\.|["{]', re.DOTALL)


def _after(piece: str, inside: bool, depth: int) -> tuple[bool, int]:
    """State and depth behind the piece and the closing brace that follows it."""
    for m in _MARKS.finditer(piece):
        c = m[0]
        if c == '"':
            inside = not inside
        elif c == "{" and not inside:
            depth += 1
    return inside, depth if inside else depth - 1


def _both_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: from either state the state at its end, how far the depth goes, and the least depth behind a closing brace."""
    found = []
    for where, goes_on, values in ranges_of(batches, "value"):
        if not goes_on:
            found.append([*where, False, True, 0, 0, 1 << 30, 1 << 30])
        row = found[-1]
        for piece in values.to_pylist():
            for s in (0, 1):
                row[2 + s], row[4 + s] = _after(piece, row[2 + s], row[4 + s])
                if not row[2 + s]:
                    row[6 + s] = min(row[6 + s], row[4 + s])
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["file", "block", "to0", "to1", "far0", "far1", "least0", "least1"])


def _cut(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
        now, n, inside, depth, held, kind = None, 0, False, 0, [], 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)
        for where, goes_on, insides, depths, values in ranges_of(batches, "inside", "depth", "value"):
            out = []
            if not goes_on:
                if held:
                    out.append((*now, n, kind or 1, "".join(held)))
                now, n, held, inside, depth = where, 0, [], insides[0].as_py(), depths[0].as_py()
                kind = 2 if depth > level else 0
            for piece in values.to_pylist():
                start = 0 if depth > level else None
                for m in _MARKS.finditer(piece):
                    if m[0] == '"':
                        inside = not inside
                    elif m[0] == "{" and not inside:
                        if depth == level:
                            start = m.start()
                        depth += 1
                if not inside:
                    depth -= 1
                if start is not None:
                    held.append(piece[start:] + "}")
                    if depth <= level:
                        out.append((*now, n, kind, "".join(held)))
                        n, held, kind = n + 1, [], 0
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([(*now, n, kind or 1, "".join(held))])

    return run


def objects(spark: SparkSession, paths: list[str], level: int = 1) -> DataFrame:
    """file, block, n and text of every object inside so many others; (file, block, n) is their order.

    Level 1 are those of a document's lists, as the features of a collection; level 0 those of a document that is a list itself, or of one document after another.
    """
    pieces = spark.read.text(paths, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ranges = with_state(written(pieces.mapInArrow(_both_states, "file string, block long, to0 boolean, to1 boolean, far0 long, far1 long, least0 long, least1 long")))
    by_state = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    rows = ranges.withColumn("depth", F.coalesce(F.sum(by_state("far")).over(before()), F.lit(0)))
    # an object that is open at the range's end and wasn't at its start
    begins = (F.col("depth") + by_state("far") > level) & ((F.col("depth") <= level) | (F.col("depth") + by_state("least") <= level))
    states = written(rows.withColumn("origin", F.max(F.when(begins, F.col("block"))).over(before())).select(*WHERE, "inside", "depth", "origin"))
    # a range has thousands of pieces of one place, so what is joined stays in order if the ranges are sent to the pieces
    if states.limit(200_001).count() <= 200_000:
        dealt = pieces.join(F.broadcast(states), WHERE)
    else:
        dealt = pieces.withColumn("pos", F.monotonically_increasing_id()).join(states, WHERE).repartition(*WHERE).sortWithinPartitions(*WHERE, "pos")
    cut = written(dealt.select(*WHERE, "inside", "depth", "value").mapInArrow(_cut(level), "file string, block long, n long, kind int, text string"))
    return put_together(cut, states, "")
