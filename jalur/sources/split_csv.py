"""CSV files whose quoted values may hold line breaks, read in byte ranges by all tasks.

Where a byte range begins can't be told from the range alone: inside a quoted
value or not.  So each range is first read under both states, which tells, for
either, the state at its end and whether a record ends in it.  A prefix scan
over a file's ranges, with as many rows as there are ranges, then tells each
range's state, and the second read cuts it into records.  A record over several
ranges comes as pieces, which are put together by the range it starts in.
Fields are parsed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_ranges import WHERE, before, put_together, ranges_of, with_state
from .tables import written

#: Ranges that begin inside quotes up to which they are broadcast; beyond, the lines are shuffled by range.
BROADCAST_RANGES = 200_000
#: Encodings that are read in ranges; others are read a file a task.
ENCODINGS = {"utf-8": None, "utf8": None, "us-ascii": None, "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1"}


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether the line's end is inside a quoted value, from the state at its start.

    A quote opens a value only at its start; doubled it stands for itself.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    rows = spark.read.text(paths, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return rows.withColumn("value", F.decode(F.col("value").cast("binary"), encoding)) if encoding else rows


def _both_states(sep: str):
    """One row a range: the end's state from either state (to0, to1), whether a line ends outside (end0, end1), and whether none ends inside from outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for where, goes_on, lines in ranges_of(batches, "quoted"):
            if not goes_on:
                found.append([*where, False, True, False, False, True])
            row, last = found[-1], -1
            for k, line in zip(np.flatnonzero(lines.is_valid()).tolist(), lines.drop_null().to_pylist(), strict=True):
                if k > last + 1:  # lines without quotes leave the state
                    row[4] |= not row[2]
                    row[5] |= not row[3]
                last = k
                row[2], row[3] = ends_inside(line, row[2], sep), ends_inside(line, row[3], sep)
                row[4] |= not row[2]
                row[5] |= not row[3]
                row[6] &= not row[2]
            if last + 1 < len(lines):
                row[4] |= not row[2]
                row[5] |= not row[3]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["file", "block", "to0", "to1", "end0", "end1", "plain"])

    return run


def range_states(lines: DataFrame, sep: str = ",") -> DataFrame:
    """file, block, inside (at the range's start), origin (the range in which the record open at its start begins) and plain."""
    quoted = F.when(F.contains("value", F.lit('"')), F.col("value"))
    ranges = written(lines.select(*WHERE, quoted.alias("quoted")).mapInArrow(_both_states(sep), "file string, block long, to0 boolean, to1 boolean, end0 boolean, end1 boolean, plain boolean"))
    rows = with_state(ranges)
    by_state = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    begins = by_state("to") & (by_state("end") | ~F.col("inside"))  # a record that is still open at the range's end
    return rows.withColumn("origin", F.max(F.when(begins, F.col("block"))).over(before())).select(*WHERE, "inside", "origin", "plain")


def _cut(sep: str):
    """Records of each range: kind 0 whole, 1 begun here, 2 gone on with here; `n` is the place in the range."""

    def batch_of(where: tuple, n: int, texts: list[str], kinds: list[int]) -> pa.RecordBatch:
        size = len(texts)
        columns = [pa.repeat(pa.scalar(where[0]), size), pa.repeat(pa.scalar(where[1], pa.int64()), size), pa.array(np.arange(n, n + size)), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "kind", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, held, inside, kind = None, 0, [], False, 0
        for where, goes_on, begins, values in ranges_of(batches, "inside", "value"):
            if not goes_on:
                if held:
                    yield batch_of(now, n, ["\n".join(held)], [kind or 1])
                now, n, held, inside = where, 0, [], bool(begins[0].as_py())
                kind = 2 if inside else 0
            lines, texts, kinds, at = values.to_pylist(), [], [], 0
            for k in [*np.flatnonzero(pc.match_substring(values, '"')).tolist(), len(lines)]:
                if inside:
                    held += lines[at:k]
                else:
                    texts += lines[at:k]
                    kinds += [0] * (k - at)
                at = k + 1
                if k == len(lines):
                    break
                held.append(lines[k])
                inside = ends_inside(lines[k], inside, sep)
                if not inside:
                    texts.append("\n".join(held))
                    kinds.append(kind)
                    held, kind = [], 0
            if texts:
                yield batch_of(now, n, texts, kinds)
                n += len(texts)
        if held:
            yield batch_of(now, n, ["\n".join(held)], [kind or 1])

    return run


def records(spark: SparkSession, paths: list[str], sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """file, block, n and record of every record; (file, block, n) is their order.  Blank ones are left out."""
    lines = _lines(spark, paths, ENCODINGS[encoding.lower()])
    states = written(range_states(lines, sep))
    clean = F.regexp_replace("text", "\r$", "")
    if states.where(~F.col("plain")).limit(1).count() == 0:  # no record has a line break: what ranges hold is what they look like
        rows = lines.select(*WHERE, F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))
        return rows.select("file", "block", "n", clean.alias("record")).where("record <> ''")
    begun = states.where("inside").select(*WHERE, "inside")
    if begun.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        dealt = lines.join(F.broadcast(begun), WHERE, "left")
    else:
        dealt = lines.withColumn("pos", F.monotonically_increasing_id()).join(begun, WHERE, "left").repartition(*WHERE).sortWithinPartitions(*WHERE, "pos")
    cut = written(dealt.select(*WHERE, "inside", "value").mapInArrow(_cut(sep), "file string, block long, n long, kind int, text string"))
    return put_together(cut, states, "\n").select("file", "block", "n", clean.alias("record")).where("record <> ''")


def column_names(header: list[str | None]) -> list[str]:
    """Names as Spark makes them: _cN where there is none, and names that come again, in any case, with their place."""
    lower = [(h or "").lower() for h in header]
    return [f"_c{k}" if not h else f"{h}{k}" if lower.count(h.lower()) > 1 else h for k, h in enumerate(header)]


def read(spark: SparkSession, paths: list[str], sep: str = ",", encoding: str = "utf-8", header: bool = True, position: str | None = None) -> DataFrame:
    """The files' rows by column name, all texts; columns that a file lacks are null.

    Files are told apart by their header line, of which there may be several
    kinds; the plan is the same for any number of files.  position: a column
    that tells the rows' order.
    """
    rows = records(spark, paths, sep, encoding)
    place = F.struct("file", "block", "n")
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    split = lambda n, c="record": F.from_csv(c, ", ".join(f"_c{k} string" for k in range(n)), options)
    widest = lambda df, c: 1 + (df.agg(F.max(F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit(""))))).first()[0] or 0)
    kept = [place.alias(position)] if position else []
    if not header:
        one = rows.orderBy("file", "block", "n").limit(1)
        n = widest(one, F.col("record")) if one.count() else 0
        n = len([x for x in one.select(split(n).alias("v")).first()["v"] if x is not None]) if n else 0
        return rows.select(*kept, split(max(n, 1)).alias("v")).select(*([position] if position else []), "v.*")
    tops = written(rows.groupBy("file").agg(F.min(place).alias("at"), F.min_by("record", place).alias("top")).withColumn("top", F.regexp_replace("top", "^﻿", "")))
    kinds = [r["top"] for r in tops.select("top").distinct().orderBy("top").collect()]  # kinds of header lines, not files
    if not kinds:
        return spark.createDataFrame([], "_c0 string")
    width = max(k.count(sep) for k in kinds) + 1
    of = spark.createDataFrame([(k,) for k in kinds], "record string").select("record", split(width).alias("v"))
    named = {}
    for r in of.collect():
        values = list(r["v"])
        while values and values[-1] is None and len(values) > 1:
            values.pop()
        named[r["record"]] = column_names(values)
    layout = F.when(F.lit(False), 0)
    for k, text in enumerate(kinds):
        layout = layout.when(F.col("top") == text, k)
    marked = rows.join(tops.select(F.col("file").alias("_f"), "at", layout.alias("layout")), F.col("file") == F.col("_f")).where(place != F.col("at"))
    v = marked.select(*kept, "layout", split(max(map(len, named.values()))).alias("v"))
    names = list(dict.fromkeys(n for k in kinds for n in named[k]))
    columns = []
    for name in names:
        value = F.when(F.lit(False), "")
        for k, text in enumerate(kinds):
            if name in named[text]:
                value = value.when(F.col("layout") == k, F.col("v")[f"_c{named[text].index(name)}"])
        columns.append(value.alias(name))
    return v.select(*([position] if position else []), *columns)


def inferred(df: DataFrame) -> DataFrame:
    """Columns of texts as the narrowest of int, bigint, double, boolean and timestamp that holds all their values; one pass."""
    kinds = ["int", "bigint", "double", "boolean", "timestamp"]
    fails = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull()).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k in kinds]
    some = [F.count(f"`{c}`").alias(f"{i}_n") for i, c in enumerate(df.columns)]
    row = df.agg(*fails, *some).first() if df.columns else None
    pick = lambda i: next((k for k in kinds if row[f"{i}_n"] and not row[f"{i}_{k}"]), "string")
    return df.select(*[F.col(f"`{c}`").cast(pick(i)).alias(c) for i, c in enumerate(df.columns)])
