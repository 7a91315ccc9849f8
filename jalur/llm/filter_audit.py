"""Which documents does each filter remove, in every order of the filters?

Method: a packed bitmap index.  Each task lays its documents out part by part,
a part starting at a new 64-bit word, and packs one NumPy bitset for each
filter and label; a part's own bitset is its run of words.  What stays after a
set of filters is one AND-NOT from what stays after all but one of them, and is
counted by popcount.  The 32 sets of filters are all prefixes of all orders, so
32 counts a part, added up over the tasks, hold every answer.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, binary_texts, slices

#: Fewest words; least distinct words and most capitals in percent; marks that no text may hold.
WORDS, DISTINCT, CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
FILTERS = "ABCDE"
_SETS = 1 << len(FILTERS)
_UPPER, _CONTINUES = ascii_uppercase.encode(), bytes(range(0x80, 0xC0))
#: Parts that a task holds counts of at most before it hands them on.
_HELD = 20_000


def failures(data: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails; A is the lowest."""
    words = data.split()  # at blanks of ASCII
    n = len(words)
    points = len(data.translate(None, _CONTINUES))
    capitals = len(data) - len(data.translate(None, _UPPER))
    marked = len(data.translate(None, MARKS)) < len(data)
    return (n < WORDS) | (100 * len(set(words)) < DISTINCT * n) << 1 | (100 * capitals > CAPITALS * points) << 2 | marked << 3


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = binary_texts(batch["text"])
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["part"], pa.array([failures(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
            ["id", "part", "fails", "key"],
        )


def popcounts(part: np.ndarray, fails: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Documents left of each part (numbered from 0) after each set of filters: all, and those with each label bit.

    Result: parts x sets x (1 + label bits); labels: bits a document, two at most.
    """
    rows = np.bincount(part)
    first = np.concatenate([[0], np.cumsum(-(-rows // 64))])
    order = np.argsort(part, kind="stable")
    place = np.empty(len(part), np.int64)
    place[order] = np.arange(len(part)) - np.repeat(np.cumsum(rows) - rows, rows) + 64 * np.repeat(first[:-1], rows)

    def packed(bits: np.ndarray) -> np.ndarray:
        flat = np.zeros(64 * first[-1], bool)
        flat[place] = bits
        return np.packbits(flat, bitorder="little").view(np.uint64)

    failing = [packed(fails >> k & 1 == 1) for k in range(len(FILTERS))]
    marks = [packed(labels >> k & 1 == 1) for k in range(2)]
    left = {0: packed(np.ones(len(part), bool))}
    out = np.empty((len(rows), _SETS, 3), np.int64)
    for s in range(_SETS):
        if s:
            low = (s & -s).bit_length() - 1
            left[s] = left[s & (s - 1)] & ~failing[low]
        for k, bits in enumerate((left[s], left[s] & marks[0], left[s] & marks[1])):
            out[:, s, k] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first[:-1])
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        names = pa.array([p for p in held for _ in range(_SETS)], pa.string())
        sums = np.concatenate(list(held.values()))
        held.clear()
        return pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(_SETS, dtype=np.int32), len(sums) // _SETS)), *(pa.array(sums[:, k]) for k in range(3))], ["part", "gone", "kept", "good", "toxic"])

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch["part"].dictionary_encode()
        found = popcounts(parts.indices.to_numpy(), batch["fails"].to_numpy(), batch["labels"].to_numpy())
        for name, counts in zip(parts.dictionary.to_pylist(), found, strict=True):
            held[name] = held[name] + counts if name in held else counts
        if len(held) > _HELD:
            yield out()
    if held:
        yield out()


def left_after(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row a part: part and an array `left` that holds, at the number of each set of filters, (gone, kept, good, toxic).

    The bits of `gone` are the set's filters, A the lowest; kept documents fail none of them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    facts = Table(rows.mapInArrow(_facts, rows.select("id", "part").schema.add("fails", "integer").add("key", "binary")))
    # texts that several ids have; written so that the joins can split a text or an id that many rows share
    again = Table(facts.df.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "least"))
    flag = lambda c, k: F.max(F.when(F.col(c) == 1, k).otherwise(0))
    known = Table(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((flag("quality", 1) + flag("toxic", 2)).alias("labels")))
    later = F.when(F.col("id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    marked = facts.df.join(again.df, "key", "left").select("id", "part", F.col("fails").bitwiseOR(later).alias("fails"))
    bits = marked.join(known.df, "id", "left").select("part", "fails", F.coalesce("labels", F.lit(0)).alias("labels"))
    counts = bits.mapInArrow(_counts, "part string, gone int, kept long, good long, toxic long")
    sums = counts.groupBy("part", "gone").agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")))
    return sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("gone", "kept", "good", "toxic"))).alias("left"))  # 32 of each


def _steps() -> str:
    """All steps of all orders, as JSON: the filters before it as a set, and the filter's own bit."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            out.append({"filter_order": "".join(order), "step": k + 1, "before": before, "bit": bit})
            before |= bit
    return json.dumps(out)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What the filters A to E do in each order: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A: under 100 words; B: distinct words under 80 %; C: capitals A-Z over 10 %
    of code points; D: holds one of # $ % & * |; E: the text of a lesser id.
    Every row counts as a document.  A null text is an empty one, a null part
    the part ''.  A row without an id fails E never, makes no other fail it, and
    has no labels.  Of several label rows of an id a 1 in any counts.  Equal
    texts are told by SHA-256.  An empty table has no parts and no rows.
    """
    at = lambda s, c: F.col("left")[s][c]
    before, bit = F.col("s.before"), F.col("s.bit")
    after, rest = before.bitwiseOR(bit), F.lit(_SETS - 1)
    steps = F.explode(F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,before:int,bit:int>>")).alias("s")
    lost = lambda c: at(before, c) - at(after, c)
    rows = left_after(docs, labels, id_col, text, part).select("part", "left", steps).select(
        "part", "s.filter_order", "s.step", "s.bit",
        at(after, "kept").alias("kept"), lost("kept").alias("removed"),
        (at(F.lit(0), "kept") - at(bit, "kept") - lost("kept")).alias("redundant"),
        (at(rest.bitwiseXOR(bit), "kept") - at(rest, "kept")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")
