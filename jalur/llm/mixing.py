"""Mixing sources to target weights.

Method: a low-discrepancy schedule.  Slot k of the mix is the point k times the
golden ratio, modulo 1; the sources share the unit interval by their targets,
and a slot belongs to the source whose piece its point falls into.  A source's
documents, in an order that a digest shuffles, are a stream of words that
repeats, cut into blocks of equally many words; the r-th slot of a source gets
the stream's block r.  Points are whole numbers, so reruns agree to the last
slot.  Ranks and places are counts within bounded groups plus prefix sums, so
no source has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.columns import numbered
from .common import Table, delete

#: Words of a block, weights of the sources in turn, and how often a source is taken at most.
BLOCK, WEIGHTS, REPEATS = 32, (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Points of the unit interval, as a power of two, and the golden ratio among them (odd, so that no point comes twice).
_BITS, _HALF = 52, 26
_GOLDEN = 2783377641436329
#: Slots that are ranked together, and documents of a source that are put in order together, some.
_SLOTS, _DOCS = 16_384, 10_000
_SPAN = 12


def point(k: Column) -> Column:
    """k times the golden ratio modulo 1, in 2^-52; products of halves, so that nothing overflows."""
    low = (1 << _HALF) - 1
    a, b = k.bitwiseAND(low), F.shiftright(k, _HALF).bitwiseAND(low)
    m, n = _GOLDEN & low, _GOLDEN >> _HALF
    return (a * m + F.shiftleft((b * m + a * n).bitwiseAND(low), _HALF)).bitwiseAND((1 << _BITS) - 1)


def with_before(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """df with `before`, the sum of value at lesser places of the same keys; at: a whole number, once for each keys.

    First within 4,096 places, then over them, so that a window holds a 4,096th of a group.
    """
    rows = df.withColumn("_jl_high", F.shiftright(at, _SPAN))
    over = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    high = rows.groupBy(*keys, "_jl_high").agg(F.sum(value).alias(value)).select(*keys, "_jl_high", over(W.partitionBy(*keys).orderBy("_jl_high")).alias("_jl_base"))
    inner = rows.withColumn("before", over(W.partitionBy(*keys, "_jl_high").orderBy(at)))
    return inner.join(high, [*keys, "_jl_high"]).withColumn("before", F.col("before") + F.col("_jl_base")).drop("_jl_high", "_jl_base")


def _targets(sources: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """sources (source, source_size) with nth (by code point, null last) and target.

    A source whose share is above repeats times its size stops there and the
    others share what is left, until none is above.  Two sums pass the driver a round.
    """
    exact = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("decimal(20,0)")
    rows = numbered(sources, F.col("source").asc_nulls_last(), name="nth").withColumns({"weight": F.get(F.array(*map(F.lit, weights)), F.pmod("nth", F.lit(len(weights))).cast("int")), "most": repeats * F.col("source_size")})
    total, shares = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    left, weight, n = total, shares, 0
    while True:
        above = exact("weight") * exact(left or 0) > exact("most") * exact(weight or 1)
        gone, held, m = rows.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0)), F.count_if(above)).first()
        if m == n:
            break
        left, weight, n = total - gone, shares - held, m
    return rows.withColumn("target", F.when(above, F.col("most").cast("double")).otherwise(F.lit(float(left or 0)) * F.col("weight") / F.lit(float(weight or 1)))).drop("weight", "most")


def _slots(sources: DataFrame, total: int, n_sources: int, block: int) -> DataFrame:
    """slot, nth and rank of every slot that falls to a source.

    The interval is cut into about twice as many cells as there are sources; a
    slot meets the pieces of its cell alone.  All cells get equally many slots, so
    a slot meets 1.5 pieces on average, however the pieces are spread.
    """
    bits = max(6, n_sources.bit_length() + 1)
    pieces = with_before(sources.withColumn("points", F.floor(F.col("target") / F.lit(float(max(total, 1))) * F.lit(float(1 << _BITS))).cast("long")), [], "nth", "points")
    pieces = pieces.where("points > 0").select("nth", F.col("before").alias("low"), (F.col("before") + F.col("points")).alias("high"))
    cell = lambda c: F.shiftright(c, _BITS - bits)
    cells = pieces.withColumn("cell", F.explode(F.sequence(cell("low"), cell(F.col("high") - 1))))
    ks = sources.sparkSession.range(-(-total // block)).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    ks = ks.withColumn("cell", cell("u"))
    found = ks.join(cells, (ks["cell"] == cells["cell"]) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return found.select("slot", "nth", F.expr(f"slot div {_SLOTS}").alias("chunk"))


def _stream(docs: DataFrame, n: int) -> DataFrame:
    """docs (nth, size, key, ...) with `place`, the words of the source before the document in the shuffled order."""
    bits = max(8, (n // _DOCS).bit_length())
    dealt = docs.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - min(bits, 32)))
    sums = with_before(dealt.groupBy("nth", "bucket").agg(F.sum("size").alias("words")), ["nth"], "bucket", "words").drop("words")
    within = F.coalesce(F.sum("size").over(W.partitionBy("nth", "bucket").orderBy("key", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("within", within).join(sums, ["nth", "bucket"]).withColumn("place", F.col("before") + F.col("within")).drop("within", "before", "bucket")


class Mix:
    """A mix of docs: `documents` (row, id_col, source, size, source_size, target) and `spans` (slot, row, epoch, first, words).

    spans, ordered by slot and then by epoch and the stream, is the training order:
    words `first` to `first + words - 1` of a document, in its epoch-th repetition.
    A slot has block words, but for a source's last one where it stops at its most.

    A null text has no words.  A null source is a source, the last.  Rows that
    agree in id, text and source may swap places, and their sums with them.
    Sources without words get nothing; an empty table gives empty results.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK):
        body = F.coalesce(F.col(text), F.lit(""))
        key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("?")), F.lit(":"), body).cast("binary"))
        rows = Table(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), key.alias("key")))
        sources = Table(_targets(rows.df.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
        total, n_sources = sources.df.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
        slots = Table(_slots(sources.df, total, n_sources, block))
        counts = Table(slots.df.groupBy("nth", "chunk").agg(F.count("*").alias("n")))
        # written, so that a join with a source that many rows have can be split
        limits = Table(sources.df.join(counts.df.groupBy("nth").agg(F.sum("n").alias("n_slots")), "nth", "left").withColumn("limit", F.least(block * F.coalesce("n_slots", F.lit(0)), repeats * F.col("source_size"))).withColumnRenamed("source", "name"))
        known = Table(rows.df.join(limits.df, rows.df["source"].eqNullSafe(F.col("name"))).drop("name", "n_slots"))
        rows.drop()
        self.documents = known.df.select("row", F.col("id").alias(id_col), "source", "size", "source_size", "target")
        placed = _stream(known.df.where("size > 0").select("row", "nth", "size", "key", "source_size", "limit"), known.df.count())
        epoch = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("start", F.col("epoch") * F.col("source_size") + F.col("place"))
        taken = epoch.withColumn("end", F.least(F.col("start") + F.col("size"), "limit")).where("start < end")
        parts = taken.withColumn("rank", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}"))))
        low, high = F.greatest(F.col("rank") * block, "start"), F.least((F.col("rank") + 1) * block, "end")
        blocks = parts.select("nth", "rank", "row", "epoch", (low - F.col("start")).alias("first"), (high - low).alias("words"))
        ranked = slots.df.withColumn("in_chunk", F.row_number().over(W.partitionBy("nth", "chunk").orderBy("slot")) - 1)
        ranks = ranked.join(with_before(counts.df, ["nth"], "chunk", "n").drop("n"), ["nth", "chunk"]).select("slot", "nth", (F.col("before") + F.col("in_chunk")).alias("rank"))
        self.spans = blocks.join(ranks, ["nth", "rank"]).select("slot", "row", "epoch", "first", "words")
        self._tables = [sources, slots, counts, limits, known]

    def drop(self) -> None:
        """Remove what the mix has written; only when no result is still to be read."""
        for t in self._tables:
            delete(t.spark, t.path)


def taken(mix: Mix) -> DataFrame:
    """The mix's documents with `taken`: the words that it takes of each, repeats counted."""
    sums = mix.spans.groupBy("row").agg(F.sum("words").alias("taken"))
    return mix.documents.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("row")
