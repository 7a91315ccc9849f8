"""Ranks, sequences, first and last rows, and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import district_code, state_abbreviation, type_code
from ..sources.tables import written
from .columns import numbered


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key the first in the order, nulls a key like any other.

    A ranking filter, so each task keeps its own first rows before the shuffle.
    """
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, keys: list[str], at: str, ties: list[str]) -> DataFrame:
    """The newest row of a key; rows without a time come last."""
    return first_rows(df, keys, [F.col(at).desc_nulls_last(), *[F.col(c) for c in ties]])


def duplicate_rank(keys: list[str], order: list[str]) -> Column:
    """1 for the first row of a key; nulls are one key."""
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order))


def duplicates(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """W1 as a flag, without sorting a hot key's rows in one task: a row is a duplicate unless it's the least of its key."""
    least = df.groupBy(F.col(key).alias("_dk")).agg(F.min(order).alias("_least"))
    return df.join(least, F.col(key).eqNullSafe(F.col("_dk")), "left").withColumn(flag, F.col(order) > F.col("_least")).drop("_dk", "_least")


def key_of_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The key stays on its first row and is null on the others; an aggregate and a join, so that no key's rows are sorted in one task."""
    return duplicates(df, key, order, "_again").withColumn(key, F.when(~F.col("_again"), F.col(key))).drop("_again")


def with_code(df: DataFrame, order: str, prefix: str = "ADR", out: str = "business_code", status: str | None = None, keep_old: str | None = "source_code") -> DataFrame:
    """PREFIX-STATE-DISTRICT-T000001, numbered in order within state, district and type (and status).

    Null where the state or the district has no code; only the other rows are
    numbered.  A code that is there already moves to keep_old.
    """
    if out in df.columns:
        df = df.withColumnRenamed(out, keep_old) if keep_old and keep_old not in df.columns else df.drop(out)
    kind = F.col("address_type") if "address_type" in df.columns else F.lit(None).cast("string")
    parts = written(df.withColumns({"_s": state_abbreviation("state_code"), "_d": district_code("district_code"), "_t": type_code(kind)}))
    coded = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    group = [*([status] if status else []), "_s", "_d", "_t"]
    rows = numbered(parts.where(coded), order, within=group, name="_nth")
    rows = rows.withColumn(out, F.format_string("%s-%s-%s-%s%06d", F.lit(prefix), F.col("_s"), F.col("_d"), F.col("_t"), F.col("_nth") + 1)).drop("_nth")
    none = parts.where(~coded).withColumn(out, F.lit(None).cast("string"))
    return rows.unionByName(none).drop("_s", "_d", "_t")


def surrogate(new: DataFrame, old: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Ids for new rows, from the greatest of old on, in order."""
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return numbered(new.drop(id_col), *order, name="_nth").withColumn(id_col, (F.lit(top) + 1 + F.col("_nth")).cast(dict(old.dtypes)[id_col])).drop("_nth")


def next_id(*tables: tuple[DataFrame, str]) -> DataFrame:
    """The greatest id of the tables, and one more."""
    both = reduce(DataFrame.unionAll, [t.select(F.col(c).cast("long").alias("id")) for t, c in tables])
    return both.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def united(*frames: DataFrame) -> DataFrame:
    """All rows, by column name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing(required: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of required whose keys aren't there; a null key never is."""
    return required.join(there.select(*keys).distinct(), keys, "left_anti")
