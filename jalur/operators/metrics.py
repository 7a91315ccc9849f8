"""A14, A15 over time: counters that start anew, and sketches of quantiles that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The relative error of a quantile at most.
ERROR = 0.01


def increase(df: DataFrame, series: list[str], at: str, value: str, tie: str, width: str = "1 hour") -> DataFrame:
    """Series, window_start and increase of a counter in each window that has readings.

    A reading less than the one before means that the counter started anew from
    0, so all of it counts.  The first reading of a series counts nothing.  The
    step into a window from the last reading before it counts in the window.
    Readings without a value or a time are left out; tie orders readings of one time.
    Readings are compared within windows, and the windows' first and last ones
    then with each other, so no task holds all readings of a series.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(at).isNotNull()).withColumn("_w", F.window(at, width)["start"])
    within = W.partitionBy(*series, "_w").orderBy(at, tie)
    step = lambda now, before: F.when(before.isNull(), 0).when(now >= before, now - before).otherwise(now)
    place = F.struct(at, tie)
    parts = rows.withColumn("_step", step(F.col(value), F.lag(value).over(within))).groupBy(*series, "_w").agg(F.sum("_step").alias("_in"), F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last"))
    into = step(F.col("_first"), F.lag("_last").over(W.partitionBy(*series).orderBy("_w")))
    return parts.select(*series, F.col("_w").alias("window_start"), (F.col("_in") + into).cast("double").alias("increase"))


def bucket(value: Column, error: float = ERROR) -> Column:
    """A whole number for values that are within the relative error of each other: 0 for 0, less than that for negative ones, the sign kept."""
    base = (1 + error) / (1 - error)
    size = F.ceil(F.log(F.abs(value)) / F.log(F.lit(base))).cast("long") + (1 << 20)
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def bucket_value(b: Column, error: float = ERROR) -> Column:
    """A value that is within the relative error of all values of the bucket."""
    base = (1 + error) / (1 - error)
    return F.when(b == 0, 0.0).otherwise(F.signum(b.cast("double")) * 2 * F.pow(F.lit(base), (F.abs(b) - (1 << 20)).cast("double")) / (base + 1))


def sketch(df: DataFrame, value: str, by: list[str | Column] = (), error: float = ERROR) -> DataFrame:
    """By, bucket and n of the values that are there; sketches of parts are added up by added()."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, bucket(F.col(value).cast("double"), error).alias("bucket")).agg(F.count("*").alias("n"))


def added(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sketch of all that these sketches are of; the same as of one pass over the values."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, qs: list[float], by: list[str] = (), error: float = ERROR) -> DataFrame:
    """by, q and value: for each q the value of rank ceil(q * n), and 1 at least, within the relative error.

    A sketch has some 70,000 rows at most for all doubles there are, at an error of 0.01.
    """
    over = W.partitionBy(*by)
    ranked = sketches.withColumns({"_upto": F.sum("n").over(over.orderBy("bucket")), "_all": F.sum("n").over(over)})
    asked = ranked.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).where(F.col("_upto") >= F.greatest(F.ceil(F.col("q") * F.col("_all")), F.lit(1)))
    return asked.groupBy(*by, "q").agg(F.min("bucket").alias("b")).select(*by, "q", bucket_value(F.col("b"), error).alias("value"))
