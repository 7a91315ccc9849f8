"""Address data made from the star-schema tables, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import boundaries
from .pipeline import Lookups


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def addresses(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("No "), F.col("c_custkey"), F.lit(", Jalan "), "c_mktsegment", F.lit(", Taman "), F.col("c_custkey") % 7, F.lit(", "), 10000 + F.col("c_custkey") % 90000, F.lit(" "), F.replace("n_name", F.lit("_"), F.lit(" ")), F.lit(", "), "r_name")
    even = F.col("c_custkey") % 2 == 0
    return rows.select(F.col("c_custkey").alias("id"), text.alias("address"), F.when(even, (F.col("c_custkey") % 100 + 0.5)).alias("lon"), F.when(even, (F.col("c_custkey") * 7 % 100 + 0.5)).alias("lat"))


ADDRESSES = """addr as (select c_custkey as id, n_nationkey, r_regionkey, n_name, r_name, c_mktsegment,
 'No ' || c_custkey || ', Jalan ' || c_mktsegment || ', Taman ' || (c_custkey % 7) || ', ' || (10000 + c_custkey % 90000) || ' ' || replace(n_name, '_', ' ') || ', ' || r_name as address,
 case when c_custkey % 2 = 0 then c_custkey % 100 + 0.5 end as lon, case when c_custkey % 2 = 0 then c_custkey * 7 % 100 + 0.5 end as lat
 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.format_string("%02d", F.col("r_regionkey") + 1).alias("state_code"), F.col("r_name").alias("state_name"), F.col("r_regionkey").cast("long").alias("_ord"))


def districts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.format_string("%02d", F.col("n_regionkey") + 1).alias("state_code"), F.format_string("%02d", "n_nationkey").alias("district_code"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("district_name"), F.col("n_nationkey").cast("long").alias("_ord"))


def mukims(spark: SparkSession, d: str) -> DataFrame:
    """Five places for each district: TAMAN 0 to TAMAN 4."""
    k = districts(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).join(F.broadcast(states(spark, d).drop("_ord")), "state_code")
    return k.select("state_code", "state_name", "district_code", "district_name", F.format_string("%02d", "k").alias("mukim_code"), F.concat(F.lit("Taman "), "k").alias("mukim_name"), (F.col("_ord") * 10 + F.col("k")).cast("string").alias("mukim_id"), (F.col("_ord") * 10 + F.col("k")).alias("_ord"))


def postcodes(spark: SparkSession, d: str) -> DataFrame:
    """The postcodes of every third address."""
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    rows = c.where("c_custkey % 3 = 0").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select((10000 + F.col("c_custkey") % 90000).cast("string").alias("postcode"), F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("city"), F.col("r_name").alias("state"), F.col("c_custkey").alias("_ord"))


def lookups(spark: SparkSession, d: str) -> Lookups:
    return Lookups(postcodes(spark, d), states(spark, d), districts(spark, d), mukims(spark, d))


def squares(spark: SparkSession, d: str) -> DataFrame:
    """A square of 20 by 20 for each nation, in five columns."""
    x, y = F.col("n_nationkey") % 5 * 20, F.floor(F.col("n_nationkey") / 5) * 20
    wkt = F.format_string("POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))", x, y, x + 20, y, x + 20, y + 20, x, y + 20, x, y)
    return boundaries(table(spark, d, "nation").select(F.col("n_nationkey").alias("district_id"), F.format_string("%02d", "n_nationkey").alias("district_code"), "n_name", F.col("n_nationkey").alias("_ord"), wkt.alias("geom_wkt")))


def bands(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping strips, one for each region, of different widths."""
    x = F.col("r_regionkey") * 10
    wkt = F.format_string("POLYGON((%d 0, %d 0, %d 100, %d 100, %d 0))", x, x + 20 + x, x + 20 + x, x, x)
    return boundaries(table(spark, d, "region").select(F.col("r_regionkey").alias("state_id"), wkt.alias("geom_wkt")))

