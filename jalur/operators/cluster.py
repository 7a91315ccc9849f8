"""Clusters of misspelt names within a group, and their canonical name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import typo_variant
from ..sources.tables import written


def variant_pairs(names: DataFrame, group: str, name: str) -> DataFrame:
    """Pairs (group, a, b), a < b, of names of a group that are typo variants.

    Names meet through keys that variants share: the name without spaces; a
    deletion neighbourhood of the whole single word; and, for names of several
    words, the words but one with the neighbourhood of that one.
    """
    from .lookup import _deletions

    n = names.select(F.col(group).alias("g"), F.col(name).alias("n")).where("n is not null").distinct()
    packed = n.select("g", "n", F.concat(F.lit("="), F.replace("n", F.lit(" "), F.lit(""))).alias("k"))
    words = n.withColumn("w", F.split("n", " +")).select("g", "n", "w", F.posexplode("w").alias("i", "x"))
    other = F.array_join(F.transform("w", lambda v, j: F.when(j == F.col("i"), F.lit("*")).otherwise(v)), " ")
    probes = words.withColumn("o", other).select("g", "n", "o", F.explode(_deletions("x", F.lit(2), 2)).alias("d")).select("g", "n", F.concat_ws("/", F.lit("~"), "o", "d").alias("k"))
    keys = packed.unionAll(probes).distinct()
    pairs = keys.alias("l").join(keys.alias("r"), ["g", "k"]).where("l.n < r.n").select("g", F.col("l.n").alias("a"), F.col("r.n").alias("b")).distinct()
    return pairs.where(typo_variant("a", "b")).withColumnRenamed("g", group)


def components(pairs: DataFrame, group: str, rounds: int = 50) -> DataFrame:
    """(group, n, root): every name in a pair, with the least name it's linked to, however far.

    Least-label rounds with pointer jumping; each is written down.
    """
    both = written(pairs.select(group, F.col("a").alias("n"), F.col("b").alias("m")).unionAll(pairs.select(group, F.col("b").alias("n"), F.col("a").alias("m"))))
    label = written(both.groupBy(group, "n").agg(F.min("m").alias("root")).withColumn("root", F.least("n", "root")))
    for _ in range(rounds):
        near = both.join(label.withColumnsRenamed({"n": "m", "root": "r"}), [group, "m"]).groupBy(group, "n").agg(F.min("r").alias("r"))
        new = label.join(near, [group, "n"]).select(group, "n", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jump = new.select(group, F.col("n").alias("root"), F.col("root").alias("up"))
        new = written(new.join(jump, [group, "root"], "left").select(group, "n", F.least("root", F.coalesce("up", "root")).alias("root"), "was"))
        label = new.drop("was")
        if new.where("root <> was").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def canonical_names(rows: DataFrame, group: str, name: str, source: str, confidence: dict[str, int]) -> DataFrame:
    """One row (group, name, source) a cluster: the name whose sources weigh most, then with most rows, then the longest, then the least; the source that weighs most."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in confidence.items() for x in p]), F.col(source)), F.lit(0)) if confidence else F.lit(0)
    valued = rows.where(F.col(name).isNotNull()).select(F.col(group).alias("g"), F.col(name).alias("n"), F.col(source).alias("s"), weight.alias("w"))
    stats = valued.groupBy("g", "n", "s", "w").agg(F.count("*").alias("c")).groupBy("g", "n").agg(F.sum("w").alias("weight"), F.sum("c").alias("support"), F.max(F.struct(F.col("w"), F.col("s"))).alias("best"))
    roots = components(variant_pairs(rows, group, name), group).withColumnRenamed(group, "g")
    named = stats.join(roots, ["g", "n"], "left").withColumn("root", F.coalesce("root", "n"))
    rank = F.struct((-F.col("weight")).alias("a"), (-F.col("support")).alias("b"), (-F.length("n")).alias("c"), F.col("n").alias("d"))
    return named.groupBy("g", "root").agg(F.min_by("n", rank).alias("n"), F.max("best").alias("best")).select(F.col("g").alias(group), F.col("n").alias(name), F.col("best.s").alias(source))
