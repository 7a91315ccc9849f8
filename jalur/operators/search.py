"""Ranked search as one types, by a written inverted index.

Three fields come from a text: its words, and its runs of two and of three
words.  A query's last entry in each field is a beginning, the others are whole
entries.  A row's score is the sum of BM25 over the whole entries it has, plus 1
for each field in which an entry of it starts with the beginning.

The index has a block for some BLOCK postings of an entry; the postings of a
block have about the same weight, and a block says the greatest.  A query first
works out, from the dictionary alone, a score that its `limit` best rows surely
reach.  Its lightest entries, which don't reach it together, make no row a
candidate: of them only the blocks are read in which a candidate's posting would
be.  Of the others, blocks whose rows can't reach the score are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import delete, written
from .lookup import dimension

#: Postings of a block, steps of weight that are kept apart, and letters of beginnings that have their own postings.
BLOCK, STEPS, LETTERS = 128, 16, 3
#: How soon a repeated entry counts less, and how much a long text does.
K1, B = 1.2, 0.75
FIELDS = (1, 2, 3)
#: Entries up to which a query's entries are also pushed down to the scan, which doesn't change the result.
PUSHED = 1000
_SLACK = 1e-5  # scores are rounded to 6 places


def words(text: Column) -> Column:
    """Letters and digits in lower case, cut at everything else."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def runs(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _counted(entries: Column) -> Column:
    """Each distinct entry and how often it occurs, by sorting."""
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def count(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (s[i] != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(s[i].alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf"))))

    return F.when(F.size(entries) > 0, let(F.array_sort(entries), count)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def _beginnings(entries: Column, letters: int) -> Column:
    each = F.transform(F.array_distinct(entries), lambda t: F.transform(F.sequence(F.lit(1), F.least(F.lit(letters), F.length(t))), lambda k: F.substring(t, F.lit(1), k)))
    return F.array_distinct(F.flatten(each))


def block_of(id_: Column, n: Column, block: int) -> Column:
    """The block of a row's posting among n of about its weight."""
    return F.pmod(F.xxhash64(id_), F.ceil(n / block))


def build(df: DataFrame, path: str, id_col: str, text: str, rank: str, block: int = BLOCK, letters: int = LETTERS) -> "Index":
    """Write the index of df under path: `terms`, `blocks` and `stats`.

    rank: a number that decides between equal scores.  Rows without a word are
    in no posting.  Rows are told apart by id_col.
    """
    rows = written(df.select(F.col(id_col).alias("id"), F.col(rank).cast("double").alias("rank"), words(F.col(text)).alias("w")))
    sizes = [F.greatest(F.size("w") - (n - 1), F.lit(0)) for n in FIELDS]
    one = rows.agg(*[F.count_if(s > 0) for s in sizes], *[F.coalesce(F.sum(s), F.lit(0)) for s in sizes]).first()
    n_rows, mean = {n: one[k] for k, n in enumerate(FIELDS)}, {n: one[3 + k] / max(1, one[k]) for k, n in enumerate(FIELDS)}

    def postings_of(n: int, size: Column) -> list[Column]:
        entries = runs(F.col("w"), n)
        part = lambda x: x["tf"] / (x["tf"] + K1 * (1 - B + B * size / F.lit(mean[n] or 1.0)))
        whole = F.transform(_counted(entries), lambda x: F.struct(F.lit(n).alias("field"), x["term"].alias("term"), part(x).alias("part")))
        # a beginning's postings have the field's number with a minus and all weigh 1
        return [whole, F.transform(_beginnings(entries, letters), lambda t: F.struct(F.lit(-n).alias("field"), t.alias("term"), F.lit(1.0).alias("part")))]

    per_field = [c for n, size in zip(FIELDS, sizes, strict=True) for c in postings_of(n, size)]
    postings = written(rows.select("id", "rank", F.explode(F.concat(*per_field)).alias("p")).select("id", "rank", "p.*", F.least(F.floor(F.col("p.part") * STEPS), F.lit(STEPS - 1)).cast("int").alias("step")))
    steps = postings.groupBy("field", "term", "step").agg(F.count("*").alias("n"), F.min("part").alias("least"), F.max("part").alias("best"))
    total = reduce(lambda a, n: a.when(F.abs("field") == n, n_rows[n]), FIELDS, F.when(F.lit(False), 0))
    idf = F.when(F.col("field") < 0, 1.0).otherwise(F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    levels = F.reverse(F.array_sort(F.collect_list(F.struct("step", "n", "least", "best"))))  # STEPS at most
    terms = steps.groupBy("field", "term").agg(F.sum("n").alias("df"), levels.alias("levels")).withColumn("idf", idf)
    terms = terms.withColumn("levels", F.transform("levels", lambda x: F.struct(x["step"].alias("step"), x["n"].alias("n"), (x["least"] * F.col("idf")).alias("least"), (x["best"] * F.col("idf")).alias("best")))).withColumn("head", F.substring("term", 1, letters))
    terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/terms")
    spark = df.sparkSession
    sized = written(spark.read.parquet(f"{path}/terms").select("field", "term", "idf", F.explode("levels").alias("l")).select("field", "term", "idf", "l.step", "l.n"))
    # both written, so that a join with an entry that very many rows have can be split
    dealt = postings.join(sized, ["field", "term", "step"]).withColumn("block", block_of(F.col("id"), F.col("n"), block))
    blocks = dealt.groupBy("field", "term", "step", "block").agg(F.max(F.col("part") * F.col("idf")).alias("best"), F.collect_list(F.struct("id", "rank", (F.col("part") * F.col("idf")).alias("weight"))).alias("rows"))
    blocks.repartitionByRange("field", "term", "step", "block").sortWithinPartitions("field", "term", F.desc("step")).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(n, n_rows[n], float(mean[n]), letters, block) for n in FIELDS], "field int, rows long, mean double, letters int, block int").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    for t in (rows, postings, sized):
        delete(t)
    return Index(spark, path)


class Index:
    """An index that build() has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.terms, self.blocks = spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/blocks")
        stats = spark.read.parquet(f"{path}/stats").first()
        self.letters, self.block = stats["letters"], stats["block"]

    def asked(self, queries: DataFrame, query_id: str, text: str) -> DataFrame:
        """query, field, term, times and kind ('w' whole or 'b' beginning) of each entry that a query looks up.

        A beginning of up to `letters` letters has its own postings; a longer one
        stands for the dictionary's entries that start with it.
        """

        def entries(n: int) -> Column:
            return F.transform(runs(F.col("w"), n), lambda t, k: F.struct(F.lit(n).alias("field"), t.alias("term"), (k == F.size("w") - n).alias("last")))

        each = [entries(n) for n in FIELDS]
        said = queries.select(F.col(query_id).alias("query"), words(F.col(text)).alias("w")).select("query", F.explode(F.concat(*each)).alias("e")).select("query", "e.*")
        whole = said.where(~F.col("last")).groupBy("query", "field", "term").agg(F.count("*").cast("double").alias("times")).withColumn("kind", F.lit("w"))
        last = said.where("last").select("query", "field", F.col("term").alias("start"))
        short = last.where(F.length("start") <= self.letters).select("query", (-F.col("field")).alias("field"), F.col("start").alias("term"))
        long = last.where(F.length("start") > self.letters).withColumn("head", F.substring("start", 1, self.letters))
        grown = self.terms.select("field", "term", "head").join(dimension(long), ["field", "head"]).where(F.startswith("term", "start")).select("query", "field", "term")
        return whole.unionByName(short.unionAll(grown).select("query", "field", "term", F.lit(1.0).alias("times"), F.lit("b").alias("kind")))

    def bounded(self, queries: DataFrame, query_id: str, text: str, limit: int) -> DataFrame:
        """asked(), with levels, `light` (whether the entry makes no row a candidate) and `cut`, the weight under which a block of it can't matter."""
        asked = self.asked(queries, query_id, text).join(self.terms.select("field", "term", "levels"), ["field", "term"])
        whole = F.col("kind") == "w"

        # of each whole entry: the weight that `limit` rows reach, step by step from the greatest
        def step(a: Column, x: Column) -> Column:
            left = a["left"] - x["n"]
            return F.struct(left.alias("left"), F.when((a["left"] > 0) & (left <= 0), x["least"]).otherwise(a["at"]).alias("at"))

        reached = F.aggregate("levels", F.struct(F.lit(limit).cast("long").alias("left"), F.lit(0.0).alias("at")), step, lambda a: a["at"])
        most = F.when(whole, F.col("times") * F.col("levels")[0]["best"])
        rows = written(asked.select("query", "field", "term", "times", "kind", "levels", most.alias("most"), F.when(whole, F.col("times") * reached).otherwise(0.0).alias("reached")))
        # a field's beginnings give 1 together
        tops = rows.groupBy("query").agg(F.coalesce(F.sum("most"), F.lit(0.0)).alias("all_whole"), F.count_distinct(F.when(~whole, F.abs("field"))).alias("begun"), F.max("reached").alias("reached"))
        most = F.coalesce("most", F.lit(1.0))
        upto = F.sum(most).over(W.partitionBy("query").orderBy(most, "field", "term").rowsBetween(W.unboundedPreceding, W.currentRow))
        cut = F.col("reached") - (F.col("all_whole") + F.col("begun") - most) - _SLACK
        return rows.drop("reached").join(tops, "query").select("query", "field", "term", "times", "kind", "levels", (upto < F.col("reached") - _SLACK).alias("light"), cut.alias("cut"))

    def _scanned(self, entries: DataFrame) -> DataFrame:
        some = entries.select("field", "term").distinct().limit(PUSHED + 1).collect()
        return self.blocks.where(F.col("term").isin([r["term"] for r in some])) if len(some) <= PUSHED else self.blocks

    def met(self, bounded: DataFrame) -> DataFrame:
        """The blocks that make candidates: of entries that aren't light, those that can reach the score."""
        heavy = bounded.where(~F.col("light")).drop("levels")
        weight = F.when(F.col("kind") == "w", F.col("times") * F.col("best")).otherwise(1.0)
        return self._scanned(heavy).join(dimension(heavy), ["field", "term"]).where(weight >= F.col("cut"))

    def probed(self, bounded: DataFrame, candidates: DataFrame) -> DataFrame:
        """The blocks of light entries in which a posting of a candidate (query, id) would be."""
        light = bounded.where("light").select("query", "field", "term", "times", "kind", F.explode("levels").alias("l")).select("query", "field", "term", "times", "kind", "l.step", "l.n")
        places = candidates.join(dimension(light), "query").select("query", "field", "term", "times", "kind", "step", block_of(F.col("id"), F.col("n"), self.block).alias("block")).distinct()
        return self._scanned(light).join(places, ["field", "term", "step", "block"])

    def top(self, queries: DataFrame, limit: int = 10, query_id: str = "query_id", text: str = "query") -> DataFrame:
        """query_id, place (from 1), id, rank and score of each query's best rows.

        The greatest score first, then the greatest rank, rows without one last,
        then the least id; scores are rounded to 6 places, so that the order in
        which they're added up decides nothing.  limit is held between 1 and 50.
        A query without a word finds nothing.  Queries of the same words are
        worked out once.
        """
        limit = min(50, max(1, limit))
        said = written(queries.select(F.col(query_id).alias("_id"), F.array_join(words(F.col(text)), " ").alias("_said")))
        texts = written(said.select("_said").distinct().withColumn("query", F.monotonically_increasing_id()))
        bounded = written(self.bounded(texts, "query", "_said", limit))
        hit = ["query", "field", "kind", "times", F.explode("rows").alias("r")]
        heavy = self.met(bounded).select(*hit).withColumn("heavy", F.lit(True))
        candidates = heavy.select("query", F.col("r.id").alias("id")).distinct()
        hits = heavy.unionByName(self.probed(bounded, candidates).select(*hit).withColumn("heavy", F.lit(False)))
        begun = [F.coalesce(F.max(F.when((F.col("kind") == "b") & (F.abs("field") == n), 1.0)), F.lit(0.0)) for n in FIELDS]
        score = F.coalesce(F.sum(F.when(F.col("kind") == "w", F.col("times") * F.col("r.weight"))), F.lit(0.0)) + sum(begun[1:], begun[0])
        found = hits.groupBy("query", F.col("r.id").alias("id"), F.col("r.rank").alias("rank")).agg(F.round(score, 6).alias("score"), F.max("heavy").alias("heavy")).where("heavy")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("rank").desc_nulls_last(), "id"))
        best = found.withColumn("place", place).where(F.col("place") <= limit)
        return best.join(said.join(texts, "_said"), "query").select(F.col("_id").alias(query_id), "place", "id", "rank", "score")
