"""Later copies of repeated runs of lines.

Method: a suffix array over line-id sequences by distributed prefix doubling.
In round k every line gets the rank, in sorted order, of the 2^k lines from it
on, named from the ranks of its two halves.  A run of m lines is then the pair
of ranks of its first and its last 2^k lines, 2^k <= m, and all suffixes with
that pair are one interval of the suffix array whose longest common prefix is m
or more; of each such interval the first member in text order is the original
and the others are copies.

A line goes if it lies in a run of at least min_words words that is also
earlier.  It's enough to ask this of the shortest such run from each line on
and the shortest one up to each line: every line of a longer repeated run lies
in one of those within it.  These have min_words lines at most, so that the
ranks need no more than log2(min_words) rounds, and the union of the copies
found is the union of all maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, let, text_key

_SPACES, _WORD = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]+"
#: Documents with cut lines that are sent to all executors at most, by total number of cut lines; beyond, the join shuffles.
BROADCAST_LINES = 1_000_000
#: Repeated line ids (12 bytes each) that are sent to all executors at most; beyond, the join shuffles and splits hot ids.
BROADCAST_IDS = 250_000


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row a line with a word: id, key (of the text), place (line number), nth (among these), two hashes, words."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    of = F.filter(F.transform(split, lambda x, i: F.struct(i.alias("place"), F.btrim(x, F.lit(_SPACES)).alias("line"))), lambda x: x["line"] != "")
    ids = F.transform(of, lambda x, i: F.struct(x["place"].alias("place"), i.alias("nth"), F.xxhash64(x["line"]).alias("h"), F.hash(x["line"]).alias("g"), F.regexp_count(x["line"], F.lit(_WORD)).alias("words")))
    return docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), F.explode(ids).alias("x")).select("id", "key", "x.*")


def _segments(lines: DataFrame, min_words: int) -> DataFrame:
    """Unbroken stretches of repeated lines, with min_words words or more, as rows: id, key, x (an array of lines)."""
    again = Table(lines.groupBy("h", "g").count().where("count > 1").select("h", "g")).df
    if again.count() <= BROADCAST_IDS:
        again = F.broadcast(again)
    repeated = lines.join(again, ["h", "g"], "left_semi")
    stretch = F.col("nth") - F.dense_rank().over(W.partitionBy("id", "key").orderBy("nth"))
    rows = repeated.withColumn("stretch", stretch).groupBy("id", "key", "stretch").agg(F.sort_array(F.collect_set(F.struct("nth", "place", "h", "g", "words"))).alias("x")).drop("stretch")
    return rows.where(F.aggregate("x", F.lit(0), lambda a, x: a + x["words"]) >= min_words)


def ranks(rows: DataFrame, rounds: int) -> Table:
    """rows (seg, pos, h, g and more) with r0 to r{rounds}: ranks of 1, 2, 4, ... lines from pos on, in sorted order.

    Beyond the segment's end every line ranks least.  Ranks are numbers without
    density; each round sorts the distinct pairs and is written down.
    """

    def named(of: DataFrame, pair: list[str], rank: str) -> Table:
        names = Table(of.select(*pair).distinct().orderBy(*pair).withColumn(rank, F.monotonically_increasing_id()))
        out = Table(of.join(names.df, pair).drop(*pair))
        names.drop()
        return out

    now = named(rows, ["h", "g"], "r0")
    for k in range(rounds):
        ahead = F.lead(f"r{k}", 1 << k, -1).over(W.partitionBy("seg").orderBy("pos"))
        new = named(now.df.withColumns({"a": F.col(f"r{k}"), "b": ahead}), ["a", "b"], f"r{k + 1}")
        now.drop()
        now = new
    return now


def copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """One row a document with lines that go: id, key (of the text), places (line numbers from 0, ascending).

    Text order is by id (null first), then text hash, then line.  Lines are
    compared without outer white space; lines without a word are left out of the
    sequences and never go.
    """
    lines = Table(_lines(docs, id_col, text))
    segments = Table(_segments(lines.df, min_words))
    lines.drop()
    # segments that are equal as a whole: the first stays for the suffix array, the others go
    same = F.struct(F.xxhash64(F.transform("x", lambda x: F.struct(x["h"], x["g"]))), F.hash(F.transform("x", lambda x: x["h"])), F.size("x"))
    at = F.struct("id", "key", F.col("x")[0]["nth"].alias("nth"))
    marked = segments.df.withColumns({"same": same, "at": at})
    first = Table(marked.groupBy("same").agg(F.min("at").alias("first")))
    told = marked.join(first.df, "same")
    gone = told.where("at <> first").select("id", "key", F.transform("x", lambda x: x["place"]).alias("places"))
    kept = Table(told.where("at = first").orderBy("at").select("id", "key", "x", F.monotonically_increasing_id().alias("seg")))
    depth = max(0, min_words.bit_length() - 1)
    ranked = ranks(kept.df.select("seg", F.posexplode("x").alias("pos", "l")).select("seg", "pos", "l.place", "l.words", "l.h", "l.g"), depth)
    total = F.sum("words").over(W.partitionBy("seg").orderBy("pos"))
    item = F.struct("pos", "place", "total", F.array(*[f"r{k}" for k in range(depth + 1)]).alias("r"))
    whole = ranked.df.withColumn("total", total).groupBy("seg").agg(F.sort_array(F.collect_list(item)).alias("x"))
    whole = whole.withColumn("sums", F.concat(F.array(F.lit(0).cast("long")), F.transform("x", lambda x: x["total"])))
    n = F.size("x")
    # ends of the shortest runs from each line on, and starts of the shortest ones up to each line
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("lo"), F.get(F.filter(F.sequence(i + 1, F.least(i + min_words, n)), lambda j: F.col("sums")[j] - F.col("sums")[i] >= min_words), F.lit(0)).alias("hi")))
    starts = F.transform(F.sequence(F.lit(1), n), lambda j: F.struct(F.get(F.filter(F.sequence(j - 1, F.greatest(j - min_words, F.lit(0))), lambda i: F.col("sums")[j] - F.col("sums")[i] >= min_words), F.lit(0)).alias("lo"), j.alias("hi")))
    runs = whole.withColumn("runs", F.filter(F.array_union(ends, starts), lambda r: r["lo"].isNotNull() & r["hi"].isNotNull()))

    table = Table(runs.select("seg", F.explode(F.transform("runs", _run))).select("seg", "col.*"))
    ranked.drop()
    original = table.df.groupBy("m", "a", "b").agg(F.min(F.struct("seg", "lo")).alias("first"))
    later = table.df.join(original, ["m", "a", "b"]).where(F.struct("seg", "lo") > F.col("first"))
    spans = later.groupBy("seg").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("lo"), F.col("lo") + F.col("m") - 1)))).alias("at"))
    cut = kept.df.join(spans, "seg").select("id", "key", F.expr("transform(at, i -> x[i].place)").alias("places"))
    return gone.unionAll(cut).groupBy("id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))


def _run(r):
    """Identity of the run [lo, hi) of the segment x: its length, and the ranks of its first and its last 2^k lines."""
    m = r["hi"] - r["lo"]
    k = F.floor(F.log2(m.cast("double")) + 1e-9).cast("int")
    return F.struct(m.alias("m"), F.col("x")[r["lo"]]["r"][k].alias("a"), F.col("x")[r["hi"] - F.pow(F.lit(2), k).cast("int")]["r"][k].alias("b"), r["lo"].alias("lo"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 50, report: bool = False) -> DataFrame:
    """docs with later copies cut out of the text; the other columns stay.

    A document of which no line with a word is left by the cut has an empty
    text.  report: columns cut_places (array of line numbers) is added.  A null
    text stays null.
    """
    found = Table(copies(docs, id_col, text, min_words)).df.select(F.col("id").alias("_jl_id"), F.col("key").alias("_jl_key"), F.col("places").alias("_jl_places"))
    n = found.agg(F.coalesce(F.sum(F.size("_jl_places")), F.lit(0))).first()[0]
    if n <= BROADCAST_LINES:  # at most 16 MB or so
        found = F.broadcast(found)
    rows = docs.join(found, docs[id_col].eqNullSafe(F.col("_jl_id")) & (text_key(docs[text]) == F.col("_jl_key")), "left")
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_jl_places")), lambda i: x[i])
    cut = let(let(F.split(F.col(text), "\n"), left), lambda x: F.when(F.exists(x, lambda y: F.btrim(y, F.lit(_SPACES)) != ""), F.array_join(x, "\n")).otherwise(""))
    rows = rows.withColumn(text, F.when(F.col("_jl_places").isNull(), F.col(text)).otherwise(cut))
    names = [c for c in docs.columns if not (report and c == "cut_places")]
    return rows.select(*names, *([F.coalesce("_jl_places", F.array().cast("array<int>")).alias("cut_places")] if report else []))
