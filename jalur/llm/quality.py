"""Quality rules for documents, with DataFrame functions only.

Method: cross-document line frequency.  Lines are normalised and hashed; a line
that is in too many distinct documents of a host is boilerplate there and is
removed; a document of which too little is left is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, let, text_key

#: White space that parts words, as a regular expression and as characters.
_SPACE, _SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]+"
#: Frequent lines that are sent to all executors at most (some 40 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Limits:
    """A line is boilerplate of a host if it is in min_docs distinct documents or
    more and in over host_share of the host's documents.  A document is depleted
    if boilerplate is over max_removed of the characters in its lines, or if fewer
    than min_words words are left without it.
    """

    min_docs: int = 10
    host_share: float = 0.02
    max_removed: float = 0.3
    min_words: int = 50
    max_repeat_percent: int = 50


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _repeated_words(w: Column) -> Column:
    """Words in windows of three that are in the text twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(p: Column) -> Column:  # p: first words of repeated windows, ascending
        return F.aggregate(F.transform(p, lambda q, i: F.when(i == F.size(p) - 1, 3).otherwise(F.least(F.lit(3), F.element_at(p, F.least(i + 2, F.size(p))) - q))), F.lit(0), lambda a, x: a + x)

    def places(s: Column) -> Column:  # s: (hash, place), ascending
        last = F.size(s) - 1
        same = lambda x, i: (x["h"] == s[F.greatest(i - 1, F.lit(0))]["h"]) & (i > 0) | (x["h"] == s[F.least(i + 1, last)]["h"]) & (i < last)
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # most texts repeat nothing: then the sort by place is not needed
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(pairs, places), covered))

    return F.when(F.size(w) < 4, 0).otherwise(let(hashes, count))


def _full_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")


def statistics(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (all long), line_chars and base_failed.  Null text: no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = let(words(t), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated_words(w).alias("repeat")))
    of_lines = let(_full_lines(t), lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("dup"), F.length(F.array_join(x, "")).alias("chars")))
    made = {"n_words": "_jl_w.n", "word_chars": "_jl_w.chars", "n_symbols": "_jl_symbols", "n_dup_lines": "_jl_l.dup", "n_repeat_words": "_jl_w.repeat", "line_chars": "_jl_l.chars"}
    rest = [c for c in docs.columns if c not in (text, "base_failed", *made)]
    rows = docs.select(*rest, of_words.alias("_jl_w"), of_lines.alias("_jl_l"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).alias("_jl_symbols"))
    rows = rows.select(*rest, *(F.col(v).cast("long").alias(k) for k, v in made.items()))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    """Lower case, no outer white space, every number alike."""
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(_SPACES))), "[0-9]+", "0")


def lines(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row a line with a word: id, text hash, host, place in the text, hash, length, words."""
    t = F.coalesce(F.col(text), F.lit(""))
    places = F.filter(F.transform(F.split(t, "\n"), lambda x, i: F.struct(i.alias("place"), F.xxhash64(normalised(x)).alias("line"), F.length(x).alias("chars"), F.regexp_count(x, F.lit(_WORD)).alias("words"), (F.btrim(x, F.lit(_SPACES)) != "").alias("full"))), lambda x: x["full"])
    rows = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.explode(places).alias("x"))
    return rows.select("id", "key", "host", "x.place", "x.line", "x.chars", "x.words")


def boilerplate(of: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The lines (host, line) of lines() that are above the limits."""
    often = of.groupBy("host", "line").agg(F.count_distinct(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull()).alias("n")).where(F.col("n") >= limits.min_docs)
    hosts = of.groupBy("host").agg(F.count_distinct(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull()).alias("docs"))
    return often.join(hosts, "host").where(F.col("n") > limits.host_share * F.col("docs")).select("host", "line")


def _removed(docs: DataFrame, id_col: str, host: str, text: str, limits: Limits) -> DataFrame:
    """Lines of documents that are boilerplate, each once."""
    of = Table(lines(docs, id_col, host, text)).df
    often = Table(boilerplate(of, limits)).df
    if often.count() <= BROADCAST_ROWS:
        often = F.broadcast(often)
    return of.join(often, ["host", "line"], "left_semi").groupBy("id", "key", "place").agg(F.max("chars").alias("chars"), F.max("words").alias("words"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row a document: id_col, the columns of statistics(), removed_chars, removed_words, kept.

    A null host is the host "".  A document is kept unless its base rules fail
    or it is depleted.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    removed = _removed(named, "id", "host", "text", limits).groupBy("id", "key").agg(F.sum("chars").alias("removed_chars"), F.sum("words").alias("removed_words")).select(F.col("id").alias("id2"), F.col("key").alias("key2"), "removed_chars", "removed_words")
    stats = statistics(named.select("id", text_key("text").alias("key"), "text"), "text", limits)
    rows = stats.join(removed, stats["id"].eqNullSafe(F.col("id2")) & (stats["key"] == F.col("key2")), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("removed_chars", "removed_words")})
    kept = ~F.col("base_failed") & (F.col("removed_chars") <= limits.max_removed * F.col("line_chars")) & (F.col("n_words") - F.col("removed_words") >= limits.min_words)
    return rows.withColumn("kept", kept).drop("id2", "key2", "key").withColumnRenamed("id", id_col)


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """docs with boilerplate lines cut out of the text; the other columns stay."""
    gone = _removed(docs, id_col, host, text, limits).groupBy("id", "key").agg(F.collect_set("place").alias("_jl_gone")).select(F.col("id").alias("_jl_id"), F.col("key").alias("_jl_key"), "_jl_gone")
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col("_jl_id")) & (text_key(docs[text]) == F.col("_jl_key")), "left")
    left = let(F.split(F.col(text), "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_jl_gone")), lambda i: x[i]), "\n"))
    return joined.withColumn(text, F.when(F.col("_jl_gone").isNull(), F.col(text)).otherwise(left)).select(*docs.columns)
