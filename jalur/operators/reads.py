"""Reads: star joins, hierarchies, filters, orders, search and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import autocomplete_text, document
from .lookup import dimension


def star(facts: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Facts with the columns of each dimension, left-joined on the given key."""
    for key, dim in dims.items():
        facts = facts.join(dimension(dim), key, "left")
    return facts


def by_code(codes: DataFrame, facts: DataFrame, code: str, dims: dict[str, DataFrame]) -> DataFrame:
    """The facts of a business code, with their dimensions."""
    return star(codes.where(F.col("code") == code).join(facts, "address_id"), dims)


def chain(child: DataFrame, *parents: tuple[DataFrame, str], how: str = "inner") -> DataFrame:
    """Child with its parent, that one's parent and so on, each by its key."""
    for parent, key in parents:
        child = child.join(dimension(parent), key, how)
    return child


def filtered(df: DataFrame, **values) -> DataFrame:
    """rows whose columns equal the values; None asks for nothing."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def containing(df: DataFrame, text: str | None, columns: list[str], id_col: str | None = None) -> DataFrame:
    """rows one of whose columns contains the text in any case, or whose id is the text; % and _ are wildcards."""
    if not text:
        return df
    hit = F.col(id_col).cast("string") == text if id_col else F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.ilike(F.col(c), F.lit(f"%{text}%")), F.lit(False))
    return df.where(hit)


def newest(df: DataFrame, at: str, id_col: str, limit: int | None = None) -> DataFrame:
    """Newest first, rows without a time last, then the greater id."""
    out = df.orderBy(F.col(at).desc_nulls_last(), F.col(id_col).desc())
    return out if limit is None else out.limit(limit)


def open_first(df: DataFrame, status: str, order: list[str], at: str, id_col: str, limit: int) -> DataFrame:
    """O2: by the status' place in order, then newest first."""
    rank = F.lit(len(order))
    for k in range(len(order) - 1, -1, -1):
        rank = F.when(F.col(status) == order[k], k).otherwise(rank)
    return df.orderBy(rank, F.col(at).desc_nulls_last(), F.col(id_col).desc()).limit(limit)


def ascending(df: DataFrame, *columns: str) -> DataFrame:
    """By the columns, nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def oldest(df: DataFrame, statuses: list[str], at: str, id_col: str, before: Column, limit: int, status: str = "status") -> DataFrame:
    """Rows of a status whose time is before the cutoff, oldest first."""
    return df.where(F.col(status).isin(statuses) & (F.col(at) < before)).orderBy(F.col(at), F.col(id_col)).limit(limit)


def summary(*columns: str) -> Column:
    """The texts that aren't null, comma-joined."""
    return F.concat_ws(", ", *[F.col(c) for c in columns])


def search_documents(df: DataFrame, key: str, fields: list[str], suggest: list[str]) -> DataFrame:
    """One JSON document a row, without empty fields, and the text that suggestions come from."""
    return df.withColumn("autocomplete", autocomplete_text(*suggest)).select(F.col(key).cast("string").alias("id"), document([key, *fields, "autocomplete"]).alias("document"))


def search(df: DataFrame, query: str, text: str, score: str, id_col: str, limit: int = 10) -> DataFrame:
    """Rows whose text has every word of the query, the last one as a beginning; by matched words, then score, missing scores last.

    limit is held between 1 and 50.
    """
    words = query.lower().split()
    have = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    if not words:
        return df.limit(0).withColumn("matched", F.lit(0))
    hits = [F.array_contains(have, w) for w in words[:-1]] + [F.exists(have, lambda x: F.startswith(x, F.lit(words[-1])))]
    found = df.withColumn("matched", sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))).where(F.col("matched") == len(words))
    return found.orderBy(F.desc("matched"), F.col(score).desc_nulls_last(), F.col(id_col)).limit(min(50, max(1, limit)))


def formatted(df: DataFrame, components: list[str]) -> DataFrame:
    """record_id, score and status, the components as one struct, and a sign for how sure it is."""
    from ..functions.score import match_status, unit_score

    status = match_status(F.col("confidence_score"))
    sign = F.when(status == "success", "green").when(status == "partial", "yellow").otherwise("red")
    why = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in ("state_code", "district_code", "mukim_code")]))
    return df.select("record_id", unit_score("confidence_score").alias("confidence"), status.alias("status"), sign.alias("indicator"), F.struct(*components).alias("address"), why.alias("fallback_reasons"))


def tallies(df: DataFrame, groups: dict[str, list[str]], status: str = "status") -> DataFrame:
    """Rows whose status is of each group."""
    return df.agg(*[F.count_if(F.col(status).isin(values)).alias(name) for name, values in groups.items()])


def rates(events: DataFrame, at: str, kind: str, width: str = "5 minutes") -> DataFrame:
    """Events of each kind in windows of time, and how many a second."""
    w = events.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("window_start"), kind, "events", (F.col("events") / (F.col("w.end").cast("timestamp").cast("long") - F.col("w.start").cast("timestamp").cast("long"))).alias("per_second"))


def histogram(events: DataFrame, value: str, bounds: list[float], by: list[str] = ()) -> DataFrame:
    """How many values are no more than each bound; the last bound is open."""
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{k}") for k, b in enumerate(bounds)]
    return events.groupBy(*by).agg(*counts, F.count(value).alias("le_inf"))


def quantile(hist: DataFrame, bounds: list[float], q: float, by: list[str] = ()) -> DataFrame:
    """The quantile by straight line within a histogram's bucket; the last bound beyond it."""
    target = F.col("le_inf") * q
    out = F.lit(float(bounds[-1]))
    for k in range(len(bounds) - 1, -1, -1):
        low, under = (bounds[k - 1], F.col(f"le_{k - 1}")) if k else (0.0, F.lit(0))
        span = F.col(f"le_{k}") - under
        out = F.when(F.col(f"le_{k}") >= target, low + (bounds[k] - low) * (target - under) / F.when(span == 0, 1).otherwise(span)).otherwise(out)
    return hist.select(*by, F.when(F.col("le_inf") > 0, out).alias("value"))
