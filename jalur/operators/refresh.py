"""Refreshing lookups from a staged batch: checks, differences, and remaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import not_blank, sql_key
from .dedupe import latest
from .lookup import dimension


def surplus(staged: DataFrame, keys: list[str]) -> DataFrame:
    """A4: rows beyond the first of their key; blank keys don't count."""
    full = reduce(lambda a, b: a & b, [not_blank(k) for k in keys])
    return staged.where(full).groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("row_count"))


def delta_percent(canonical: Column, staged: Column) -> Column:
    """A5: how far the staged count is off; 100 where there was nothing."""
    return F.when(canonical == 0, F.when(staged == 0, 0.0).otherwise(100.0)).otherwise(F.abs(staged - canonical) * 100.0 / canonical)


def gate(percent: Column, warn: float = 10.0, block: float = 25.0) -> tuple[Column, Column]:
    """A5: severity and, if rows differ, status of a change in the number of rows."""
    severity = F.when(percent >= block, "error").otherwise("warning")
    return severity, F.when(percent >= block, "blocked").when(percent >= warn, "warning").otherwise("pass")


def check(counts: DataFrame, name: str, severity: str) -> DataFrame:
    """A row (check_name, severity, status, row_count) of a count."""
    bad = "blocked" if severity == "error" else "warning"
    return counts.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.when(F.col("row_count") <= 0, "pass").otherwise(bad).alias("status"), F.col("row_count").cast("long").alias("row_count"))


def checks(states: DataFrame, postcodes: DataFrame, boundary_ids: dict[str, tuple[DataFrame, str]], localities: DataFrame, canonical: dict[str, DataFrame], warn: float = 10.0, block: float = 25.0) -> DataFrame:
    """The checks of a batch, one row each.

    states: state_code, state_name; postcodes: postcode, postcode_name, staged_at;
    boundary_ids: staged layers and the id that must be there; localities:
    locality_id, locality_name; canonical: the tables state and postcode.
    """
    blank = lambda df, c: df.agg(F.count_if(~not_blank(c)).alias("row_count"))
    out = [
        check(blank(states, "state_code"), "state_missing_state_code", "error"),
        check(blank(states, "state_name"), "state_missing_state_name", "error"),
        check(surplus(states, ["state_code"]), "state_duplicate_state_code", "error"),
        check(blank(postcodes, "postcode"), "postcode_missing_postcode", "error"),
        check(blank(postcodes, "postcode_name"), "postcode_missing_postcode_name", "error"),
        check(surplus(postcodes, ["postcode"]), "postcode_duplicate_postcode", "error"),
        *[check(df.agg(F.count_if(F.col(c).isNull()).alias("row_count")), name, "error") for name, (df, c) in boundary_ids.items()],
        check(with_locality(staged_postcodes(postcodes), localities).agg(F.count_if(F.col("locality_id").isNull()).alias("row_count")), "postcode_unresolved_locality_hint", "warning"),
    ]
    for name, staged in (("state", states), ("postcode", postcodes)):
        both = canonical[name].agg(F.count("*").alias("a")).withColumn("side", F.lit("a")).unionAll(staged.agg(F.count("*").alias("a")).withColumn("side", F.lit("b")))
        counts = both.agg(F.max(F.when(F.col("side") == "a", F.col("a"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("a"))).alias("b"))
        severity, status = gate(delta_percent(F.col("a"), F.col("b")), warn, block)
        status = F.when((F.col("a") == F.col("b")) & (severity == "error"), "pass").otherwise(status)
        out.append(counts.select(F.lit(f"{name}_row_delta_pct").alias("check_name"), severity.alias("severity"), status.alias("status"), F.abs(F.col("b") - F.col("a")).cast("long").alias("row_count")))
    return reduce(DataFrame.unionAll, out)


def overall(rows: DataFrame) -> DataFrame:
    """The worst status."""
    rank = F.when(F.col("status") == "blocked", 2).when(F.col("status") == "warning", 1).otherwise(0)
    worst = F.coalesce(F.max(rank), F.lit(0))
    return rows.agg(F.when(worst == 2, "blocked").when(worst == 1, "warning").otherwise("pass").alias("status"))


def staged_states(df: DataFrame) -> DataFrame:
    """The newest row of each code that isn't blank."""
    return latest(df.where(not_blank("state_code")), ["state_code"], "staged_at", ["state_name"]).select(F.trim("state_code").alias("state_code"), F.trim("state_name").alias("state_name"))


def staged_postcodes(df: DataFrame) -> DataFrame:
    return latest(df.where(not_blank("postcode")), ["postcode"], "staged_at", ["postcode_name"]).select(F.trim("postcode").alias("postcode"), sql_key("postcode_name").alias("postcode_name"))


def with_locality(postcodes: DataFrame, localities: DataFrame) -> DataFrame:
    """The least locality id of the postcode's name."""
    first = localities.groupBy(sql_key("locality_name").alias("_name")).agg(F.min("locality_id").alias("locality_id"))
    return postcodes.join(dimension(first), F.col("postcode_name") == F.col("_name"), "left").drop("_name")


def difference(canonical: DataFrame, staged: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows inserted, updated, unchanged and removed, in one join; keys are unique on either side."""
    old = canonical.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in values], F.lit(1).alias("_old"))
    new = staged.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(1).alias("_new"))
    both = old.join(new, keys, "full")
    same = reduce(lambda a, b: a & b, [F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")) for c in values], F.lit(True))
    return both.agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~same).alias("updated"), F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull() & same).alias("unchanged"), F.count_if(F.col("_new").isNull()).alias("removed"))


def table_counts(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows of each table, canonical and staged."""
    one = lambda name, side, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n")
    parts = [one(name, side, df) for name, pair in tables.items() for side, df in zip(("canonical", "staged"), pair, strict=True)]
    both = reduce(DataFrame.unionAll, parts)
    return both.groupBy("table_name").agg(F.sum(F.when(F.col("side") == "canonical", F.col("n"))).alias("canonical_rows"), F.sum(F.when(F.col("side") == "staged", F.col("n"))).alias("staged_rows"))


def linked(rows: DataFrame, parents: DataFrame, row_key: str, parent_id: str, code: str, name: str, within: str | None = None) -> DataFrame:
    """For each row the parent of its code, else of its name (upper-cased), the least id; within: a column that agrees where the row has it."""
    by_id = parents.select(F.col(parent_id).alias("_id"), F.col(code).alias("_code"), sql_key(name).alias("_name"), *([F.col(within).alias("_in")] if within else []))
    agrees = F.col(within).isNull() | (F.col(within) == F.col("_in")) if within else F.lit(True)
    by_code = rows.join(dimension(by_id), (F.col(code) == F.col("_code")) & agrees).select(row_key, F.struct(F.lit(0).alias("r"), F.col("_id").alias("id")).alias("m"))
    by_name = rows.where(sql_key(name) != "").join(dimension(by_id), (sql_key(name) == F.col("_name")) & agrees).select(row_key, F.struct(F.lit(1).alias("r"), F.col("_id").alias("id")).alias("m"))
    best = by_code.unionAll(by_name).groupBy(F.col(row_key).alias("_k")).agg(F.min("m").alias("m")).select("_k", F.col("m.id").alias(parent_id))
    return rows.drop(parent_id).join(best, F.col(row_key) == F.col("_k"), "left").drop("_k")


def unmatched(rows: DataFrame, *ids: str) -> DataFrame:
    """Rows, and how many of them have no parent, of each id."""
    return rows.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"unmatched_{c}") for c in ids])


def semi(df: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are there."""
    return df.join(keys_of.select(*keys).distinct(), keys, "left_semi")


def exists_flag(df: DataFrame, other: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Whether a row of the keys exists."""
    return df.join(other.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def impact(addresses: DataFrame, column: str, from_id: int, parents: dict[str, int | None], streets: DataFrame | None = None, new_locality: int | None = None) -> DataFrame:
    """A2: addresses of an id that a remap touches, how many parents change, and how many streets go."""
    rows = addresses.where(F.col(column) == from_id)
    counts = [F.count("*").alias("rows"), *[F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(f"{c}_changes") for c, v in parents.items()]]
    if streets is not None:
        rows = rows.join(dimension(streets.select("street_id", F.col("locality_id").alias("_street_locality"))), "street_id", "left")
        counts.append(F.count_if(F.col("street_id").isNotNull() & ~F.col("_street_locality").eqNullSafe(F.lit(new_locality))).alias("street_clears"))
    return rows.agg(*counts)


def remapped(addresses: DataFrame, column: str, from_id: int, to_id: int, parents: dict[str, int | None], streets: DataFrame | None = None, new_locality: int | None = None) -> DataFrame:
    """M5: an id and its parents replaced; a street of another locality is cleared."""
    hit = F.coalesce(F.col(column) == from_id, F.lit(False))
    new = {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in parents.items()}
    out = addresses
    if streets is not None:
        out = out.join(dimension(streets.select("street_id", F.col("locality_id").alias("_street_locality"))), "street_id", "left")
        new["street_id"] = F.when(hit & ~F.col("_street_locality").eqNullSafe(F.lit(new_locality)), F.lit(None)).otherwise(F.col("street_id"))
    return out.withColumns(new | {column: F.when(hit, F.lit(to_id)).otherwise(F.col(column))}).select(*addresses.columns)
