"""Corrections of failed rows, and the retry of what they change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import retry_key
from . import columns
from .dedupe import first_rows

# Columns that a retry works out anew.
DERIVED = [
    "address_clean",
    "premise_no",
    "street_name",
    "locality_name",
    "postcode",
    "state_code",
    "state_name",
    "district_code",
    "district_name",
    "mukim_code",
    "mukim_name",
    "mukim_id",
    "pbt_id",
    "pbt_name",
    "confidence_score",
    "validation_status",
    "error_reason",
    "error_reasons",
    "warning_reason",
    "warning_reasons",
    "reason_codes",
    "_address_norm",
    "seg2_norm",
    "seg3_norm",
    "seg4_norm",
    "seg5_norm",
]
#: What this engine works out beside these.
OWN = ["address_norm", "address_type_raw", "business_code", "confidence_band", "correction_notes", "geom", "is_missing_address", "tail2_norm", "postcode_code", "postcode_name", "postcode_city", "postcode_state_name", "state_lookup_valid", "district_lookup_valid", "mukim_lookup_valid", "state_postcode_conflict"]
#: The address to parse, by what a row has.
TARGETS = ["address_for_parse", "source_address_new", "source_address_old"]


def by_text(failed: DataFrame, corrections: DataFrame, source: str = "source_address", corrected: str = "corrected_address", order: str = "_ord", target: str = "address_for_parse") -> DataFrame:
    """The first correction of a source text, in any case and spacing, in place of the text."""
    fix = first_rows(corrections.where(retry_key(corrected) != "").withColumn("_key", retry_key(source)), ["_key"], [F.col(order)]).select("_key", F.col(corrected).alias("_fixed"))
    out = failed.withColumn("_key", retry_key(target)).join(fix, "_key", "left")
    return out.withColumn(target, F.coalesce("_fixed", target)).drop("_key", "_fixed")


def by_id(failed: DataFrame, corrections: DataFrame, key: str = "record_id", order: str | None = None, corrected: str = "corrected_address") -> DataFrame:
    """Columns of the first correction of an id over those of the row; nulls change nothing.

    order tells which correction is first; without it the least by all columns.
    A corrected address replaces the address to parse.
    """
    target = next((c for c in [*TARGETS, columns.detect_address(failed.columns)] if c in failed.columns), "address")
    first = first_rows(corrections, [key], [F.col(order)] if order else [F.col(c) for c in corrections.columns])
    first = first.drop(*([target] if corrected in first.columns else []), *([order] if order else [])).withColumnRenamed(corrected, target)
    return columns.overlaid(failed, first, key, [c for c in first.columns if c != key])


def retry_rows(failed: DataFrame, given: list[str] = ()) -> DataFrame:
    """P20: without what the retry works out anew, but for given, which the corrections hold; the address to parse is the new one, else the old one."""
    gone = [c for c in failed.columns if (c in DERIVED or c in OWN or c.startswith("_") or c.endswith(("_from_boundary", "_boundary_conflict"))) and c not in given and c != "_row_id"]
    found = [F.col(c) for c in TARGETS if c in failed.columns]
    out = failed.withColumn("_address", F.coalesce(*found)) if found else failed
    out = out.drop(*gone, *TARGETS)
    return out.withColumnRenamed("_address", "address") if found else out


def retried(failed: DataFrame, corrections: DataFrame, run: Callable[[DataFrame], DataFrame], key: str | None = None, order: str | None = None) -> DataFrame:
    """Failed rows with corrections (by key, or by text), through the pipeline again.

    Columns that the corrections give by key stay as given where a row has a
    correction of them; everything else that was derived is worked out anew.
    """
    if key is None:
        return run(retry_rows(by_text(failed, corrections, order=order or "_ord")))
    given = [c for c in corrections.columns if c in DERIVED or c in OWN]
    fixed = by_id(failed.withColumns({c: F.lit(None).cast(failed.schema[c].dataType) for c in given if c in failed.columns}), corrections, key, order)
    return run(retry_rows(fixed, given))


def paired(results: DataFrame, records: DataFrame, key: str = "record_id", order: str | None = None) -> DataFrame:
    """Results with their records by key, or by order where there are no keys."""
    if order:
        there = columns.numbered(records.withColumnRenamed(order, "_rec_order"), "_rec_order", name="_place")
        return columns.numbered(results, order, name="_place").join(there, "_place", "left").drop("_place", "_rec_order")
    return results.join(records, key, "left")
