"""Finishing, validating and splitting cleaned addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse, score
from .dedupe import duplicates


def finished(df: DataFrame) -> DataFrame:
    """Conflict flag, score, notes and the canonical address."""
    out = df.withColumn("state_postcode_conflict", score.state_postcode_conflict())
    return out.withColumns({"confidence_score": score.confidence(), "correction_notes": score.correction_notes()}).withColumn("address_clean", parse.canonical_address())


def validated(df: DataFrame, order: str = "_row_id", dedupe_on: str = "address_clean", min_confidence: int = 75, require_mukim: bool = False) -> DataFrame:
    """Df with band, reasons and validation_status PASS, WARNING or FAIL.

    The first row of equal addresses (nulls are equal) may pass; flags of lookups
    are those of the time of the lookup, whatever boundaries filled in later.
    """
    out = duplicates(df, dedupe_on, order, "_dup").withColumn("confidence_band", score.band("confidence_score"))
    out = out.withColumns({"error_reasons": score.labels(score.error_flags(F.col("_dup"), min_confidence, require_mukim)), "warning_reasons": score.labels(score.warning_flags())}).drop("_dup")
    return out.withColumns({
        "reason_codes": F.concat("error_reasons", "warning_reasons"),
        "error_reason": F.array_join("error_reasons", "|"),
        "warning_reason": F.array_join("warning_reasons", "|"),
        "validation_status": F.when(F.size("error_reasons") > 0, "FAIL").when(F.size("warning_reasons") > 0, "WARNING").otherwise("PASS"),
    })


def split(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K2: passed, doubtful and failed rows."""
    return tuple(df.where(F.col("validation_status") == s) for s in ("PASS", "WARNING", "FAIL"))


def reason_counts(df: DataFrame) -> DataFrame:
    """Rows of each status and reason."""
    return df.select("validation_status", F.explode_outer("reason_codes").alias("reason")).groupBy("validation_status", "reason").agg(F.count("*").alias("n"))


def low_confidence(df: DataFrame, order: str, limit: int | None = None, least: int = 75) -> DataFrame:
    """Rows below the score; if there's no score, rows that lack a code; the first of them."""
    if "confidence_score" in df.columns:
        weak = F.coalesce(F.col("confidence_score"), F.lit(0)) < least
    else:
        weak = F.lit(False)
        for c in ("state_code", "district_code", "mukim_code"):
            if c in df.columns:
                weak |= F.col(c).isNull()
    out = df.where(weak)
    return out if limit is None else out.orderBy(order).limit(limit)
