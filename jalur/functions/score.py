"""Confidence, notes, reasons and statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import LOCALITY, MUKIM, STREET
from .text import clean, is_false, postcode, truthy, upper_clean

_flag = truthy
_has = lambda c: F.col(c).isNotNull()
_like = lambda c, p: F.coalesce(upper_clean(c), F.lit("")).rlike("(?i)" + p)
_same = lambda a, b: F.coalesce(_has(b) & (upper_clean(a) == upper_clean(b)), F.lit(False))


def state_postcode_conflict() -> Column:
    """The state isn't that of the postcode."""
    return F.coalesce(_has("postcode_code") & _has("state_name") & _has("postcode_state_name") & ~upper_clean("state_name").eqNullSafe(upper_clean("postcode_state_name")), F.lit(False))


def weights() -> list[tuple[Column, int]]:
    """What speaks for an address and against it. The points."""
    return [
        (postcode("postcode_code").isNotNull(), 10),
        (_has("state_code"), 20),
        (_has("district_code"), 20),
        (_has("mukim_code"), 15),
        (_has("locality_name"), 10),
        (_has("pbt_id"), 10),
        (_flag("postcode_from_boundary"), 10),
        (_same("state_name", "postcode_state_name"), 5),
        (_has("district_code") & _has("mukim_code"), 5),
        (_has("pbt_id") & _has("state_code"), 5),
        (_flag("state_from_boundary"), 10),
        (_flag("district_from_boundary"), 10),
        (_flag("mukim_from_boundary"), 10),
        (_flag("state_boundary_conflict"), -35),
        (_flag("district_boundary_conflict"), -35),
        (_flag("mukim_boundary_conflict"), -35),
        (_flag("postcode_boundary_conflict"), -35),
        (_flag("state_postcode_conflict"), -25),
        (_like("locality_name", MUKIM), -20),
        (_like("sub_locality_1", STREET) | _like("sub_locality_2", STREET), -15),
        (_like("sub_locality_1", LOCALITY) | _like("sub_locality_2", LOCALITY), -10),
        (clean("street_name").isNull(), -10),
    ]


def confidence() -> Column:
    """The sum of the points, from 0 to 100."""
    total = reduce(lambda a, b: a + b, [truthy(c).cast("int") * n for c, n in weights()])
    return F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("int")


def band(score: Column | str) -> Column:
    """X15. The bounds."""
    s = F.coalesce(F.col(score) if isinstance(score, str) else score, F.lit(0))
    return F.when(s >= 95, "VERIFIED").when(s >= 85, "HIGH").when(s >= 70, "REVIEW").otherwise("REJECT")


def labels(flags: dict[str, Column]) -> Column:
    """The names of the flags that are true, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def correction_notes() -> Column:
    """X16."""
    names = ["postcode_from_boundary", "postcode_boundary_conflict", "state_from_boundary", "district_from_boundary", "mukim_from_boundary", "state_boundary_conflict", "district_boundary_conflict", "mukim_boundary_conflict", "state_postcode_conflict"]
    return labels({n: _flag(n) for n in names} | {"postcode_standardized_with_name": clean("postcode_code").isNotNull() & clean("postcode_name").isNotNull()})


def error_flags(duplicate: Column, min_confidence: int = 75, require_mukim: bool = False) -> dict[str, Column]:
    """what makes an address fail."""
    flags = {
        "missing_address": F.coalesce(F.col("is_missing_address"), F.lit(True)) | clean("address_clean").isNull(),
        "invalid_postcode": postcode("postcode_code").isNull(),
        "postcode_boundary_conflict": _flag("postcode_boundary_conflict"),
        "missing_state": ~_has("state_code"),
        "invalid_state_lookup": is_false("state_lookup_valid"),
        "missing_district": ~_has("district_code"),
        "invalid_district_lookup": is_false("district_lookup_valid"),
        "state_postcode_conflict": _flag("state_postcode_conflict"),
        "state_boundary_conflict": _flag("state_boundary_conflict"),
        "district_boundary_conflict": _flag("district_boundary_conflict"),
        "mukim_boundary_conflict": _flag("mukim_boundary_conflict"),
        "low_confidence": F.coalesce(F.col("confidence_score"), F.lit(0)) < min_confidence,
        "duplicate_address": duplicate,
    }
    return flags | ({"missing_mukim": ~_has("mukim_code"), "invalid_mukim_lookup": is_false("mukim_lookup_valid")} if require_mukim else {})


def warning_flags() -> dict[str, Column]:
    """what makes an address doubtful."""
    return {"missing_coordinates": ~_has("latitude") | ~_has("longitude")}


def unit_score(c: Column | str) -> Column:
    """A score of 0 to 100, or of 0 to 1, as 0 to 1 with four places; 0 if it's no number."""
    x = F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("double"), F.lit(0.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x > 1, x / 100).otherwise(x))), 4)


def match_status(score: Column) -> Column:
    """Success needs 85 points and all codes, partial 60. The bounds."""
    core = F.trim(F.coalesce(F.col("state_code"), F.lit(""))) != ""
    for c in ("district_code", "mukim_code"):
        core &= F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return F.when((score >= 85) & core, "success").when(score >= 60, "partial").otherwise("failed")
