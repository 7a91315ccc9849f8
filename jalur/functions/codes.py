"""Codes of states, districts and types, and the business code made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of the states by their code.
STATES = {
    "01": "JHR", "02": "KDH", "03": "KTN", "04": "MLK", "05": "NSN", "06": "PHG", "07": "PNG", "08": "PRK",
    "09": "PLS", "10": "SGR", "11": "TRG", "12": "SBH", "13": "SWK", "14": "KL", "15": "LAB", "16": "PJY",
}


def _text(c: Column | str) -> Column:
    return F.nullif(F.upper(F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))), F.lit(""))


def _filled(t: Column) -> Column:
    return F.when(F.length(t) < 2, F.lpad(t, 2, "0")).otherwise(t)


def state_code(c: Column | str) -> Column:
    """Numbers with two digits at least, other texts as they are."""
    t = _text(c)
    return F.when(t.rlike("^[0-9]+$"), _filled(t)).otherwise(t)


def district_code(c: Column | str) -> Column:
    """The digits, two at least."""
    return _filled(F.nullif(F.regexp_replace(_text(c), r"\D", ""), F.lit("")))


def state_abbreviation(c: Column | str) -> Column:
    """By code; a text of two or three letters stands for itself."""
    code = state_code(c)
    known = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.when(code.rlike("^[A-Z]{2,3}$"), code))


def type_code(c: Column | str) -> Column:
    """One letter; U without a type."""
    t = _text(c)
    return F.when(t.isNull(), "U").when(t.rlike(r"^(RESIDENTIAL|HIGHRISE|RURAL)\b"), "R").when(t.rlike(r"^COMMERCIAL\b"), "C").when(t.rlike(r"^(OFFICE|INSTITUTIONAL)\b"), "O").when(t.rlike(r"^INDUSTRIAL\b"), "I").otherwise(F.substring(t, 1, 1))
