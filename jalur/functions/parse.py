"""Free-text addresses into components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import POSTCODE, address_text, clean, padded, postcode, segment, upper_clean

# Patterns that results depend on.
STREET = r"\b(JALAN\s+RAYA|JALANRAYA|JALAN|LORONG|PERSIARAN|LEBUHRAYA|LEBUH)\b"
LOCALITY = r"\b(BANDAR(?:\s+BARU)?|BANDARAYA|PEKAN|CITY)\b"
MUKIM = r"\bMUKIM\b"
BUILDING = r"\b(APARTMENT|APARTMEN|PANGSAPURI|KONDOMINIUM|CONDO|FLAT|RUMAH\s+PANGSA|MENARA|TOWER|WISMA|PLAZA|KOMPLEKS|BLOK|BLOCK|RESIDENSI|RESIDENCE|HOTEL|MALL|ARKED|PPR|PPRT|PPA1M)\b"
LOT = (r"\bLOT\s*([0-9A-Z/-]+)", r"\bPT\s*([0-9A-Z/-]+)")
UNIT = (r"\b(?:UNIT|APT|APARTMENT|SUITE|STE)\s*([0-9A-Z/-]+)", r"(\b[A-Z]?\d+-\d+(?:-\d+)?\b)")
FLOOR = (r"\b(?:FLOOR|LEVEL|LVL|TINGKAT|TKT|ARAS)\s*([0-9A-Z/-]+)",)
PREMISE = (r"\bNO\.?\s*([0-9A-Z/-]+)", r"^([0-9A-Z/-]+)")
#: What names a number that isn't a postcode.
NAMED = (*LOT, UNIT[0], *FLOOR, PREMISE[0])
TYPES = [
    ("HIGHRISE", r"(APARTMENT|APARTMEN|PANGSAPURI|KONDOMINIUM|KONDO|CONDO|FLAT|RUMAH PANGSA|MENARA|TOWER|RESIDENSI|RESIDENCE|SOHO|SOFO|SERVICED RESIDENCE|PPR|PPA1M)"),
    ("INSTITUTIONAL", r"(HOSPITAL|SCHOOL|MOSQUE|SURAU|POLICE STATION|BALAI POLIS|GOVERNMENT BUILDING|PEJABAT)"),
    ("INDUSTRIAL", r"(FACTORY|INDUSTRIAL LOT|PERINDUSTRIAN|INDUSTRI|WAREHOUSE|GUDANG)"),
    ("COMMERCIAL", r"(SHOPLOT|SHOP LOT|SHOPPING MALL|MALL|PLAZA|KOMPLEKS|OFFICE TOWER|WISMA|ARKED)"),
    ("RURAL", r"(ORANG ASLI SETTLEMENT|KAMPUNG|KG|FELDA|FELCRA|LADANG|ESTET|RKT|RPT|RPS)"),
    ("RESIDENTIAL", r"(BUNGALOW|SEMI-D|SEMI D|TERRACE HOUSE|KAMPUNG HOUSE|FELDA HOUSE|ESTATE HOUSE|RUMAH)"),
]

COMPONENTS = ["premise_no", "lot_no", "unit_no", "floor_no", "street_name_prefix", "street_name", "building_name", "locality_name", "sub_locality_1", "sub_locality_2", "postcode"]
#: Texts that a place name is compared with.
EVIDENCE = ["seg2_norm", "seg3_norm", "seg4_norm", "seg5_norm", "tail2_norm", "tail3_norm", "tail4_norm"]


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    """The group of the first pattern that is found."""
    return F.coalesce(*[F.get(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(0)) for p in patterns])


def _found(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + pattern)


def _postcode() -> Column:
    """X5, but a number that the first segment names as a lot, unit, floor or premise is one only if no other five digits stand alone."""
    first = F.col("_u1")
    for pattern in NAMED:
        first = F.regexp_replace(first, pattern, " ")
    return F.coalesce(postcode(F.concat_ws(", ", first, F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))))), postcode("_a"))


def parse(df: DataFrame, address: str) -> DataFrame:
    """Df with address_clean, COMPONENTS, EVIDENCE and address_norm; columns of these names are replaced.

    Segments are what commas part.  The first tells lot, unit, floor and premise
    numbers, the second the street, the third to fifth sub-localities and locality.
    """
    step = df.withColumn("_a", F.nullif(F.regexp_replace(address_text(clean(address)), "[;|]+", ","), F.lit("")))
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("_a"), F.lit("")), r"\s*,\s*"), lambda x: F.trim(x)), lambda x: x != "")
    step = step.withColumn("_p", parts)
    at = lambda k: clean(F.get("_p", F.lit(k)))
    step = step.withColumns({f"_s{k + 1}": at(k) for k in range(5)})
    step = step.withColumns({"_u1": F.coalesce(upper_clean("_s1"), F.lit("")), "_u2": F.coalesce(upper_clean("_s2"), F.lit(""))})
    bare = lambda k: upper_clean(F.regexp_replace(F.col(f"_s{k}"), POSTCODE, ""))
    words = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(F.col("_a"), F.lit("")), POSTCODE, ""), r"(?U)\s+"), lambda w: segment(w)), lambda w: w.isNotNull())
    step = step.withColumns({"_b3": bare(3), "_b4": bare(4), "_b5": bare(5), "_w": words, "_lot": _first(F.col("_u1"), LOT), "_unit": _first(F.col("_u1"), UNIT), "_floor": _first(F.col("_u1"), FLOOR), "_street": F.nullif(F.regexp_extract("_u2", "(?i)^" + STREET, 1), F.lit(""))})
    rest = F.nullif(F.trim(F.when(F.col("_street").isNotNull() & F.substring("_u2", F.length("_street") + 1, F.lit(1)).rlike(r"\s"), F.substring("_u2", F.length("_street") + 1, F.length("_u2")))), F.lit(""))
    tail = lambda k: F.when(F.size("_w") >= k, F.array_join(F.slice("_w", -k, k), " "))
    step = step.withColumns({
        "address_clean": F.col("_a"),
        "premise_no": F.when(F.coalesce("_lot", "_unit", "_floor").isNull(), _first(F.col("_u1"), PREMISE)),
        "lot_no": F.col("_lot"),
        "unit_no": F.col("_unit"),
        "floor_no": F.col("_floor"),
        "street_name_prefix": F.col("_street"),
        "street_name": F.coalesce(rest, upper_clean("_s2")),
        "building_name": F.when(_found(F.col("_u1"), BUILDING), F.col("_u1")).when(_found(F.col("_u2"), BUILDING), F.col("_u2")),
        "locality_name": F.coalesce("_b5", "_b4", "_b3"),
        "sub_locality_1": F.when(F.col("_s4").isNotNull(), F.col("_b3")),
        "sub_locality_2": F.when(F.col("_s5").isNotNull(), F.col("_b4")),
        "postcode": _postcode(),
        **{f"seg{k}_norm": segment(f"_s{k}") for k in range(2, 6)},
        **{f"tail{k}_norm": tail(k) for k in range(2, 5)},
        "address_norm": padded("_a"),
    })
    return step.drop("_a", "_p", "_w", "_lot", "_unit", "_floor", "_street", "_u1", "_u2", "_b3", "_b4", "_b5", *(f"_s{k}" for k in range(1, 6)))


def resolve_sub_localities(df: DataFrame) -> DataFrame:
    """Street, mukim and locality from segments that name one; what is left are sub_locality_levels."""
    subs = F.filter(F.array(upper_clean("sub_locality_1"), upper_clean("sub_locality_2")), lambda v: v.isNotNull())
    step = df.withColumn("_subs", subs)
    of = lambda pattern: F.get(F.filter("_subs", lambda v: _found(v, pattern)), F.lit(0))
    mukims = F.filter(F.array(upper_clean("locality_name"), upper_clean("sub_locality_2"), upper_clean("sub_locality_1")), lambda v: _found(v, MUKIM))
    step = step.withColumns({
        "street_name": F.when(clean("street_name").isNull(), F.coalesce(of(STREET), F.col("street_name"))).otherwise(F.col("street_name")),
        "_mukim": F.when(clean("mukim_name").isNull(), F.coalesce(F.get(mukims, F.lit(0)), F.col("mukim_name"))).otherwise(F.col("mukim_name")),
        "_locality": F.when(~_found(upper_clean("locality_name"), MUKIM), F.col("locality_name")),
    })
    step = step.withColumn("locality_name", F.when(clean("_locality").isNull(), F.coalesce(of(LOCALITY), F.col("_locality"))).otherwise(F.col("_locality"))).withColumn("mukim_name", F.col("_mukim"))
    taken = F.array(*[upper_clean(c) for c in ("street_name", "building_name", "locality_name", "mukim_name")])
    left = F.filter("_subs", lambda v: ~_found(v, STREET) & ~_found(v, LOCALITY) & ~_found(v, MUKIM) & ~F.exists(taken, lambda t: t.eqNullSafe(v)))
    step = step.withColumn("sub_locality_levels", left)
    return step.withColumns({"sub_locality_1": F.get("sub_locality_levels", F.lit(0)), "sub_locality_2": F.get("sub_locality_levels", F.lit(1))}).drop("_subs", "_mukim", "_locality")


def address_type(*signals: Column | str) -> Column:
    """The first type of which a keyword is in the texts."""
    text = F.concat_ws(" ", *[F.coalesce(upper_clean(s), F.lit("")) for s in signals])
    out = F.when(text.rlike(TYPES[0][1]), TYPES[0][0])
    for label, pattern in TYPES[1:]:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise("UNKNOWN")


def canonical_address() -> Column:
    """The components as one text, in a fixed order; address_clean if there are none."""
    street = F.when(clean("street_name").isNotNull() & clean("street_name_prefix").isNotNull() & ~_found(clean("street_name"), "^" + STREET), F.concat_ws(" ", clean("street_name_prefix"), clean("street_name"))).otherwise(clean("street_name"))
    named = [F.concat(F.lit(label + " "), clean(c)) for label, c in (("LOT", "lot_no"), ("NO", "premise_no"), ("UNIT", "unit_no"), ("LEVEL", "floor_level"))]
    code = clean(F.coalesce(F.nullif("postcode_code", F.lit("")), F.col("postcode")))
    text = F.upper(F.concat_ws(", ", *named, clean("building_name"), street, clean("sub_locality_1"), clean("sub_locality_2"), clean("locality_name"), code, clean("state_name")))
    return F.coalesce(F.nullif(text, F.lit("")), upper_clean("address_clean"))
