"""Column functions, on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from jalur.functions import codes, geo, parse, records, score, text


def values(spark, rows, *columns):
    """Each column's value for each row; rows: texts in column t."""
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string")
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


def test_clean_is_unicode_aware_and_has_null_words(spark):
    got = values(spark, ["\ta \xa0 b\n", "N/A", " null ", "", None, "<NA>", "nano", " x "], text.clean("t"), text.segment("t"), text.padded("t"))
    assert got == [("a b", "A B", " A B "), (None, None, " "), (None, None, " "), (None, None, " "), (None, None, " "), (None, None, " "), ("nano", "NANO", " NANO "), ("x", "X", " X ")]


def test_postcodes(spark):
    assert values(spark, ["A 50450 KL", "123456", "12 345678 05000", None], text.postcode("t"), text.postcode_digits("t")) == [("50450", "50450"), (None, "12345"), ("05000", "12345"), (None, None)]


def test_title_after_anything_but_letters(spark):
    assert values(spark, ["O'NEIL-x 3rd avenue", "kuala lumpur"], text.title("t")) == [("O'Neil-X 3Rd Avenue",), ("Kuala Lumpur",)]


def test_localities(spark):
    assert [v[0] for v in values(spark, [" r & r Tapah", "0Kuala lumpur", "L anas", "A-B"], text.locality("t"))] == ["R&R TAPAH", "KUALA LUMPUR", "LANAS", "A B"]
    got = values(spark, ["59A", "123", "KL", "UNKNOWN", "", None], text.valid_locality(F.col("t"), ["UNKNOWN"]))
    assert [v[0] for v in got] == [False, False, True, False, False, False]


@pytest.mark.parametrize(("a", "b", "same"), [("AYER LANAS", "AYERL ANAS", True), ("PETALING", "PETALINGG", True), ("KLANG", "KLUANG", False), ("KAMPUNG SEPULUH", "KAMPUNG SEPULOH", True), ("KOTA A", "KOTA B", False), ("X", "X", False), ("ALPHABET SEPULUH", "ALPHABEX SEPULOH", False)])
def test_typo_variants(spark, a, b, same):
    assert spark.range(1).select(text.typo_variant(F.lit(a), F.lit(b))).first()[0] is same


def parsed(spark, address):
    return parse.parse(spark.createDataFrame([(address,)], "t string"), "t").first().asDict()


def test_parse_of_a_usual_address(spark):
    p = parsed(spark, "No 12, Jalan Ampang, Taman Maju, 50450 Kuala Lumpur")
    want = {"premise_no": "12", "street_name_prefix": "JALAN", "street_name": "AMPANG", "sub_locality_1": "TAMAN MAJU", "locality_name": "KUALA LUMPUR", "postcode": "50450", "tail2_norm": "KUALA LUMPUR", "tail3_norm": "MAJU KUALA LUMPUR", "tail4_norm": "TAMAN MAJU KUALA LUMPUR"}
    assert {k: p[k] for k in want} == want


@pytest.mark.parametrize(("address", "want"), [("No 10000, Jalan Ampang, Taman Maju, 50450 Kuala Lumpur", "50450"), ("LOT 12345-A, Jalan Ampang, 50450 Kuala Lumpur", "50450"), ("No. 10000", "10000"), ("No 5 50450 Kuala Lumpur", "50450"), ("50450 Kuala Lumpur, Jalan Ampang", "50450"), ("No 7, Jalan Ampang", None)])
def test_a_numbered_premise_is_no_postcode(spark, address, want):
    assert parsed(spark, address)["postcode"] == want


def test_parse_of_other_separators(spark):
    p = parsed(spark, "12; Jalan 1| Kajang")
    assert (p["address_clean"], p["premise_no"], p["street_name"], p["street_name_prefix"], p["locality_name"], p["sub_locality_1"], p["postcode"]) == ("12, JALAN 1, KAJANG", "12", "1", "JALAN", "KAJANG", None, None)


def test_parse_of_a_unit_and_a_street_that_is_lost(spark):
    df = parse.parse(spark.createDataFrame([("Unit A-3-2, Menara X, Jalan Y, 50450 Kuala Lumpur",)], "t string"), "t")
    p = df.first()
    assert (p.unit_no, p.premise_no, p.building_name, p.street_name, p.street_name_prefix, p.sub_locality_1) == ("A-3-2", None, "MENARA X", "MENARA X", None, "JALAN Y")
    r = parse.resolve_sub_localities(df.withColumn("mukim_name", F.lit(None).cast("string"))).first()
    assert (r.street_name, r.sub_locality_1, r.sub_locality_levels) == ("MENARA X", None, [])


def test_parse_of_traps(spark):
    assert parsed(spark, "North Point, Jalan Z, Kajang")["premise_no"] == "RTH"
    assert parsed(spark, "123456 Jalan B")["postcode"] is None
    for t in ("N/A", " ", None):
        p = parsed(spark, t)
        assert all(p[c] is None for c in parse.COMPONENTS + parse.EVIDENCE) and p["address_norm"] == " "


def flags(spark, **over):
    base = dict.fromkeys(("postcode_code", "state_code", "district_code", "mukim_code", "locality_name", "pbt_id", "state_name", "postcode_state_name", "street_name", "sub_locality_1", "sub_locality_2"))
    full = base | {"postcode_code": "50450", "state_code": "14", "district_code": "01", "mukim_code": "02", "locality_name": "KL", "state_name": "KL", "postcode_state_name": "kl", "street_name": "AMPANG"} | over
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in full.items() if k in base])
    marks = [f"{x}_{y}" for x in ("postcode", "state", "district", "mukim") for y in ("from_boundary", "boundary_conflict")] + ["state_postcode_conflict"]
    return df.select("*", *[F.lit(bool(full.get(m))).alias(m) for m in marks]).select(score.confidence().alias("s"), score.band(score.confidence()).alias("b")).first()


def test_scores(spark):
    assert tuple(flags(spark)) == (85, "HIGH")
    every = {f"{x}_from_boundary": True for x in ("postcode", "state", "district", "mukim")}
    assert tuple(flags(spark, pbt_id="DBKL", **every)) == (100, "VERIFIED")
    assert tuple(flags(spark, state_boundary_conflict=True)) == (50, "REJECT")
    assert tuple(flags(spark, street_name=None)) == (75, "REVIEW")


def test_codes(spark):
    got = values(spark, ["1", "14", "kl", "99", "", None], codes.state_code("t"), codes.state_abbreviation("t"), codes.district_code("t"))
    assert got == [("01", "JHR", "01"), ("14", "KL", "14"), ("KL", "KL", None), ("99", None, "99"), (None, None, None), (None, None, None)]
    assert [v[0] for v in values(spark, ["Highrise", "COMMERCIAL X", "office", "Industrial", "zoo", None], codes.type_code("t"))] == ["R", "C", "O", "I", "Z", "U"]


SQUARE = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"
HOLE = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))"
ELL = "POLYGON((0 0, 4 0, 4 1, 1 1, 1 4, 0 4, 0 0))"
TWO = "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 1, 0 0)), ((3 3, 4 3, 4 4, 3 4, 3 3)))"


@pytest.mark.parametrize(
    ("wkt", "x", "y", "within", "meets"),
    [(SQUARE, 2.0, 2.0, True, True), (SQUARE, 5.0, 2.0, False, False), (SQUARE, 0.0, 2.0, False, True), (SQUARE, 4.0, 4.0, False, True), (SQUARE, 2.0, 4.0, False, True), (HOLE, 2.0, 2.0, False, False), (HOLE, 1.0, 2.0, False, True), (HOLE, 0.5, 0.5, True, True), (ELL, 3.0, 3.0, False, False), (ELL, 0.5, 3.0, True, True), (TWO, 3.5, 3.5, True, True), (TWO, 2.0, 2.0, False, False), (SQUARE, -1.0, 0.0, False, False)],
)
def test_point_in_polygon(spark, wkt, x, y, within, meets):
    df = spark.range(1).select(geo.rings_from_wkt(F.lit(wkt)).alias("r"))
    assert tuple(df.select(geo.within(F.col("r"), F.lit(x), F.lit(y)), geo.intersects(F.col("r"), F.lit(x), F.lit(y))).first()) == (within, meets)


def test_geometry(spark):
    rows = [SQUARE, HOLE, TWO, "POLYGON((0 0, 2 2, 2 0, 0 2, 0 0))", "POLYGON((0 0, 1 1, 0 0))", "POINT(1 2)", "nonsense", None, "POLYGON Z ((0 0 9, 4 0 9, 4 4 9, 0 4 9, 0 0 9))"]
    got = values(spark, rows, geo.area(geo.rings_from_wkt("t")), geo.valid(geo.rings_from_wkt("t")))
    assert got == [(16.0, True), (12.0, True), (2.0, True), (0.0, False), (None, False), (None, False), (None, False), (None, False), (16.0, True)]
    p = spark.createDataFrame([(1.5, 2.5), (None, 1.0)], "lon double, lat double").select(geo.point_wkt("lon", "lat")).collect()
    assert [r[0] for r in p] == ["POINT(1.5 2.5)", None]


def test_records(spark):
    assert records.redact({"a": 1, "Password": "x", "in": [{"api_key": 2}]}) == {"a": 1, "Password": "***REDACTED***", "in": [{"api_key": "***REDACTED***"}]}
    got = values(spark, ['text {"a": 1} more', "```json\n[1]\n```", "none"], records.json_text("t"))
    assert [g[0] for g in got] == ['{"a": 1}', "[1]", None]
