"""Operators, sources, sinks and plans, on small tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from jalur.functions.text import config_bool
from jalur.operators import cluster, columns, corrections, dedupe, lookup, model_map, reads, snapshot, spatial, validate
from jalur.plans import config, queries
from jalur.plans.pipeline import Layers, Lookups, standardised
from jalur.sources import readers, tables, writers
from jalur.streaming import jobs


def test_column_detection():
    assert columns.detect(["Full_Address", "X"], ["address", "full address"]) == "Full_Address"
    assert columns.detect_address(["Alamat Penuh 1", "new address"]) == "Alamat Penuh 1"
    assert columns.detect_address(["alamat a", "alamat b"]) is None
    assert config_bool({"x": " Yes "}, "x", False) and not config_bool({}, "x", False)


NAMES = [("BATU PAHAT", 1), ("MUAR", 2), ("KLANG", 3), ("KLUANG", 4), ("KOTA-X", 5), ("PAGOH", 6), ("PAGOH", 7)]


def match(spark, address, *evidence, near=None):
    lk = spark.createDataFrame([(n, "01", k) for n, k in NAMES], "name string, state_code string, _ord long")
    row = spark.createDataFrame([(1, address, *[*evidence, None, None][:2], None)], "k long, address_norm string, seg2_norm string, seg3_norm string, state_code string")
    found = lookup.best_match(row, lk, "name", ["name"], "k", ["state_code"]).collect()
    return (found[0]._m_name, found[0]._m_ord) if found else None


def test_fuzzy_matches(spark):
    assert match(spark, " ", "BATU PAHT") == ("BATU PAHAT", 1)
    assert match(spark, " ", "MUARA") == ("MUAR", 2)
    assert match(spark, " ", "MURA") is None
    assert match(spark, " JALAN KLANG X ", "KLUANG") == ("KLANG", 3)
    assert match(spark, " KOTA X ", "KOTA X") == ("KOTA-X", 5)  # a mark in the name: near only
    assert match(spark, " PAGOH ", None) == ("PAGOH", 6)  # equal names: the earlier
    assert match(spark, " ", None) is None


def test_match_within_a_state(spark):
    lk = spark.createDataFrame([("MUAR", "01", 1), ("MUAR", "02", 2)], "name string, state_code string, _ord long")
    rows = spark.createDataFrame([(1, " MUAR ", "02"), (2, " MUAR ", None), (3, " MUAR ", "03")], "k long, address_norm string, state_code string")
    got = {r.k: r._m_ord for r in lookup.best_match(rows, lk, "name", ["name"], "k", ["state_code"]).collect()}
    assert got == {1: 2, 2: 1}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_matches_against_all_pairs(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("ABCD", k=rng.randint(3, 9))) for _ in range(60)} | {"KLUANG", "SEPANG", "GOMBAK"})
    texts = [*{"".join(rng.choices("ABCD", k=rng.randint(3, 9))) for _ in range(300)}, "KLOENG", "SIPING", "GUMBEK"]
    lk = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, _ord long")
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, seg2_norm string").withColumn("address_norm", F.lit(" "))
    got = {r.k: (r._m__distance, r._m_name) for r in lookup.best_match(rows, lk, "name", ["name"], "k").collect()}
    want = {}
    for k, t in enumerate(texts):
        near = [(d, -len(n), o, n) for o, n in enumerate(names) if (d := edits(t, n)) <= (1 if len(n) <= 5 else 2)]
        if near:
            d, _, _, n = min(near)
            want[k] = (d, n)
    assert got == want and {len(texts) - 3, len(texts) - 2, len(texts) - 1} <= set(got)


def test_duplicates_and_codes(spark):
    df = spark.createDataFrame([(0, "A"), (1, "A"), (2, None), (3, None), (4, "B")], "_row_id long, address_clean string")
    got = {r._row_id: r.d for r in dedupe.duplicates(df, "address_clean", "_row_id", "d").collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}
    rows = spark.createDataFrame([(0, "14", "1", "RESIDENTIAL"), (1, "99", "1", "RESIDENTIAL"), (2, "14", "1", "HIGHRISE")], "_row_id long, state_code string, district_code string, address_type string")
    assert [r.business_code for r in dedupe.with_code(rows, "_row_id").orderBy("_row_id").collect()] == ["ADR-KL-01-R000001", None, "ADR-KL-01-R000002"]


def test_row_numbers_are_dense(spark):
    df = columns.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), "v")
    assert all(r._row_id == r.v for r in df.collect())


def square(spark, *rows):
    df = spark.createDataFrame([(k, f"POLYGON(({x} {y}, {x + w} {y}, {x + w} {y + w}, {x} {y + w}, {x} {y}))") for k, x, y, w in rows], "id int, geom_wkt string")
    return spatial.boundaries(df.withColumn("_ord", F.col("id").cast("long")))


def test_spatial_joins(spark):
    shapes = square(spark, (1, 0, 0, 10), (2, 5, 5, 2), (3, -100, -100, 300))
    points = spark.createDataFrame([(1, 6.0, 6.0), (2, 10.0, 10.0), (3, None, 1.0), (4, -50.0, -50.0), (5, 999.0, 0.0), (6, 5.0, 6.0)], "k int, longitude double, latitude double")
    assert {r.k: r._b_id for r in spatial.first_within(points, shapes, "k", ["id"]).collect()} == {1: 1, 2: 3, 4: 3, 6: 1}
    assert {r.k: r.id for r in spatial.smallest_meeting(points, shapes, "k", "id").collect()} == {1: 2, 2: 1, 4: 3, 6: 2}
    none = points.where("longitude is null")
    assert spatial.first_within(none, shapes, "k", ["id"]).count() == 0  # no coordinates at all is no error


@pytest.fixture(scope="module")
def batch(spark):
    states = spark.createDataFrame([("14", "KUALA LUMPUR", 0), ("10", "SELANGOR", 1)], "state_code string, state_name string, _ord long")
    districts = spark.createDataFrame([("14", "01", "KUALA LUMPUR", 0), ("10", "02", "PETALING", 1)], "state_code string, district_code string, district_name string, _ord long")
    mukims = spark.createDataFrame([("14", "KUALA LUMPUR", "01", "KUALA LUMPUR", "05", "AMPANG", "1", 0), ("10", "SELANGOR", "02", "PETALING", "07", "DAMANSARA", "2", 1)], "state_code string, state_name string, district_code string, district_name string, mukim_code string, mukim_name string, mukim_id string, _ord long")
    postcodes = spark.createDataFrame([("50450", "kuala lumpur", "kuala lumpur", 0), ("50450", "other", "other", 1)], "postcode string, city string, state string, _ord long")
    raw = [(1, "No 12, Jalan Ampang, Taman Maju, 50450 Kuala Lumpur", "101.5", "3.5"), (2, "No 12, Jalan Ampang, Taman Maju, 50450 Kuala Lumpur", "101.5", "3.5"), (3, "No 9, Jalan Ampang, 50450 Kuala Lumpur", "x", None), (4, None, "101.5", "3.5"), (5, "No 7, Jalan Z, Damansara, 47400 Petalin", "250", "3.5")]
    df = spark.createDataFrame([(str(a), b, c, d) for a, b, c, d in raw], "record_id string, Alamat string, LON string, LAT string")
    layer = spatial.boundaries(spark.createDataFrame([("14", "KUALA LUMPUR", "01", "KUALA LUMPUR", "05", "AMPANG", 0, "POLYGON((101 3, 102 3, 102 4, 101 4, 101 3))")], "state_code string, state_name string, district_code string, district_name string, mukim_code string, mukim_name string, _ord long, geom_wkt string"))
    out = standardised(df, Lookups(postcodes, states, districts, mukims), Layers(state=layer, district=layer, mukim=layer), order="record_id")
    return {r.record_id: r for r in out.collect()}


def test_pipeline(batch):
    one = batch["1"]
    assert (one.validation_status, one.state_code, one.district_code, one.mukim_code, one.postcode, one.business_code) == ("PASS", "14", "01", "05", "50450 Kuala Lumpur", "ADR-KL-01-U000001")
    assert one.confidence_score == 100 and one.confidence_band == "VERIFIED" and "state_from_boundary" in one.correction_notes
    assert batch["2"].validation_status == "FAIL" and batch["2"].error_reason == "duplicate_address"
    assert batch["3"].validation_status == "WARNING" and batch["3"].warning_reason == "missing_coordinates"
    assert "missing_address" in batch["4"].reason_codes and "invalid_state_lookup" in batch["4"].reason_codes  # filled by a boundary, after the lookup
    assert batch["5"].district_code == "02" and "invalid_state_lookup" in batch["5"].reason_codes


def test_splits_and_counts(spark, batch):
    df = spark.createDataFrame([(r.record_id, r.validation_status, r.reason_codes) for r in batch.values()], "record_id string, validation_status string, reason_codes array<string>")
    assert [p.count() for p in validate.split(df)] == [1, 1, 3]
    assert validate.reason_counts(df).where("reason is null").first().n == 1


def test_corrections_fill_only_what_they_have(spark):
    failed = spark.createDataFrame([("a", "old 1", None), ("b", "old 2", "x")], "record_id string, source_address_old string, source_address_new string")
    fixed = corrections.by_id(failed, spark.createDataFrame([("a", "new 1", "note")], "record_id string, source_address_new string, note string")).orderBy("record_id").collect()
    assert [(r.source_address_old, r.source_address_new, r.note) for r in fixed] == [("old 1", "new 1", "note"), ("old 2", "x", None)]


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, v string, id int")
    new = spark.createDataFrame([("b", None), ("c", "z")], "k string, v string")
    assert sorted(map(tuple, snapshot.upserted(old, new, ["k"], ["v"], "id").collect())) == [("a", "x", 1), ("b", None, 2), ("c", "z", 3)]
    assert sorted(map(tuple, snapshot.upserted(old, new, ["k"], ["v"], "id", ["v"]).collect())) == [("a", "x", 1), ("b", "y", 2), ("c", "z", 3)]
    assert [snapshot.guarded(s, a) for s, a in (("blocked", True), ("pass", True), ("warning", False))] == ["blocked", "applied", "dry_run"]


def test_swap_and_checkpoint(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    tables.swap(spark.range(3), at)
    tables.swap(spark.range(5), at)
    assert spark.read.parquet(at).count() == 5
    stage = f"file://{tmp_path}/stage"
    made = []
    make = lambda: made.append(1) or spark.range(4)
    for print_ in ("f", "f", "g"):
        assert tables.checkpointed(make, spark, stage, "s", "j", print_).count() == 4
    assert len(made) == 2
    assert json.loads(open(f"{tmp_path}/stage.metadata.json").read())["rows"] == 4


def test_clusters(spark):
    rows = spark.createDataFrame([("S", "PETALING", "a"), ("S", "PETALINGG", "b"), ("S", "PETALINGGG", "b"), ("S", "AYER LANAS", "b"), ("S", "AYERLANAS", "a"), ("S", "KLANG", "b"), ("T", "PETALING", "b")], "g string, n string, s string")
    got = {(r.g, r.n) for r in cluster.canonical_names(rows, "g", "n", "s", {"a": 2, "b": 1}).collect()}
    assert got == {("S", "PETALING"), ("S", "AYERLANAS"), ("S", "KLANG"), ("T", "PETALING")}


def test_model_that_fails_leaves_rows(spark):
    def bad(texts):
        raise ValueError

    out = model_map.mapped(spark.createDataFrame([("x",), (None,)], "t string"), bad, "t").collect()
    assert [(r.model_text, r.model_score) for r in out] == [("x", 0.0), (None, 0.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("postcode,name\n05000,x\n")
    (tmp_path / "b.csv").write_text("name,extra\ny,1\n")
    got = readers.csv_files(spark, f"{tmp_path}/*.csv").orderBy("name").collect()
    assert [(r.postcode, r.name, r.extra) for r in got] == [("05000", "x", None), (None, "y", "1")]
    with pytest.raises(FileNotFoundError):
        readers.csv_files(spark, f"{tmp_path}/none*.csv")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "d.json").write_text('[\n{"a": 1},\n{"a": 2}\n]')
    assert readers.json_files(spark, f"{tmp_path}/l.jsonl").count() == readers.json_files(spark, f"{tmp_path}/d.json").count() == 2
    assert readers.json_rows(spark, {"data": [{"a": 1, "b": [1]}, {"a": "x"}]}).collect()[0].b == "[1]"
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"NAME": "n", "CODE": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0, 5], [1, 0, 5], [1, 1, 5], [0, 0, 5]]]}}]}))
    g = readers.geojson(spark, f"{tmp_path}/g.geojson", {"name": "NAME", "code": "CODE"}).first()
    assert (g.name, g.code, len(g.rings[0]), g.max_x) == ("n", "1", 4, 1.0)
    (tmp_path / "NEGERI_SEMBILAN.json").write_text('{"city": ["Seremban", " ", "Nilai"]}')
    assert {tuple(r) for r in readers.locality_folder(spark, f"{tmp_path}/NEGERI*.json").collect()} == {("NEGERI SEMBILAN", "Seremban"), ("NEGERI SEMBILAN", "Nilai")}
    assert [readers.source_type(n) for n in ("a.JSONL", "b.xlsx", "c.csv", "d")] == ["json", "excel", "csv", "csv"]
    r = readers.records(spark, csv_text="id,Address\n1,here\n2, \n").collect()
    assert [(x.record_id, x.address, x.input_metadata) for x in r] == [("addr-1", "here", {"id": "1"})]
    with pytest.raises(ValueError, match="allowed"):
        readers.records(spark, addresses=["a", "b"], max_records=1)


def test_sinks(spark, tmp_path):
    docs = reads.search_documents(spark.createDataFrame([(1, " ", "b")], "id int, a string, b string"), "id", ["a"], ["a", "b"])
    assert writers.search_bulk(docs, lambda rows: 0, 10).first().sent == 1
    writers.search_lines(docs, f"file://{tmp_path}/bulk", "idx")
    assert spark.read.text(f"file://{tmp_path}/bulk").count() == 2
    writers.audit(f"{tmp_path}/audit.jsonl", "start", token="x", n=1)
    line = json.loads((tmp_path / "audit.jsonl").read_text())
    assert line["token"] == "***REDACTED***" and line["n"] == 1
    writers.audit("/no/such/folder/x", "start")
    assert writers.bootstrap(spark, {"t": spark.range(2)}, f"file://{tmp_path}/boot", "v") == ["t"]
    assert writers.bootstrap(spark, {"t": spark.range(2)}, f"file://{tmp_path}/boot", "v") == []


def test_config(tmp_path):
    got = config.flattened({"config_version": "1.2", "schema": {"a": 1, "_note": 2}, "rules": {"b": True}, "c": 3})
    assert got == {"a": 1, "b": True, "c": 3}
    with pytest.raises(ValueError):
        config.flattened({"config_version": "2.0"})


def test_search(spark):
    df = spark.createDataFrame([(1, "Red widget", 5.0), (2, "red window", None), (3, "redwood wi", 9.0)], "id int, t string, s double")
    assert [r.id for r in reads.search(df, "red wi", "t", "s", "id").collect()] == [1, 2]
    assert reads.search(df, " ", "t", "s", "id").count() == 0


def test_stale_jobs_go_back_to_the_queue():
    class State:
        exists, hasTimedOut, get = True, True, ("running", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), 1)

        def getCurrentProcessingTimeMs(self):
            return 1_704_070_000_000

        def update(self, v):
            self.new = v

    s = State()
    out = list(jobs._moves(300)(("j",), iter(()), s))[0].iloc[0]
    assert (out.from_status, out.to_status, out.recoveries, s.new[0], s.new[3]) == ("running", "queued", 2, "queued", 2)


def test_every_event_is_a_job(spark, sf_dir):
    ids = [r.event_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect()]
    assert max(ids) >= 200
    got = sorted(map(tuple, queries.g4_g8_job_states(spark, sf_dir).collect()))
    assert got == sorted((str(k), 4, "failed" if k % 2 else "completed", 1 + k % 2) for k in ids)


def test_a_postcode_of_several_places_goes_by_the_address(spark):
    codes = spark.createDataFrame([("50450", "kuala lumpur", "kl", 0), ("50450", "ampang", "selangor", 1), ("50450", "ampang", "selangor", 2), ("05000", "alor setar", "kedah", 3), ("05000", None, None, 4)], "postcode string, city string, state string, _ord long")
    rows = [(1, "50450", "Ampang", None, " "), (2, "50450", None, "SELANGOR", " "), (3, "50450", None, None, " 1 JALAN X 50450 AMPANG "), (4, "50450", None, None, " AMPANGAN "), (5, "50450", "Kuala", "Lumpur", " "), (6, "05000", None, None, None), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, postcode_code string, locality_name string, state_name string, address_norm string")
    got = {r.id: (r.postcode_city, r.postcode_state_name) for r in lookup.with_postcode(df, codes).collect()}
    kl, ampang = ("KUALA LUMPUR", "KL"), ("AMPANG", "SELANGOR")
    assert got == {1: ampang, 2: ampang, 3: ampang, 4: kl, 5: kl, 6: ("ALOR SETAR", "KEDAH"), 7: (None, None)}
