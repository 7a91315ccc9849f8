"""Operators that no query covers, on small frames."""

import pytest
from pyspark.sql import functions as F

from jalur.operators import corrections, lookup, model_map, reads, refresh, snapshot
from jalur.sources import writers
from jalur.streaming import jobs


def test_csv_sinks_and_lookup_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2), ("a", 0, 3), (None, 5, 4)], "k string, n int, v int")
    for _ in range(2):
        writers.corrections(df, f"{tmp_path}/fixes")
    assert spark.read.csv(f"{tmp_path}/fixes", header=True).count() == 6
    writers.once(df, f"{tmp_path}/once", ["k"], "n")
    assert sorted((r.k or "", r.v) for r in spark.read.csv(f"{tmp_path}/once", header=True).collect()) == [("", "4"), ("a", "3")]
    (tmp_path / "lookups").mkdir()
    (tmp_path / "lookups" / "state.csv").write_text("state_code,state_name\n01,JOHOR\n")
    tables = writers.lookup_files(spark, f"{tmp_path}/lookups")
    assert list(tables) == ["state"] and tables["state"].first() == ("01", "JOHOR")
    assert writers.bootstrap(spark, tables, f"{tmp_path}/boot", "v1") == ["state"] and writers.bootstrap(spark, tables, f"{tmp_path}/boot", "v1") == []


def test_orders_and_states(spark):
    df = spark.createDataFrame([(2, "B"), (None, "A"), (1, "B")], "id int, state_name string")
    assert [r.id for r in reads.ascending(df, "id").collect()] == [1, 2, None]
    assert model_map.context_states(df).first().states == ["A", "B"]


def test_model_only_where_it_is_needed(spark):
    df = spark.createDataFrame([(1, "x", 10), (2, "y", 90), (3, "z", None), (4, "done", 5)], "id int, text string, confidence_score int")
    done = spark.createDataFrame([("done",)], "text string")
    model = lambda texts: [(t.upper(), 0.5) for t in texts]
    out = model_map.enriched(df, done, model, "text", "id")
    assert sorted((r.id, r.model_text) for r in out.collect()) == [(1, "X"), (3, "Z")]
    assert model_map.enriched(df, done, model, "text", "id", mode="off").count() == 0


def test_matches_over_and_pairs(spark):
    rows = spark.createDataFrame([(1, " AT KLUANG NOW ", "old"), (2, " NOWHERE ", "old")], "id int, address_norm string, code string")
    names = spark.createDataFrame([("Kluang", "07", 1)], "name string, code string, _ord int")
    assert sorted((r.id, r.code) for r in lookup.matched_over(rows, names, "name", ["code"], "id").collect()) == [(1, "07"), (2, "old")]
    a = spark.createDataFrame([(3, "r3"), (1, "r1")], "pos int, result string")
    b = spark.createDataFrame([(10, "x"), (30, "y")], "pos int, record string")
    assert sorted((r.result, r.record) for r in corrections.paired(a, b, order="pos").collect()) == [("r1", "x"), ("r3", "y")]
    m = lookup.mukim_lookup(spark.createDataFrame([("1", "2", "m")], "state_code string, district_code string, mukim_name string"), spark.createDataFrame([("1", "S")], "state_code string, state_name string"), spark.createDataFrame([("1", "2", "D")], "state_code string, district_code string, district_name string"))
    assert m.select("state_name", "district_name").first() == ("S", "D")


def test_corrections_by_id(spark):
    failed = spark.createDataFrame([("a", "addr a", "01", "x"), ("b", "addr b", "02", None)], "record_id string, source_address_old string, state_code string, note string")
    fixes = spark.createDataFrame([("a", "new a", "n1", 2), ("a", "newer a", "n0", 1), ("b", None, None, 1)], "record_id string, corrected_address string, note string, seq int")
    out = corrections.by_id(failed, fixes, order="seq")
    assert sorted(tuple(r) for r in out.select("record_id", "source_address_old", "note").collect()) == [("a", "newer a", "n0"), ("b", "addr b", None)]
    kept = corrections.retried(failed, fixes, lambda df: df, "record_id", "seq")
    assert sorted(kept.columns) == ["address", "note", "record_id"]
    given = spark.createDataFrame([("a", "77")], "record_id string, state_code string")
    rows = {r.record_id: r.state_code for r in corrections.retried(failed, given, lambda df: df, "record_id").collect()}
    assert rows == {"a": "77", "b": None}


def test_guards(spark, tmp_path):
    at = f"file://{tmp_path}/table"
    old, new = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(2,)], "v int")
    old.write.parquet(at)
    for status, apply, outcome, value in (("blocked", True, "blocked", 1), ("pass", False, "dry_run", 1), ("warning", True, "applied", 2)):
        assert snapshot.apply_refresh(status, apply, new, at) == outcome
        spark.catalog.refreshByPath(at)
        assert spark.read.parquet(at).first().v == value
    versions = spark.createDataFrame([(1, "d", "draft"), (2, "d", "active"), (3, "d", "draft")], "version_id int, boundary_type string, status string")
    features = spark.createDataFrame([(1, "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"), (3, "POLYGON((0 0, 2 2, 2 0, 0 2, 0 0))")], "version_id int, boundary_wkt string")
    rows, layer = snapshot.activate(versions, features, 1)
    assert {r.version_id: r.status for r in rows.collect()} == {1: "active", 2: "superseded", 3: "draft"} and layer.count() == 1
    for bad in (2, 3, 9):
        with pytest.raises(ValueError, match="version"):
            snapshot.activate(versions, features, bad)
    table = spark.createDataFrame([("a", 1)], "code string, parent int")
    parents = {"parent": spark.createDataFrame([(1,)], "parent int")}
    with pytest.raises(ValueError, match="rejected"):
        snapshot.changed(table, spark.createDataFrame([("b", 9)], "code string, parent int"), ["code"], ["code"], [], parents)
    places = [f"file://{tmp_path}/one", f"file://{tmp_path}/two"]
    snapshot.changed(table, spark.createDataFrame([("b", 1)], "code string, parent int"), ["code"], ["code"], places, parents)
    assert all(spark.read.parquet(p).count() == 2 for p in places)


def test_keys(spark):
    keys = spark.createDataFrame([(1, "active", None), (2, "revoked", "t1")], "key_id int, status string, last_used_at string")
    used = spark.createDataFrame([(1, "t3"), (1, "t2"), (2, "t9")], "key_id int, at string")
    assert sorted(tuple(r) for r in snapshot.touched(keys, used).select("key_id", "last_used_at").collect()) == [(1, "t3"), (2, "t1")]
    more = snapshot.issued(keys, spark.createDataFrame([(2, "x"), (5, "y")], "key_id int, name string"), F.lit("now"))
    assert sorted((r.key_id, r.status) for r in more.collect()) == [(1, "active"), (2, "revoked"), (5, "active")]
    rows = spark.createDataFrame([(1, 7), (2, None)], "id int, parent_id int")
    assert refresh.unmatched(rows, "parent_id").first() == (2, 1)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda k: f'{{"job_id": "{k}", "status": "completed", "loaded": true}}\n'
    (src / "1.json").write_text(line(1) + line(2))
    (src / "2.json").write_text(line(2) + line(3))
    stream = lambda: jobs.messages(spark, str(src), "job_id string, status string, loaded boolean")
    at, mark, topic = f"{tmp_path}/out", f"{tmp_path}/mark", f"{tmp_path}/topic"
    calls = []

    def fails(df, batch):
        calls.append(batch)
        if batch == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        jobs.run_once(jobs.first_of_key(stream(), "job_id"), at, mark, fails)
    (src / "3.json").write_text(line(3) + line(4))
    jobs.chain(stream(), at, mark, topic)
    assert calls == [0, 1]
    assert sorted(r.job_id for r in spark.read.parquet(at).collect()) == ["1", "2", "3", "4"]
    sent = sorted(r.job_id for r in jobs.decoded(spark.read.text(f"{topic}/*")).collect())
    assert sent == ["3", "4"]  # the first batch was done before there was a topic
