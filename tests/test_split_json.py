"""Features cut by byte ranges are those of the whole document."""

import json
import random

import pytest
from pyspark.sql import functions as F

from jalur.sources import readers
from jalur.sources.split_json import objects


@pytest.fixture(params=[300])
def ranges(spark, request):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]
    for n, v in zip(names, (request.param, request.param, 1), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def feature(rng, k):
    text = "".join(rng.choice(["a", "{", "}", '"', "\\", "é", "\n", '\\"', "}{", '"type":"Feature"', "x" * 80]) for _ in range(rng.randrange(8)))
    ring = [[x + 0.5, y, 7] for x, y in ((k, 0), (k + 1, 0), (k + 1, 1), (k, 0))]
    shape = {"type": "Polygon", "coordinates": [ring * (1 + k % 3)]} if k % 2 else {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}
    return {"type": "Feature", "properties": {"NAME": text, "CODE": k, "deep": {"a": {"b": text}}}, "geometry": shape}


def collection(seed, n):
    rng = random.Random(seed)
    return {"type": "FeatureCollection", "name": 'a "name" {', "crs": {"type": "name", "properties": {"name": "}"}}, "features": [feature(rng, k) for k in range(n)]}


def test_features(spark, tmp_path, ranges):
    whole = [collection(1, 12), collection(2, 0), collection(3, 9)]
    for k, (c, indent) in enumerate(zip(whole, (None, 2, 1), strict=True)):
        (tmp_path / f"{k}.geojson").write_text(json.dumps(c, indent=indent, ensure_ascii=k == 2) + "\n" * k)
    rows = objects(spark, [f"{tmp_path}/{k}.geojson" for k in range(3)]).orderBy("file", "block", "n").collect()
    got = [json.loads(r.text) for r in rows]
    want = [x for c in whole for x in [c["crs"], *c["features"]]]
    assert got == want
    read = readers.geojson(spark, f"{tmp_path}/*.geojson", {"name": "NAME", "code": "CODE"}).collect()
    assert sorted((r.name, r.code) for r in read) == sorted((f["properties"]["NAME"], str(f["properties"]["CODE"])) for c in whole for f in c["features"])
    assert all(r.max_x - r.min_x == 1 and r.rings[0][0].x == int(r.code) + 0.5 for r in read)


def test_list_of_objects(spark, tmp_path, ranges):
    values = [{"a": k, "b": {"c": ["}", {"d": "{"}]}} for k in range(30)]
    (tmp_path / "x.json").write_text(json.dumps(values))
    (tmp_path / "y.json").write_text("\n".join(map(json.dumps, values)))
    for name in ("x", "y"):
        got = [json.loads(r.text) for r in objects(spark, [f"{tmp_path}/{name}.json"], level=0).orderBy("file", "block", "n").collect()]
        assert got == values
    (tmp_path / "empty.json").write_text("")
    assert objects(spark, [f"{tmp_path}/empty.json"]).count() == 0


def test_layers(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    files = {
        "state_boundary": [{"STATE_CODE": " 01 ", "STATE": " johor"}],
        "district_boundary": [{"STATE_CODE": "01", "DISTRICT": "muar ", "DIVISION_C": "0"}, {"STATE_CODE": "01", "DISTRICT": "nowhere"}],
        "mukim_boundary": [{"STATE_CODE": "01", "DIVISION": "Muar", "MUKIM": "Bukit"}, {"STATE_CODE": "02", "DIVISION": "Muar", "MUKIM": "Bukit"}, {"STATE_CODE": "02", "DIVISION": None, "MUKIM": None}],
        "postcode_boundary": [{"POSTCODE": "01000", "TOWN_CITY": "kangar", "STATE": "perlis"}],
        "pbt_boundary": [{"OBJECTID": 5, "NAMA_PBT": "majlis a"}, {"OBJECTID": 6, "pbt_name": "Majlis B"}],
    }
    for name, properties in files.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": square} for p in properties]}))
    lookups = {
        "district": spark.createDataFrame([("01", "Muar", "02")], "state_code string, district_name string, district_code string"),
        "mukim": spark.createDataFrame([("01 ", "bukit", "05", "77")], "state_code string, mukim_name string, mukim_code string, mukim_id string"),
    }
    got = readers.boundary_layers(spark, str(tmp_path), lookups)
    assert sorted(got) == ["district_boundary", "mukim_boundary", "pbt", "postcode_boundary", "state_boundary"]
    assert got["state_boundary"].select("state_code", "state_name").first() == ("01", "JOHOR")
    assert sorted((r.district_name, r.district_code) for r in got["district_boundary"].collect()) == [("MUAR", "02"), ("NOWHERE", None)]
    assert sorted((r.state_code, r.mukim_code, r.mukim_id) for r in got["mukim_boundary"].collect()) == [("01", "05", "77"), ("02", None, None), ("02", None, None)]
    assert sorted((r.pbt_id, r.pbt_name) for r in got["pbt"].select("pbt_id", "pbt_name").collect()) == [("PBT-5", "MAJLIS A"), ("PBT-6", "MAJLIS B")]
    assert {r.layer: (r.polygons, r.unmatched) for r in readers.unmatched(got).collect()} == {"state_boundary": (1, 0), "postcode_boundary": (1, 0), "district_boundary": (2, 1), "mukim_boundary": (3, 2), "pbt": (2, 0)}
    assert got["pbt"].agg(F.max("max_x")).first()[0] == 1
