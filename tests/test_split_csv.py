"""CSV in byte ranges gives what a file a task gives."""

import random

import pytest
from pyspark.sql import functions as F

from jalur.sources import split_csv
from jalur.sources.readers import csv_files


@pytest.fixture(params=[150])
def ranges(spark, request):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]
    for n, v in zip(names, (request.param, request.param, 1), strict=True):
        spark.conf.set(n, v)
    yield request.param
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def value(rng):
    kind = rng.randrange(9)
    if kind < 3:
        return rng.choice(["a", "JALAN 1", "01", "é", "x y", "5'"])
    return '"' + "".join(rng.choice(["a", ",", "\n", '""', "é", " ", "\r\n", "00", "line\nline\n\nline", "x" * 90]) for _ in range(rng.randrange(kind))) + '"'


def file_text(seed, names, rows, end="\n"):
    rng = random.Random(seed)
    lines = [",".join(names)] + [",".join(value(rng) for _ in names) for _ in range(rows)]
    return end.join(lines) + (end if seed % 2 else "")


def whole(spark, *paths):
    return [spark.read.csv(p, header=True, multiLine=True, escape='"') for p in paths]


def plain(row):
    """Spark makes line breaks in quotes those of the file's first line; in ranges they stay as they are."""
    return tuple(v and v.replace("\r\n", "\n") for v in row)


def as_rows(df):
    return sorted(str(plain(r)) for r in df.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_rows(spark, tmp_path, ranges, end):
    for seed in (1, 2):
        path = tmp_path / f"{seed}.csv"
        path.write_text(file_text(seed, ["a", "b", "c"], 12, end), newline="")
        got = split_csv.read(spark, [str(path)], position="_pos")
        assert as_rows(got.drop("_pos")) == as_rows(whole(spark, str(path))[0])
        assert [plain(r) for r in got.orderBy("_pos").drop("_pos").collect()] == [plain(r) for r in whole(spark, str(path))[0].collect()]


def test_files_of_several_kinds(spark, tmp_path, ranges):
    for k, names in enumerate([["a", "b"], ["b", "c", "a"], ["d"], ["a", "b"]]):
        (tmp_path / f"{k}.csv").write_text(file_text(k + 10, names, 15), newline="")
    paths = sorted(map(str, tmp_path.glob("*.csv")))
    want = whole(spark, *paths)
    out = want[0]
    for x in want[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    got = csv_files(spark, f"{tmp_path}/*.csv")
    assert as_rows(got.select(*sorted(out.columns))) == as_rows(out.select(*sorted(out.columns)))


def test_one_value_over_many_ranges(spark, tmp_path, ranges):
    long = "\n".join(f"line {k}, with a comma" for k in range(60))
    (tmp_path / "x.csv").write_text(f'a,b\n1,"{long}"\n2,plain\n3,"{long}', newline="")  # the last quote stays open
    got = {r.a: r.b for r in split_csv.read(spark, [f"{tmp_path}/x.csv"]).collect()}
    assert got["1"] == long and got["2"] == "plain" and got["3"].lstrip('"') == long


def test_edges(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿a,,a,B\n1,2,3,4\n\n5\n6,7,8,9,10\n".encode())
    got = split_csv.read(spark, [f"{tmp_path}/bom.csv"])
    assert got.columns == ["a0", "_c1", "a2", "B"] and sorted(tuple(r) for r in got.collect()) == [("1", "2", "3", "4"), ("5", None, None, None), ("6", "7", "8", "9")]
    (tmp_path / "latin.csv").write_bytes('a;b\n"é;\n";"1"\n'.encode("latin-1"))
    assert [tuple(r) for r in split_csv.read(spark, [f"{tmp_path}/latin.csv"], ";", "iso-8859-1").collect()] == [("é;\n", "1")]
    assert [tuple(r) for r in split_csv.read(spark, [f"{tmp_path}/latin.csv"], ";", "iso-8859-1", header=False).collect()] == [("a", "b"), ("é;\n", "1")]
    (tmp_path / "empty.csv").write_text("")
    assert split_csv.read(spark, [f"{tmp_path}/empty.csv"]).count() == 0
    (tmp_path / "top.csv").write_text("a,b")
    assert split_csv.read(spark, [f"{tmp_path}/top.csv"]).collect() == [] and split_csv.read(spark, [f"{tmp_path}/top.csv"]).columns == ["a", "b"]
    (tmp_path / "mid.csv").write_text('a,b\n5" pipe,x\n"6"" pipe",y\n')
    assert sorted(r.a for r in split_csv.read(spark, [f"{tmp_path}/mid.csv"]).collect()) == ['5" pipe', '6" pipe']


def test_inferred(spark, tmp_path):
    (tmp_path / "x.csv").write_text("i,l,d,b,t,s,n\n1,3000000000,1.5,true,2024-01-02 03:04:05,x,\n-2,4,2,false,2024-01-02,1,\n")
    df = csv_files(spark, f"{tmp_path}/x.csv", infer=True)
    assert [k for _, k in df.dtypes] == ["int", "bigint", "double", "boolean", "timestamp", "string", "string"]


def test_many_ranges_inside_quotes(spark, tmp_path, ranges, monkeypatch):
    """Beyond the bound the lines are shuffled by range, with the same rows."""
    (tmp_path / "x.csv").write_text(file_text(5, ["a", "b"], 30), newline="")
    want = as_rows(split_csv.read(spark, [f"{tmp_path}/x.csv"]))
    monkeypatch.setattr(split_csv, "BROADCAST_RANGES", 0)
    assert as_rows(split_csv.read(spark, [f"{tmp_path}/x.csv"])) == want


def test_one_plan(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"{k}.csv").write_text("a,b\n1,2\n")
    plan = csv_files(spark, f"{tmp_path}/*.csv")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    assert csv_files(spark, f"{tmp_path}/*.csv").agg(F.sum("b")).first()[0] == 60
