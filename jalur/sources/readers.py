"""Sources: files, HTTP, tables, free text and boundaries, all as DataFrames of texts."""

from __future__ import annotations

import csv
import io
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import clean
from . import split_csv, split_json
from .tables import exists, filesystem


def expanded(spark: SparkSession, path: str) -> list[str]:
    """The files of a path with wildcards, sorted; an error if there are none."""
    fs, p = filesystem(spark, path)
    found = fs.globStatus(p)
    names = sorted(str(x.getPath()) for x in found) if found else []
    if not names:
        raise FileNotFoundError(f"no files match {path}")
    return names


def csv_files(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", header: bool = True, infer: bool = False) -> DataFrame:
    """CSV files, by column name; texts unless infer, so that codes keep their zeros.

    Files are read in byte ranges, also where quoted values hold line breaks;
    encodings in which a byte may be part of a letter beside a file a task.
    """
    paths = expanded(spark, path)
    if encoding.lower() in split_csv.ENCODINGS:
        df = split_csv.read(spark, paths, sep, encoding, header)
    else:
        one = lambda p: spark.read.csv(p, header=header, sep=sep, encoding=encoding, multiLine=True, escape='"')
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(p) for p in paths])
    return split_csv.inferred(df) if infer else df


def json_files(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """S3: JSON documents or lines; unless told, lines, and documents if a line isn't JSON."""
    paths = expanded(spark, path)
    if multiline is not True:
        df = spark.read.json(paths)
        if multiline is False or "_corrupt_record" not in df.columns:
            return df
    return spark.read.json(paths, multiLine=True)


def excel_file(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet, read on the driver as texts; needs a reader for Excel files to be installed."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
    except ImportError as e:
        raise RuntimeError("reading Excel files needs openpyxl") from e
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"`{c}` string" for c in frame.columns))


def http_json(spark: SparkSession, url: str, timeout: float = 60.0) -> DataFrame:
    """Rows of {"data": [...]}, of a list, or one object; values that aren't texts as JSON."""
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as reply:  # noqa: S310
        return json_rows(spark, json.load(reply))


def json_rows(spark: SparkSession, value) -> DataFrame:
    rows = value["data"] if isinstance(value, dict) and isinstance(value.get("data"), list) else value if isinstance(value, list) else [value]
    names = list(dict.fromkeys(k for r in rows for k in r))
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return spark.createDataFrame([tuple(text(r.get(n)) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def parquet_files(spark: SparkSession, *paths: str) -> DataFrame:
    """S8."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **properties) -> DataFrame:
    """A table or query over JDBC, in parts by a number column."""
    if column and bounds:
        return spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def boundary_table(df: DataFrame, wkt: str = "boundary_wkt", names: list[str] = ()) -> DataFrame:
    """Features with a geometry, as rings and box; coordinates are longitude and latitude."""
    from ..operators.spatial import boundaries

    return boundaries(df.where(F.col(wkt).isNotNull()).select(*names, F.col(wkt).alias("geom_wkt")), "geom_wkt")


def geojson(spark: SparkSession, path: str, names: dict[str, str | list[str]]) -> DataFrame:
    """Features of GeoJSON files, cut out by byte ranges: properties by their new name, and rings; third ordinates are dropped.

    names: for each new name its property, or several of which the first that is there counts.
    """
    shape = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    rows = split_json.objects(spark, expanded(spark, path)).select(F.from_json("text", shape).alias("f")).where("f.type = 'Feature'")
    multi = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    single = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", geo.rings_from_geojson(multi, True)).otherwise(geo.rings_from_geojson(single, False))
    first = lambda old: F.coalesce(*[F.col("f.properties")[o] for o in ([old] if isinstance(old, str) else old)])
    rows = rows.select(*[first(old).alias(new) for new, old in names.items()], rings.alias("rings"))
    return rows.where("rings is not null").withColumns(geo.bounds(F.col("rings")))


# Boundary files, and the columns that their properties become.
LAYERS = {
    "state_boundary": {"state_code": "STATE_CODE", "state_name": "STATE"},
    "district_boundary": {"state_code": "STATE_CODE", "district_name": "DISTRICT"},
    "mukim_boundary": {"state_code": "STATE_CODE", "district_name": "DIVISION", "mukim_name": "MUKIM"},
    "postcode_boundary": {"postcode": "POSTCODE", "city": "TOWN_CITY", "state": "STATE"},
    "pbt_boundary": {"object_id": "OBJECTID", "pbt_id": "pbt_id", "pbt_name": ["NAMA_PBT", "pbt_name"]},
}
_UPPER = {"state_name", "district_name", "mukim_name", "city", "state", "pbt_id", "pbt_name"}


def boundary_layers(spark: SparkSession, folder: str, lookups: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The boundary layers of a folder's GeoJSON files, of those that are there.

    Districts get their code from the lookup by state and name, mukims code and
    id; a feature that the lookup doesn't know keeps nulls, one that it knows
    twice comes twice, as in the original's merge.  Areas of a local authority
    without any id get one from their object number.  lookups: district and mukim.
    """
    out = {}
    for name, columns in LAYERS.items():
        if not exists(spark, f"{folder}/{name}.geojson"):
            continue
        rows = geojson(spark, f"{folder}/{name}.geojson", columns)
        out[name] = rows.withColumns({c: F.upper(F.trim(c)) if c in _UPPER else F.trim(c) for c in columns})
    text = lambda df, *upper: df.select(*[(F.upper(F.trim(c)) if c in upper else F.trim(c)).alias(c) for c in df.columns])
    if "district_boundary" in out:
        known = text(lookups["district"].select("state_code", "district_name", "district_code"), "district_name")
        out["district_boundary"] = out["district_boundary"].join(known, ["state_code", "district_name"], "left")
    if "mukim_boundary" in out:
        known = text(lookups["mukim"].select("state_code", "mukim_name", "mukim_code", "mukim_id"), "mukim_name")
        out["mukim_boundary"] = out["mukim_boundary"].join(known, ["state_code", "mukim_name"], "left")
    if "pbt_boundary" in out:
        rows = out.pop("pbt_boundary")
        if rows.where("pbt_id is not null").isEmpty():
            rows = rows.withColumn("pbt_id", F.concat(F.lit("PBT-"), "object_id"))
        out["pbt"] = rows.drop("object_id")
    return out


def unmatched(layers: dict[str, DataFrame]) -> DataFrame:
    """layer, polygons and unmatched (those that no lookup gave a code) of each layer."""
    code = {"district_boundary": "district_code", "mukim_boundary": "mukim_code"}
    counts = [df.agg(F.lit(name).alias("layer"), F.count("*").alias("polygons"), (F.count_if(F.col(code[name]).isNull()) if name in code else F.lit(0).cast("long")).alias("unmatched")) for name, df in layers.items()]
    return reduce(lambda a, b: a.unionAll(b), counts)


def records(spark: SparkSession, address: str | None = None, addresses: list[str] | None = None, text: str | None = None, csv_text: str | None = None, address_column: str | None = None, max_records: int = 1000) -> DataFrame:
    """record_id addr-N, address and input_metadata from one address, a list, lines, or CSV text; blanks are dropped.

    More than max_records is an error.
    """
    rows: list[tuple[str, dict]] = []
    if csv_text is not None:
        rows = csv_records(csv_text, address_column)
    else:
        given = addresses if addresses is not None else text.splitlines() if text is not None else [address]
        rows = [(x, {}) for x in given]
    rows = [(x.strip(), m) for x, m in rows if x and x.strip()]
    if len(rows) > max_records:
        raise ValueError(f"{len(rows)} records, {max_records} are allowed")
    return spark.createDataFrame([(f"addr-{k}", a, m) for k, (a, m) in enumerate(rows, 1)], "record_id string, address string, input_metadata map<string,string>")


def csv_records(text: str, column: str | None = None, preferred: tuple[str, ...] = ("address", "full_address", "alamat", "raw_address")) -> list[tuple[str, dict]]:
    """The address column (the named one, a usual one, or the only one) and the rest as metadata."""
    reader = csv.DictReader(io.StringIO(text))
    names = reader.fieldnames or []
    lower = {n.lower(): n for n in names}
    chosen = next((lower[c.lower()] for c in ([column] if column else []) + list(preferred) if c and c.lower() in lower), names[0] if len(names) == 1 else None)
    if chosen is None:
        raise ValueError(f"no address column among {names}")
    return [(r.get(chosen) or "", {k: v or "" for k, v in r.items() if k and k != chosen}) for r in reader]


def locality_folder(spark: SparkSession, path: str) -> DataFrame:
    """state_name (the file's name) and locality_name (the texts of the first list in the file's object)."""
    files = spark.read.text(expanded(spark, path), wholetext=True).withColumn("state_name", F.upper(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1), "[_-]+", " ")))
    first = F.element_at(F.map_values(F.from_json("value", "map<string,string>")), 1)
    names = F.from_json(first, "array<string>")
    return files.select("state_name", F.explode(names).alias("locality_name")).where(clean("locality_name").isNotNull())


def uploaded_features(df: DataFrame, payload: str, required: list[str]) -> DataFrame:
    """row_num, feature_payload, boundary_wkt and problem (null if none) of each feature of a JSON array or GeoJSON upload."""
    body = F.coalesce(F.get_json_object(payload, "$.features"), F.col(payload))
    rows = df.select(F.posexplode(F.from_json(body, "array<string>")).alias("row_num", "feature"))
    props = F.coalesce(F.get_json_object("feature", "$.properties"), F.col("feature"))
    rows = rows.select("row_num", props.alias("feature_payload"), F.coalesce(F.get_json_object("feature", "$.boundary_wkt"), F.get_json_object(props, "$.boundary_wkt")).alias("boundary_wkt"))
    lacks = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.get_json_object("feature_payload", f"$.{k}"), F.lit(""))) == "", F.lit(k)) for k in required]))
    return rows.withColumn("problem", F.when(F.size(lacks) > 0, F.concat(F.lit("missing: "), F.array_join(lacks, ", "))))


def source_type(name: str) -> str:
    """By the suffix."""
    end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return "json" if end in ("json", "jsonl", "ndjson") else "excel" if end in ("xlsx", "xls") else "csv"


SOURCES = {"csv": csv_files, "json": json_files, "excel": excel_file, "api": http_json, "parquet": parquet_files}


def read(spark: SparkSession, kind: str | None, path: str, **options) -> DataFrame:
    """By kind, or by the path's suffix."""
    kind = kind or source_type(path)
    if kind not in SOURCES:
        raise ValueError(f"unknown source type {kind}")
    return SOURCES[kind](spark, path, **options)
