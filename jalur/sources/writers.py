"""Sinks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import redact
from ..operators.columns import without
from ..operators.dedupe import first_rows, united
from .tables import exists


def parquet(df: DataFrame, path: str) -> None:
    """K1: overwrites; columns of no type become texts."""
    df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}).write.mode("overwrite").parquet(path)


def by_status(df: DataFrame, path: str) -> None:
    """K2, K3: one folder for each status, in one pass over df."""
    df.write.mode("overwrite").partitionBy("validation_status").parquet(path)


def status_rows(frames: list[DataFrame], path: str) -> DataFrame:
    """K5: of the rows of a record and stage the last (by _seq) stays; written and returned."""
    rows = first_rows(united(*frames), ["record_id", "stage"], [F.col("_seq").desc()])
    parquet(rows, path)
    return df_at(rows, path)


def df_at(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """K6: arrays, maps and structs as JSON texts."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))})


def jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **properties) -> None:
    """K6."""
    flat(df).write.option("batchsize", batch).jdbc(url, table, mode, properties)


def search_bulk(documents: DataFrame, send: Callable[[list[tuple[str, str]]], int], batch: int = 1000) -> DataFrame:
    """K8: documents (id, document) to a search index in batches; rows of (sent, failed), one a batch. send returns how many failed."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = list(zip(frame["id"], frame["document"], strict=True))
            for lo in range(0, len(rows), batch):
                some = rows[lo : lo + batch]
                failed = send(some)
                yield pd.DataFrame({"sent": [len(some) - failed], "failed": [failed]})

    return documents.select("id", "document").mapInPandas(run, "sent long, failed long")


def search_lines(documents: DataFrame, path: str, index: str) -> None:
    """K8: bulk requests as files of lines."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col("id").alias("_id")).alias("index")))
    documents.select(F.concat(action, F.lit("\n"), "document").alias("value")).write.mode("overwrite").text(path)


def export(df: DataFrame, path: str) -> None:
    """CSV without inner columns."""
    flat(without(df)).write.mode("overwrite").csv(path, header=True)


def audit(path: str, event: str, **fields) -> None:
    """A line of JSON on the driver; secrets are hidden, and a failure to write is none of the run."""
    line = json.dumps({"event": event, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **redact(fields)}, default=str)
    try:
        with open(path, "a") as out:
            out.write(line + "\n")
    except OSError:
        pass


def corrections(df: DataFrame, path: str) -> None:
    """Appends CSV; every file has its header."""
    flat(df).write.mode("append").csv(path, header=True)


def once(df: DataFrame, path: str, keys: list[str], order: str) -> None:
    """The first row of each key, as CSV."""
    flat(first_rows(df, keys, [F.col(order)]).drop(order)).write.mode("overwrite").csv(path, header=True)


# Lookup files and the tables they are loaded into.
LOOKUPS = {
    "state.csv": "state",
    "district.csv": "district",
    "mukim.csv": "mukim",
    "postcode.csv": "postcode",
    "district_aliases.csv": "district_aliases",
    "locality.csv": "locality_lookup",
    "sublocality.csv": "sublocality_lookup",
    "street_type.csv": "street_type",
    "street_type_alias.csv": "street_type_alias",
    "street_name.csv": "street_name",
}


def lookup_files(spark, folder: str) -> dict[str, DataFrame]:
    """K7: the lookup tables of a folder's CSV files, as texts; files that aren't there are left out."""
    return {table: spark.read.csv(f"{folder}/{name}", header=True) for name, table in LOOKUPS.items() if exists(spark, f"{folder}/{name}")}


def bootstrap(spark, tables: dict[str, DataFrame], path: str, version: str) -> list[str]:
    """Tables that aren't there yet are written under path; their names are returned and put into the manifest."""
    made = []
    for name, df in tables.items():
        if not exists(spark, f"{path}/{name}/_SUCCESS"):
            parquet(df, f"{path}/{name}")
            made.append(name)
    if made:
        spark.createDataFrame([(n, version) for n in made], "table_name string, version string").write.mode("append").parquet(f"{path}/_manifest")
    return made
