"""Rows through a model, in batches; the model is any function from texts to (text, score) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.score import unit_score
from .dedupe import missing
from .validate import low_confidence

BATCH = 25


def mapped(df: DataFrame, model: Callable[[list[str]], list[tuple[str | None, float | None]]], text: str, batch: int = BATCH) -> DataFrame:
    """L1: df with model_text and model_score (0 to 1); the input and 0 where the model gives nothing or fails."""
    rest = [f for f in df.schema.fields if f.name not in ("model_text", "model_score")]
    schema = T.StructType([*rest, T.StructField("model_text", T.StringType()), T.StructField("model_score", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [None if pd.isna(x) else str(x) for x in frame[text]]
            out: list[tuple[str | None, float]] = []
            for lo in range(0, len(texts), batch):
                some = texts[lo : lo + batch]
                try:
                    found = list(model([x or "" for x in some]))
                except Exception:  # a model that fails leaves the rows as they were
                    found = []
                found += [(None, None)] * (len(some) - len(found))
                out += [(t or x, 0.0 if t is None or s is None else float(s)) for x, (t, s) in zip(some, found, strict=False)]
            yield frame[[f.name for f in rest]].assign(model_text=[t for t, _ in out], model_score=[s for _, s in out])

    return df.mapInPandas(run, schema).withColumn("model_score", unit_score("model_score"))


def enriched(df: DataFrame, done: DataFrame, model: Callable, text: str, order: str, limit: int | None = None, mode: str = "required") -> DataFrame:
    """L2, L3, F8, U4: rows of low confidence whose text isn't done yet, through the model; mode "off" takes none."""
    rows = low_confidence(missing(df, done, [text]), order, 0 if mode == "off" else limit)
    return mapped(rows, model, text)


def context_states(df: DataFrame) -> DataFrame:
    """The distinct state names, sorted, as one array."""
    return df.agg(F.array_sort(F.collect_set("state_name")).alias("states"))
