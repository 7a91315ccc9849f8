"""Records: JSON, fingerprints, redaction, log lines and documents."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys whose values are hidden, and what is written in their place.
SECRETS, HIDDEN = r"(?i)(password|secret|token|api_key)", "***REDACTED***"


def json_text(c: Column | str, schema: str | None = None) -> Column:
    """The JSON value within a text, fenced or not; parsed if a schema is given, null if it isn't JSON."""
    t = F.col(c) if isinstance(c, str) else c
    fenced = F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    text = F.btrim(F.coalesce(fenced, bare), F.lit(" \t\r\n"))
    return F.from_json(text, schema) if schema else text


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, ordered by name."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def redacted(values: Column | str) -> Column:
    """A map with secret-like keys' values hidden."""
    return F.transform_values(F.col(values) if isinstance(values, str) else values, lambda k, v: F.when(k.rlike(SECRETS), F.lit(HIDDEN)).otherwise(v))


def redact(value):
    """The same for a Python value, at any depth."""
    import re

    if isinstance(value, dict):
        return {k: HIDDEN if re.search(SECRETS, str(k)) else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, (list, tuple)) else value


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def timestamp(c: Column | str) -> Column:
    """An ISO time, null if it isn't one."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)


def older_than(c: Column | str, seconds: int, now: Column | None = None) -> Column:
    """Before the cutoff."""
    return (F.col(c) if isinstance(c, str) else c) < (F.current_timestamp() if now is None else now) - F.make_dt_interval(secs=F.lit(seconds))


def log_fields(line: Column | str) -> dict[str, Column]:
    """Stage, status and rows of a log line, and the error it ends with."""
    t = F.col(line) if isinstance(line, str) else line
    part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return {"stage": part(r"stage[=: ]+([A-Za-z0-9_]+)"), "status": part(r"status[=: ]+([A-Za-z_]+)"), "rows": part(r"rows[=: ]+([0-9]+)").try_cast("long"), "error": part(r"^((?:[A-Za-z_]+\.)*[A-Za-z]+(?:Error|Exception)\b.*)$")}


def load_counts(line: Column | str) -> dict[str, Column]:
    """Success, warning and failed counts of a log line that ends the load; null on any other."""
    t = F.col(line) if isinstance(line, str) else line
    ends = F.contains(t, F.lit("CHECKPOINT")) & F.contains(t, F.lit("stage=load")) & F.contains(t, F.lit("event=done"))
    return {k: F.when(ends, F.regexp_extract(t, rf"{k}=([0-9]+)", 1).try_cast("long")) for k in ("success_count", "warning_count", "failed_count")}


# Stages of a run by the names that a log gives them, and how far it then is.
STAGES = {"extract": "extract", "transform": "transform", "clean": "transform", "validate": "validate", "validated": "validate", "final": "final"}
PROGRESS = {"extract": 20, "transform": 45, "validate": 70, "final": 88}


def log_progress(line: Column | str) -> tuple[Column, Column]:
    """How far, in percent, and into which stage a log line says the run is; null where it says nothing.

    The progress of a run is the greatest of its lines so far.
    """
    t = F.trim(F.col(line) if isinstance(line, str) else line)
    lower = F.lower(t)
    said = F.lower(F.trim(F.regexp_extract(t, r"^PIPELINE_STAGE:(.*)$", 1)))
    stage = F.lit(None).cast("string")
    for name, known in STAGES.items():
        stage = F.when(said == name, known).otherwise(stage)
    stage = F.when(stage.isNotNull(), stage).when(F.contains(lower, F.lit("traceback (most recent call last)")), "failing").when(F.contains(lower, F.lit("validation_complete")), "validate").when(F.contains(lower, F.lit("write_complete")), "final")
    tasks = r"\(([0-9]+)\s*\+\s*([0-9]+)\)\s*/\s*([0-9]+)\]"
    part = lambda k: F.regexp_extract(t, tasks, k).try_cast("double")
    ratio = F.least(F.lit(1.0), (part(1) + part(2)) / F.greatest(F.lit(1.0), part(3)))
    of_stage = F.lit(None).cast("int")
    for name, known in STAGES.items():
        of_stage = F.when(said == name, PROGRESS[known]).otherwise(of_stage)
    percent = F.when(of_stage.isNotNull(), of_stage).when(stage == "failing", 95).when(stage == "validate", 90).when(stage == "final", 96).when(t.rlike(tasks), F.least(F.lit(94), F.floor(20 + ratio * 70).cast("int")))
    return percent, stage


def document(columns: list[str], lists: list[str] = ()) -> Column:
    """JSON of the columns that aren't null or blank; blank elements of lists are left out."""
    fields = []
    for c in columns:
        if c in lists:
            kept = F.filter(c, lambda x: F.coalesce(F.trim(x.cast("string")), F.lit("")) != "")
            fields.append(F.when(F.size(kept) > 0, kept).alias(c))
        else:
            fields.append(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)).alias(c))
    return F.to_json(F.struct(*fields))


def autocomplete_text(*columns: str) -> Column:
    """Distinct texts of the columns, in order."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns]))), " ")
