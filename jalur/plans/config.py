"""Configuration: versioned JSON of sections, flattened."""

from __future__ import annotations

import json
import os

SECTIONS = ("schema", "sources", "rules")


def flattened(raw: dict) -> dict:
    """The sections' keys in one dict; keys that begin with an underscore are comments. The major version must be 1."""
    version = str(raw.get("config_version", "1"))
    if version.split(".")[0] != "1":
        raise ValueError(f"config_version {version} isn't supported")
    plain = lambda d: {k: plain(v) if isinstance(v, dict) else v for k, v in d.items() if not k.startswith("_")}
    out: dict = {}
    for section in SECTIONS:
        if section in raw:
            out |= plain(raw[section])
    return out | {k: v for k, v in plain(raw).items() if k not in SECTIONS and k != "config_version"}


def load(path: str) -> dict:
    with open(path) as f:
        return flattened(json.load(f))


def job_id(path: str, variable: str = "JOB_ID") -> str:
    """From the environment, else the name of the input."""
    return os.environ.get(variable) or os.path.splitext(os.path.basename(path.rstrip("/*")))[0] or "job"
