"""What the jobs share: settings files and the session of a command line."""

from __future__ import annotations

import json
import logging
from dataclasses import fields

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def read_config(kind: type, path: str | None):
    """Settings of ``kind`` from a small JSON file; what the file doesn't name keeps its default, and unknown names are an error."""
    if path is None:
        return kind()
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    unknown = set(told) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return kind(**told)


def session(name: str) -> SparkSession:
    """The command line's own session; the command line stops it."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
