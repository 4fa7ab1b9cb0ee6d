"""Seed symbols: literals ``LANG:PATH:KIND:NAME:LINE`` and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KINDS, parse_id, symbol_id

SCHEMA = "seed string"


def literals(rows: DataFrame, column: str = "seed") -> DataFrame:
    """Seeds of a column of literals: ``node`` (id) and parts; a bad one fails the query."""
    p = parse_id(F.col(column))
    checked = F.when(p.isNull(), F.raise_error(F.concat(F.lit("bad seed: "), F.coalesce(F.col(column), F.lit("null"))))).otherwise(p)
    out = rows.withColumn("_p", checked)
    part = F.col("_p")
    return out.select(*rows.columns, symbol_id(part["language"], part["file"], part["kind"], part["name"], part["line"]).alias("node"), part["language"].alias("language"), part["file"].alias("file"), part["kind"].alias("kind"), part["name"].alias("name"), part["line"].alias("start_line"), part["line"].alias("end_line"))


def _one(x: object) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, dict):
        if "id" in x:
            return str(x["id"])
        lang, path = x.get("lang", x.get("language")), x.get("path", x.get("file"))
        line = x.get("line", x.get("start_line"))
        kind = x.get("kind")
        if None not in (lang, path, line, kind) and "name" in x:
            return f"{lang}:{path}:{KINDS.get(kind, kind)}:{x['name']}:{line}"
    raise ValueError(f"bad seed: {x!r}")


def from_json(spark: SparkSession, text: str) -> DataFrame:
    """Seeds of a JSON array of strings, ``{id}`` objects or objects of parts."""
    found = json.loads(text)
    if not isinstance(found, list):
        raise ValueError("seeds are a JSON array")
    return literals(spark.createDataFrame([(_one(x),) for x in found], SCHEMA))
