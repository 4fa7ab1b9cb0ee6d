"""Summaries of impacted symbols: depth buckets, modules, risk, files, and store counts.

Every function takes ``by``, the columns that tell queries apart, so any number
of seeds or diffs is summarised in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import module_label
from ..model import certainty_rank


def by_depth(impacted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Symbols and distinct files at each depth from 1."""
    keys = by or []
    return impacted.where("depth >= 1").groupBy(*keys, "depth").agg(F.count("*").alias("symbol_count"), F.count_distinct("file").alias("file_count"))


def affected_modules(impacted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Symbols and distinct files of each module."""
    keys = by or []
    return impacted.groupBy(*keys, module_label(F.col("file")).alias("module")).agg(F.count("*").alias("symbol_count"), F.count_distinct("file").alias("file_count"))


def module_order() -> list:
    """Most symbols first, ``(root)`` last among equals, then by name."""
    return [F.desc("symbol_count"), F.col("module") == "(root)", F.col("module")]


def risk(impacted: DataFrame, by: list[str] | None = None, queries: DataFrame | None = None) -> DataFrame:
    """The risk level with its four counts. ``queries``: keys of queries that may have no impacted symbol."""
    keys = by or []
    counts = impacted.groupBy(*keys).agg(
        F.coalesce(F.sum((F.col("depth") == 1).cast("long")), F.lit(0)).alias("direct_hits"),
        F.coalesce(F.sum((F.col("depth") >= 2).cast("long")), F.lit(0)).alias("transitive_hits"),
        F.count_distinct("file").alias("impacted_files"),
        F.count("id").alias("impacted_symbols"),
    )
    if queries is not None and keys:
        counts = queries.select(*keys).distinct().join(counts, keys, "left").na.fill(0)
    d, t, f, s = (F.col(c) for c in ("direct_hits", "transitive_hits", "impacted_files", "impacted_symbols"))
    high = (d >= 3) | ((d >= 2) & (t >= 2)) | ((d >= 1) & (t >= 3)) | (f >= 4) | (s >= 8)
    medium = (d >= 1) | (t >= 3) | (f >= 2) | (s >= 4)
    level = F.when(high, "high").when(medium, "medium").otherwise("low")
    return counts.select(*keys, level.alias("level"), d, t, f, s)


def impacted_files(impacted: DataFrame, by: list[str] | None = None) -> DataFrame:
    return impacted.select(*(by or []), "file").distinct()


def impacted_by_file(impacted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Symbols of each file, sorted by id."""
    keys = by or []
    return impacted.groupBy(*keys, "file").agg(F.array_sort(F.collect_set("id")).alias("symbols"))


def store_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: present files, symbols and edges."""
    parts = [files.where("present").agg(F.count("*").alias("files")), symbols.agg(F.count("*").alias("symbols")), edges.agg(F.count("*").alias("edges"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def strongest_certainty(edges: DataFrame) -> DataFrame:
    """The strongest certainty at each call site."""
    return edges.groupBy("file", "line").agg(F.max_by("certainty", certainty_rank(F.col("certainty"))).alias("certainty"))


def languages(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("language").agg(F.count("*").alias("symbol_count"))


def confidence_distribution(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges of each certainty, a column each."""
    names = ("confirmed", "inferred", "dynamic_fallback")
    return edges.groupBy(*by).agg(*(F.sum((F.col("certainty") == n).cast("long")).alias(n) for n in names))


def degrees(edges: DataFrame) -> DataFrame:
    """Incident edges of each node; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def merge_slices(reasons: DataFrame) -> DataFrame:
    """Scopes of a path joined by or, its reasons united."""
    return reasons.groupBy("path").agg(
        F.bool_or("cache_update").alias("cache_update"),
        F.bool_or("local_dfg").alias("local_dfg"),
        F.bool_or("explanation").alias("explanation"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
    )


def side_last_call(edges: DataFrame, side: list[str]) -> DataFrame:
    """Edges with the last call line of their boundary side."""
    return edges.withColumn("last_line", F.max("line").over(Window.partitionBy(*side)))


def fn_fp(expected: DataFrame, found: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Missing (fn) and extra (fp) rows by group."""
    lost = expected.select(by, *keys).distinct().join(found.select(by, *keys).distinct(), [by, *keys], "left_anti").select(by, F.lit(1).alias("fn"), F.lit(0).alias("fp"))
    more = found.select(by, *keys).distinct().join(expected.select(by, *keys).distinct(), [by, *keys], "left_anti").select(by, F.lit(0).alias("fn"), F.lit(1).alias("fp"))
    none = expected.select(by).unionByName(found.select(by)).distinct().select(by, F.lit(0).alias("fn"), F.lit(0).alias("fp"))
    return none.unionByName(lost).unionByName(more).groupBy(by).agg(F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
