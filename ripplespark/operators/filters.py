"""Predicates and filters of impact queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CERTAINTY, certainty_rank


def confident(least: str | None = None, exclude_dynamic: bool = False, certainty: str = "certainty") -> Column:
    """Edges of at least this certainty, without dynamic fallbacks if those are excluded."""
    c = F.col(certainty)
    keep = F.lit(True)
    if least is not None:
        keep = keep & (certainty_rank(c) >= CERTAINTY.index(least))
    if exclude_dynamic:
        keep = keep & (c != "dynamic_fallback")
    return F.coalesce(keep, F.lit(False))


def filter_edges(edges: DataFrame, least: str | None = None, exclude_dynamic: bool = False) -> DataFrame:
    return edges.where(confident(least, exclude_dynamic))


def filter_summary(edges: DataFrame, least: str | None = None, exclude_dynamic: bool = False) -> DataFrame:
    """One row: the options, and edges before and after them."""
    keep = confident(least, exclude_dynamic)
    return edges.agg(
        F.lit(least).cast("string").alias("min_confidence"),
        F.lit(exclude_dynamic).alias("exclude_dynamic_fallback"),
        F.count("*").alias("input_edge_count"),
        F.coalesce(F.sum(keep.cast("long")), F.lit(0)).alias("kept_edge_count"),
    )


def call_graph(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'call' AND provenance = 'call_graph'")


def callable_only(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin("function", "method"))


def local_dfg_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Files whose language has local data flow."""
    return files.where(F.col(path).rlike(r"\.(rs|rb)$"))


def narrow(rows: DataFrame, steps: list[Column], by: list[str] | None = None) -> DataFrame:
    """Apply predicates in turn, each only if it leaves rows (of its ``by`` group).

    One aggregation a step finds whether any row passes; rows aren't sorted or moved into one task.
    """
    keys = by or []
    for step in steps:
        hit = F.coalesce(step, F.lit(False))
        if keys:
            rows = rows.withColumn("_any", F.max(hit).over(Window.partitionBy(*keys))).where(hit | ~F.col("_any")).drop("_any")
        else:
            any_ = rows.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("_any"))
            rows = rows.crossJoin(F.broadcast(any_)).where(hit | ~F.col("_any")).drop("_any")  # one row
    return rows


def one_language(seeds: DataFrame, language: str = "language") -> DataFrame:
    """``seeds`` unless they are of more than one language: then the query fails."""
    n = seeds.agg(F.count_distinct(language).alias("_n"))
    checked = n.select(F.when(F.col("_n") > 1, F.raise_error(F.lit("seeds are of more than one language"))).otherwise(F.lit(True)).alias("_ok"))
    return seeds.crossJoin(F.broadcast(checked)).where(F.col("_ok").isNull() | F.col("_ok")).drop("_ok")
