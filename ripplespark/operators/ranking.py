"""Top-1 per key with losers kept, budgets, and rank labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(rows: DataFrame, keys: list[str], order: list[Column], reason: str) -> DataFrame:
    """All rows with ``rn`` in their key's order and, for all but the first, why they lost."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rn", rn).withColumn("prune_reason", F.when(F.col("rn") > 1, F.lit(reason)))


def arg_max(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def budget(rows: DataFrame, keys: list[str], order: list[Column], item: str, limit: int, reason: str = "ranked_out") -> DataFrame:
    """Admit the first ``limit`` distinct items of each key, in the order in which they first appear; a repeated item costs nothing."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = F.min("_rn").over(Window.partitionBy(*keys, item))
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first"))
    out = rows.withColumn("_rn", rn).withColumn("_first", first).withColumn("place", place)
    return out.withColumn("admitted", F.col("place") <= limit).withColumn("prune_reason", F.when(F.col("place") > limit, F.lit(reason))).drop("_rn", "_first")


SCORES = (
    ("source_rank", True),
    ("lane_rank", True),
    ("primary_evidence_count", False),
    ("negative_evidence_count", True),
    ("semantic_support_rank", False),
    ("secondary_evidence_count", False),
    ("call_position_rank", False),
    ("lexical_tiebreak", True),
)


def score_order(via_path: str = "via_path", via_symbol: str = "via_symbol_id") -> list[Column]:
    """The total order of candidates without the pre-emption rule (see slicing)."""
    return [*(F.asc(c) if up else F.desc(c) for c, up in SCORES), F.asc(via_path), F.asc(via_symbol)]


def first_better(winner: str, loser: str) -> Column:
    """The first score field in which the two structs differ; null if there the loser is better, or nowhere."""
    out = F.lit(None).cast("string")
    for name, up in reversed(SCORES):
        a, b = F.col(winner)[name], F.col(loser)[name]
        out = F.when(a == b, out).when(a < b if up else a > b, F.lit(name))
    return out


def shorten(labels: Column, n: int = 2) -> Column:
    """The first labels, and how many more there are."""
    more = F.size(labels) - n
    return F.when(more > 0, F.concat(F.concat_ws(", ", F.slice(labels, 1, n)), F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.concat_ws(", ", labels))


def id_order() -> list[Column]:
    """Innermost first: span, then kind, then place."""
    kind = F.array_position(F.array(*map(F.lit, ("method", "function", "struct", "enum", "trait", "module"))), F.col("kind"))
    return [F.col("end_line") - F.col("start_line"), kind, F.col("file"), F.col("start_line"), F.col("id")]
