"""Changed files, lines and symbols; the innermost symbol around a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_files(changes: DataFrame) -> DataFrame:
    """The path of each file of a diff, the new one if there is one, in diff order."""
    return changes.groupBy("diff_id", "file_ord").agg(F.first(F.coalesce("new_path", "old_path")).alias("file"))


def changed_lines(changes: DataFrame) -> DataFrame:
    """File and line of each row of a diff: new number if present, else old. Added, removed and context rows all count."""
    line = F.coalesce("new_line", "old_line")
    return changes.select("diff_id", F.coalesce("new_path", "old_path").alias("file"), line.alias("line")).where("file IS NOT NULL AND line IS NOT NULL").distinct()


def changed_symbols(lines: DataFrame, symbols: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Symbols whose range holds a changed line of their file, once for each query.

    The file is the join's hash key; the range is its residual. Lines are reduced
    to one row a query, file and line before.
    """
    keys = by or []
    hit = lines.select(*keys, "file", "line").distinct().join(symbols, "file").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return hit.select(*keys, *symbols.columns).dropDuplicates([*keys, "id"])


def enclosing(rows: DataFrame, symbols: DataFrame, row_id: str) -> DataFrame:
    """``rows`` (with ``file``, ``line``) and the id of the smallest symbol around each, the later one of equals; others are dropped."""
    inner = symbols.select(F.col("file").alias("_f"), "start_line", "end_line", F.col("id").alias("symbol_id"))
    both = rows.join(inner, (F.col("file") == F.col("_f")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = F.min_by(F.col("symbol_id"), F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"), "symbol_id"))
    return both.groupBy(*rows.columns).agg(best.alias("symbol_id")) if row_id in rows.columns else both.groupBy("file", "line").agg(best.alias("symbol_id"))


def last_before(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """An as-of join: for each row, the greatest ``value`` of ``marks`` with equal keys that is less than the row's ``at``.

    One shuffle on the keys: rows and marks are united, and a running maximum goes down each key's order.
    """
    left = rows.withColumn("_at", F.col(at)).withColumn("_mark", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_row", F.lit(True))
    right = marks.select(*keys, F.col(value).alias("_at"), F.col(value).alias("_mark"), F.lit(False).alias("_row"))
    over = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn(f"last_{value}", F.max("_mark").over(over)).where("_row").drop("_at", "_mark", "_row")


def near(rows: DataFrame, marks: DataFrame, keys: list[str], offsets: list[int], least: str | None = None) -> DataFrame:
    """A proximity join: marks of the row's own line and, in the given order of offsets, of lines near it.

    ``least``: a column of ``rows``; offsets are taken until so many marks are found. Without it the first offset that has marks is taken,
    or all others together if the row's own line has none.
    """
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(list(enumerate(offsets)), "ord int, delta int"))
    probes = rows.withColumn("_row", F.monotonically_increasing_id()) if "row_id" not in rows.columns else rows.withColumn("_row", F.col("row_id"))
    probes = probes.crossJoin(table).withColumn("_line", F.col("line") + F.col("delta"))  # the offsets are a short list
    m = marks.withColumnRenamed("line", "_line")
    hits = probes.join(m, [*keys, "_line"])
    if least is None:
        own = F.max(F.col("delta") == 0).over(Window.partitionBy("_row"))
        return hits.withColumn("_own", own).where(~F.col("_own") | (F.col("delta") == 0)).drop("_own", "_row")
    count = F.count("*").over(Window.partitionBy("_row").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1))
    return hits.withColumn("_before", F.coalesce(count, F.lit(0))).where(F.col("_before") < F.col(least)).drop("_before", "_row")
