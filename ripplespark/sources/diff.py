"""Unified diffs as change rows.

``parse`` reads one diff text in a line machine; ``parse_diffs`` runs it over a
table of diffs on the executors; ``parse_lines`` gives the same rows with windows
alone, for tables whose diffs are already lines. Hunk lengths decide where a hunk
ends, so a removed line that looks like a header stays a removed line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import strip_side
from ..model import CHANGES

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _path(line: str) -> str | None:
    name = line[4:].split("\t")[0].rstrip("\r").strip()
    return None if name == "/dev/null" else re.sub(r"^[ab]/", "", name)


def parse(text: str) -> list[tuple]:
    """Rows (file_ord, line_ord, old_path, new_path, kind, old_line, new_line, content); ValueError if there is no file header."""
    out: list[tuple] = []
    file_ord, line_ord, old, new = -1, 0, None, None
    pending, a, b, left_a, left_b, seen = None, 0, 0, 0, 0, False
    for line in text.split("\n"):
        inside = left_a > 0 or left_b > 0
        if not inside and line.startswith("--- "):
            pending = (_path(line),)
            continue
        if not inside and line.startswith("+++ ") and pending:
            old, new = pending[0], _path(line)
            pending, seen, line_ord = None, True, 0
            file_ord += 1
            continue
        m = HUNK.match(line) if not inside else None
        if m:
            a, b = int(m[1]), int(m[3])
            left_a, left_b = int(m[2]) if m[2] is not None else 1, int(m[4]) if m[4] is not None else 1
            continue
        if not inside or not seen or line.startswith("\\"):
            continue
        sign, body = line[:1], line[1:].removesuffix("\r")
        if sign == "+":
            out.append((file_ord, line_ord, old, new, "added", None, b, body))
            b, left_b = b + 1, left_b - 1
        elif sign == "-":
            out.append((file_ord, line_ord, old, new, "removed", a, None, body))
            a, left_a = a + 1, left_a - 1
        else:
            out.append((file_ord, line_ord, old, new, "context", a, b, body if sign == " " else line))
            a, b, left_a, left_b = a + 1, b + 1, left_a - 1, left_b - 1
        line_ord += 1
    if not seen:
        raise ValueError("no file header in the diff")
    return out


def parse_diffs(diffs: DataFrame, strict: bool = False) -> DataFrame:
    """Changes of every row of ``diffs`` (``diff_id``, ``text``). A text without a header gives no rows, or fails if ``strict``."""
    names = [c.split()[0] for c in CHANGES.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for key, text in zip(pdf["diff_id"], pdf["text"]):
                try:
                    rows += [(key, *r) for r in parse(text or "")]
                except ValueError:
                    if strict:
                        raise
            out = pd.DataFrame(rows, columns=names)
            for c in ("old_line", "new_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return diffs.select("diff_id", "text").mapInPandas(run, CHANGES)


def diff_text(spark: SparkSession, text: str, diff_id: str = "diff") -> DataFrame:
    """Changes of one diff text, as read from standard input."""
    return parse_diffs(spark.createDataFrame([(diff_id, text)], "diff_id string, text string"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Changes of diff lines (``diff_id``, ``n``, ``line``) with windows over each diff; hunks are taken to end at the next header."""
    over = Window.partitionBy("diff_id").orderBy("n")
    head = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    is_hunk, is_old, is_new = F.col("line").rlike(head), F.col("line").startswith("--- "), F.col("line").startswith("+++ ")
    rows = lines.withColumn("_old", F.when(is_old, F.col("line"))).withColumn("_new", F.when(is_new, F.col("line"))).withColumn("_hunk", F.when(is_hunk, F.col("n")))
    rows = rows.withColumns({"_file": F.sum(is_new.cast("int")).over(over) - 1, "_old": F.last("_old", True).over(over), "_new": F.last("_new", True).over(over), "_hunk": F.last("_hunk", True).over(over), "_head": F.last(F.when(is_hunk | is_old, F.when(is_hunk, F.col("line")).otherwise("")), True).over(over)})
    body = rows.where(~is_hunk & ~is_old & ~is_new & (F.col("_head") != "") & ~F.col("line").startswith("\\") & F.col("line").rlike("^[-+ ]"))
    sign = F.substring("line", 1, 1)
    run = Window.partitionBy("diff_id", "_hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    a0, b0 = F.regexp_extract("_head", head, 1).cast("int"), F.regexp_extract("_head", head, 2).cast("int")
    body = body.withColumn("a", a0 + F.coalesce(F.sum((sign != "+").cast("int")).over(run), F.lit(0))).withColumn("b", b0 + F.coalesce(F.sum((sign != "-").cast("int")).over(run), F.lit(0)))
    per_file = Window.partitionBy("diff_id", "_file").orderBy("n")

    def name(c: str):
        p = F.trim(F.substring(F.split(F.col(c), "\t")[0], 5, 1 << 20))
        return F.when(p != "/dev/null", strip_side(p))

    return body.select(
        "diff_id",
        F.col("_file").cast("int").alias("file_ord"),
        (F.row_number().over(per_file) - 1).cast("int").alias("line_ord"),
        name("_old").alias("old_path"),
        name("_new").alias("new_path"),
        F.when(sign == "+", "added").when(sign == "-", "removed").otherwise("context").alias("kind"),
        F.when(sign != "+", F.col("a")).cast("int").alias("old_line"),
        F.when(sign != "-", F.col("b")).cast("int").alias("new_line"),
        F.substring("line", 2, 1 << 30).alias("content"),
    )
