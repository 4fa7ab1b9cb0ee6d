"""Connected components by alternating stars, and the mins they need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove_path


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows ``node``, ``root`` (the least node of its component) for each node of an edge list ``u``, ``v``.

    Large-star and small-star in turn: each replaces a node's edges by edges to
    its least neighbour, so edges never grow in number and the rounds needed are
    about the logarithm of a component's width. Minima are combined before the
    shuffle. Loops and repeated edges do no harm; no edges give no rows.
    """
    cur = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = cut(cur, "edges")
    mark = _mark(cur)
    while mark[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "edges")
        now = _mark(new)
        for f in cur.inputFiles()[:1]:
            remove_path(cur.sparkSession, f.rsplit("/", 1)[0])
        cur = new
        if now == mark:
            break
        mark = now
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
