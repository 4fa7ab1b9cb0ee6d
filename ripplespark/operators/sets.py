"""Set operations on edges and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CERTAINTY, certainty_rank, unrank
from ..work import spread

EDGE = ["src", "dst", "kind", "file", "line", "certainty", "provenance"]


def unique_edges(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges once for each key (all columns by default); of equals, the least in column order."""
    keys = keys or EDGE
    edges = spread(edges, *keys)
    rest = [c for c in edges.columns if c not in keys]
    if not rest:
        return edges.distinct()
    return edges.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in rest)).select(*edges.columns)


def merge_pdg(base: DataFrame, local: DataFrame, pdg: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Reference edges, local data-flow edges (inferred) and the other dependence edges (symbolic propagation).

    ``local`` and ``pdg`` have ``src``, ``dst``, ``kind``. An edge that the base
    has with the same ends and kind isn't repeated; a propagated edge takes the
    strongest certainty of a call site at either end, or inferred, and the place of
    its first end that has one. ``nodes``: ``id``, ``file``, ``line``.
    """
    have = base.select("src", "dst", "kind").distinct()
    as_data = have.unionByName(base.where("kind = 'call'").select("src", "dst", F.lit("data").alias("kind"))).distinct()
    at = nodes if nodes is not None else base.select(F.col("src").alias("id"), "file", "line").limit(0)
    sites = base.groupBy("file", "line").agg(F.max(certainty_rank(F.col("certainty"))).alias("c"))
    place = at.join(sites, ["file", "line"], "left").groupBy("id").agg(F.min(F.struct("file", "line")).alias("p"), F.max("c").alias("c"))

    def placed(edges: DataFrame) -> DataFrame:
        a = place.select(F.col("id").alias("src"), F.col("p").alias("a"), F.col("c").alias("ca"))
        b = place.select(F.col("id").alias("dst"), F.col("p").alias("b"), F.col("c").alias("cb"))
        return edges.join(a, "src", "left").join(b, "dst", "left")

    def finish(edges: DataFrame, certainty, provenance: str) -> DataFrame:
        site = F.when(F.col("ca").isNotNull(), F.col("a")).when(F.col("cb").isNotNull(), F.col("b")).otherwise(F.coalesce("a", "b"))
        return edges.select("src", "dst", "kind", F.coalesce(site["file"], F.lit("")).alias("file"), F.coalesce(site["line"], F.lit(0)).alias("line"), certainty.alias("certainty"), F.lit(provenance).alias("provenance"))

    one = local.select("src", "dst", "kind").distinct().join(as_data, ["src", "dst", "kind"], "left_anti")
    two = pdg.select("src", "dst", "kind").distinct().join(as_data, ["src", "dst", "kind"], "left_anti").join(local.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
    strong = F.coalesce(unrank(F.greatest("ca", "cb"), CERTAINTY), F.lit("inferred"))
    return base.select(*EDGE).unionByName(finish(placed(one), F.lit("inferred"), "local_dfg")).unionByName(finish(placed(two), strong, "symbolic_propagation"))


def difference(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Symmetric difference of two relations' keys: ``side`` is missing or extra. Null keys are equal, as in EXCEPT."""
    both = expected.select(*keys, F.lit(True).alias("_a")).unionByName(found.select(*keys, F.lit(False).alias("_a")))
    sides = spread(both, *keys).groupBy(*keys).agg(F.max("_a").alias("_a"), F.min("_a").alias("_b"))
    return sides.where("_a = _b").select(*keys, F.when(F.col("_a"), "missing").otherwise("extra").alias("side"))
