"""Bounded breadth-first impact over an edge table, for any number of queries at once.

A frontier row is (query, node); one join a level moves all queries on. Each
level is written to the shared work folder, so plans stay flat and a lost
executor costs one level; the loop ends with the first empty frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PROVENANCE, REF_KIND, ImpactOptions, rank
from ..work import cut, spread
from .filters import confident

HOP = "struct<src:string,dst:string,kind:string,provenance:string,file:string,line:int>"


def adjacency(edges: DataFrame, direction: str, *columns: str) -> DataFrame:
    """``cur``, ``next`` and other columns of edges: callers follow an edge backwards, callees forwards, both either way."""
    back = edges.select(F.col("dst").alias("cur"), F.col("src").alias("next"), *columns)
    ahead = edges.select(F.col("src").alias("cur"), F.col("dst").alias("next"), *columns)
    return back if direction == "callers" else ahead if direction == "callees" else back.unionByName(ahead)


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "callers", max_depth: int = 100, by: list[str] | None = None) -> DataFrame:
    """Nodes reached from ``seeds`` (``node`` and ``by``) with their least depth; seeds have depth 0."""
    keys = by or []
    seen = cut(seeds.select(*keys, "node").distinct().withColumn("depth", F.lit(0)), "level")
    if max_depth < 1:
        return seen
    front, adj = seen, cut(spread(adjacency(edges, direction), "cur", "next").distinct(), "adjacency")
    for d in range(1, max_depth + 1):
        moved = front.join(adj, front["node"] == adj["cur"]).select(*keys, F.col("next").alias("node"))
        moved = spread(moved, *keys, "node").distinct()
        front = cut(moved.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("depth", F.lit(d)), "level")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reached_again(edges: DataFrame, reached: DataFrame, max_depth: int = 100, by: list[str] | None = None, direction: str = "callees") -> DataFrame:
    """Seeds that traversal meets again from another node, with the least depth at which it does."""
    keys = by or []
    adj = spread(adjacency(edges, direction).where("cur <> next"), "cur", "next").distinct()
    seeds = reached.where("depth = 0").select(*keys, "node")
    hops = reached.where(F.col("depth") < max_depth).join(adj, F.col("node") == F.col("cur")).select(*keys, F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"))
    return hops.join(seeds, [*keys, "node"], "left_semi").groupBy(*keys, "node").agg(F.min("depth").alias("depth"))


def impact(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, options: ImpactOptions = ImpactOptions(), by: list[str] | None = None, ignored: Column | None = None) -> DataFrame:
    """Impacted symbols with depth.

    ``seeds``: ``node`` and ``by``. ``ignored``: a predicate on symbols' ``file``;
    it removes seeds and results, but traversal passes through. Seeds are no
    results, except that callees report a seed met again from another node. Nodes
    that aren't symbols (variables) carry depth and aren't reported.
    """
    keys = by or []
    if options.min_confidence is not None or options.exclude_dynamic_fallback:
        edges = edges.where(confident(options.min_confidence, options.exclude_dynamic_fallback))
    kept = symbols if ignored is None else symbols.where(~ignored)
    if ignored is not None:
        seeds = seeds.join(symbols.where(ignored).select(F.col("id").alias("node")), "node", "left_anti")
    found = reach(edges, seeds, options.direction, options.max_depth, by)
    out = found.where("depth > 0")
    if options.direction == "callees":
        out = out.unionByName(reached_again(edges, found, options.max_depth, by))
    return out.withColumnRenamed("node", "id").join(kept, "id").select(*keys, *kept.columns, "depth")


def edge_key() -> list[Column]:
    """The order of edges: strongest explanation first, then place."""
    return [rank(F.col("provenance"), PROVENANCE), rank(F.col("kind"), REF_KIND), F.col("file"), F.col("line"), F.col("src"), F.col("dst")]


def compact(path: Column) -> Column:
    """Runs of hops alike in provenance, kind, file and line as one hop, with their number."""
    empty = F.lit(None).cast("array<struct<src:string,dst:string,kind:string,provenance:string,file:string,line:int,collapsed_hops:int>>")

    def step(done: Column, hop: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (last["provenance"] == hop["provenance"]) & (last["kind"] == hop["kind"]) & last["file"].eqNullSafe(hop["file"]) & last["line"].eqNullSafe(hop["line"])

        def made(src: Column, n: Column) -> Column:
            return F.array(F.struct(src.alias("src"), hop["dst"].alias("dst"), *(hop[c].alias(c) for c in ("kind", "provenance", "file", "line")), n.cast("int").alias("collapsed_hops")))

        return F.when(same, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), made(last["src"], last["collapsed_hops"] + 1))).otherwise(F.concat(done, made(hop["src"], F.lit(1))))

    return F.aggregate(path, F.coalesce(empty, F.array().cast("array<struct<src:string,dst:string,kind:string,provenance:string,file:string,line:int,collapsed_hops:int>>")), step)


def path_order(path: Column) -> Column:
    """A witness's rank among paths of one length: more hops that aren't plain calls, fewer compact hops, then edge order."""
    other = F.size(F.filter(path, lambda h: h["provenance"] != "call_graph"))
    signs = F.transform(path, lambda h: F.struct(rank(h["provenance"], PROVENANCE), rank(h["kind"], REF_KIND), h["file"], h["line"], h["src"], h["dst"]))
    return F.struct((-other).alias("a"), F.size(compact(path)).alias("b"), signs.alias("c"))


def witnesses(edges: DataFrame, seeds: DataFrame, direction: str = "callers", max_depth: int = 100, by: list[str] | None = None) -> DataFrame:
    """For each reached node its best shortest path: ``root``, ``path`` (hops), ``depth``.

    Seeds begin with an empty path each, so a path's length is the node's depth.
    """
    keys = by or []
    hop = F.struct("src", "dst", "kind", "provenance", "file", "line").alias("hop")
    adj = cut(adjacency(edges.withColumn("hop", hop), direction, "hop"), "adjacency")
    seen = cut(seeds.select(*keys, "node").distinct().select(*keys, "node", F.col("node").alias("root"), F.array().cast(f"array<{HOP}>").alias("path"), F.lit(0).alias("depth")), "witness")
    front = seen
    for d in range(1, max_depth + 1):
        # a hop names the step as walked, whichever way the edge points
        step = F.struct(F.col("cur").alias("src"), F.col("next").alias("dst"), *(F.col(f"hop.{c}").alias(c) for c in ("kind", "provenance", "file", "line")))
        moved = front.join(adj, front["node"] == adj["cur"]).select(*keys, F.col("next").alias("node"), "root", F.concat("path", F.array(step)).alias("path"))
        fresh = moved.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti")
        best = fresh.groupBy(*keys, "node").agg(F.min_by(F.struct("root", "path"), path_order(F.col("path"))).alias("w"))
        front = cut(best.select(*keys, "node", "w.root", "w.path", F.lit(d).alias("depth")), "witness")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def finish_witnesses(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Witnesses as reported: via symbol, last edge, chains of provenance and kind, and their compact forms."""
    keys = by or []
    short = compact(F.col("path"))
    return found.where("depth > 0").select(
        *keys,
        F.col("node").alias("symbol_id"),
        "depth",
        F.col("root").alias("root_symbol_id"),
        F.element_at("path", -1)["src"].alias("via_symbol_id"),
        F.element_at("path", -1).alias("edge"),
        "path",
        F.transform("path", lambda h: h["provenance"]).alias("provenance_chain"),
        F.transform("path", lambda h: h["kind"]).alias("kind_chain"),
        short.alias("path_compact"),
        F.transform(short, lambda h: h["provenance"]).alias("provenance_chain_compact"),
        F.transform(short, lambda h: h["kind"]).alias("kind_chain_compact"),
    )


def scope_edges(edges: DataFrame, changed: DataFrame, impacted: DataFrame, direction: str, by: list[str] | None = None) -> DataFrame:
    """Edges to report: callees with both ends in scope, others with either; callers drop a data-flow edge with one end
    in scope unless that end is changed or its call site is one of an edge in scope."""
    keys = by or []
    scope = changed.select(*keys, F.col("node").alias("n")).withColumn("changed", F.lit(True)).unionByName(impacted.select(*keys, F.col("id").alias("n")).withColumn("changed", F.lit(False)))
    scope = scope.groupBy(*keys, "n").agg(F.bool_or("changed").alias("changed"))
    a = scope.withColumnsRenamed({"n": "src", "changed": "src_changed"})
    b = scope.withColumnsRenamed({"n": "dst", "changed": "dst_changed"})
    left, right = edges.join(a, "src"), edges.join(b, "dst")
    on = [*keys, *edges.columns]
    ends = left.join(right, on, "inner" if direction == "callees" else "full")
    if direction != "callers":
        return ends.select(*on)
    one = F.col("src_changed").isNull() | F.col("dst_changed").isNull()
    kept = F.coalesce("src_changed", F.lit(False)) | F.coalesce("dst_changed", F.lit(False))
    flow = F.col("provenance").isin("local_dfg", "symbolic_propagation")
    sites = ends.where((F.col("kind") == "call") & (F.col("provenance") == "call_graph")).select(*keys, "file", "line").distinct().withColumn("site", F.lit(True))
    return ends.join(sites, [*keys, "file", "line"], "left").where(~(flow & one) | kept | F.col("site")).select(*on)


def highlight(edges: DataFrame, seeds: DataFrame, targets: DataFrame, max_depth: int = 100) -> DataFrame:
    """Edges, both ways, on one undirected shortest path from the seeds to each target."""
    found = witnesses(edges, seeds, "both", max_depth)
    hops = found.join(targets.select("node"), "node", "left_semi").select(F.explode("path").alias("h")).select("h.src", "h.dst")
    return hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def closure(edges: DataFrame, inputs: DataFrame, by: list[str]) -> DataFrame:
    """Nodes that flow from each input (``node`` and ``by``) along edges that carry the same ``by`` but the input's own key.

    ``edges``: ``src``, ``dst`` and those of ``by`` that bound the search (a function). The input isn't in its closure.
    """
    bound = [c for c in by if c in edges.columns]
    seen = cut(inputs.select(*by, "node").distinct(), "closure")
    front, start = seen, seen
    ahead = cut(spread(edges.withColumnRenamed("src", "node").select(*bound, "node", "dst"), *bound, "node", "dst").distinct(), "adjacency")
    while True:  # until nothing new is met, however many rounds that takes
        moved = front.join(ahead, [*bound, "node"]).select(*by, F.col("dst").alias("node"))
        moved = spread(moved, *by, "node").distinct()
        front = cut(moved.join(seen, [*by, "node"], "left_anti"), "closure")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(start, [*by, "node"], "left_anti")
