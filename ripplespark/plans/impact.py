"""From files and a diff or seeds to an impact report: the engine's whole query as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ignored
from ..model import ImpactOptions
from ..operators import changed, dataflow, filters, graph, sets, slicing, summary
from ..operators.resolve import resolve
from ..sources import code, diff
from ..work import cut


@dataclass
class Report:
    """Relations of a result; each has the query keys ``by``."""

    changed: DataFrame
    impacted: DataFrame
    edges: DataFrame
    by_depth: DataFrame
    modules: DataFrame
    risk: DataFrame
    files: DataFrame
    witnesses: DataFrame | None = None
    slices: DataFrame | None = None
    pruned: DataFrame | None = None
    confidence: DataFrame | None = None


class Engine:
    """Analyses of one set of files (``path``, ``content``, ``language``). Extraction runs once."""

    def __init__(self, spark: SparkSession, files: DataFrame, confirmed: DataFrame | None = None):
        self.spark, self.files = spark, files
        self.symbols, self.refs, self.imports = code.extract(files)
        found = resolve(self.refs, self.imports, self.symbols)
        self.calls = cut(found if confirmed is None else sets.unique_edges(confirmed.select(*sets.EDGE).unionByName(found), ["src", "dst", "kind"]))

    def changed(self, changes: DataFrame) -> DataFrame:
        """Symbols that a diff touches, by ``diff_id``."""
        return changed.changed_symbols(changed.changed_lines(changes), self.symbols, ["diff_id"])

    def diff(self, text: str) -> DataFrame:
        return diff.diff_text(self.spark, text)

    def ids(self, path: str | None = None, line: int | None = None, name: str | None = None, kind: str | None = None) -> DataFrame:
        """Symbols narrowed step by step; a step that would leave nothing is skipped."""
        steps = []
        if path is not None:
            steps.append((F.col("file") == path) | F.endswith("file", F.lit("/" + path)))
        if line is not None:
            steps.append(F.lit(line).between(F.col("start_line"), F.col("end_line")))
        if name is not None:
            steps.append(F.col("name") == name)
        if kind is not None:
            steps.append(F.col("kind") == kind)
        return filters.narrow(self.symbols, steps)

    def dependence(self, propagation: bool = False, paths: DataFrame | None = None) -> DataFrame:
        """Call edges with local data flow of Rust and Ruby files (of ``paths``, if given) and, on demand, propagation through calls."""
        files = self.files if paths is None else self.files.join(paths.select("path").distinct(), "path", "left_semi")
        tokens = cut(dataflow.token_table(files))
        node, flow = cut(dataflow.nodes(tokens)), cut(dataflow.edges(tokens))
        more = dataflow.pdg(flow, self.calls)
        if propagation:
            inputs, flows = dataflow.summaries(self.symbols, node, flow)
            inputs, flows = cut(inputs), cut(flows)
            more = more.unionByName(dataflow.propagate(self.calls, node, inputs, flows, self.symbols)).unionByName(dataflow.bridges(self.symbols, node))
        return cut(sets.merge_pdg(self.calls, flow, more, node))

    def impact(self, seeds: DataFrame, options: ImpactOptions = ImpactOptions(), pdg: bool = False, propagation: bool = False, witnesses: bool = False) -> Report:
        """What seeds (``seed_id``, ``node``) reach. Each ``seed_id`` is a query of its own; all are one job."""
        by = ["seed_id"]
        edges, slices, pruned = self.calls, None, None
        if pdg or propagation:
            slices, pruned = slicing.plan_slice(self.calls, seeds, self.symbols, "callers" if options.direction == "both" else options.direction)
            slices = cut(slices)
            edges = self.dependence(propagation, slices.where("local_dfg").select("path"))
        confidence = None
        if options.min_confidence or options.exclude_dynamic_fallback:
            confidence = filters.filter_summary(edges, options.min_confidence, options.exclude_dynamic_fallback)
            edges = filters.filter_edges(edges, options.min_confidence, options.exclude_dynamic_fallback)
        skip = ignored(F.col("file"), options.ignore_dirs) if options.ignore_dirs else None
        plain = ImpactOptions(options.direction, options.max_depth)
        found = cut(graph.impact(edges, self.symbols, seeds, plain, by, skip))
        start = self.symbols if skip is None else self.symbols.where(~skip)
        kept = seeds.join(start.withColumnRenamed("id", "node").select("node"), "node", "left_semi")
        scoped = graph.scope_edges(edges, kept, found, options.direction, by) if options.with_edges else edges.select(F.lit(None).cast("string").alias("seed_id"), "*").limit(0)
        paths = graph.finish_witnesses(graph.witnesses(edges, kept, options.direction, options.max_depth, by), by) if witnesses else None
        return Report(
            kept.join(self.symbols, kept["node"] == self.symbols["id"]).drop("node"),
            found,
            scoped,
            summary.by_depth(found, by),
            summary.affected_modules(found, by),
            summary.risk(found, by, seeds),
            summary.impacted_files(found, by),
            paths,
            slices,
            pruned,
            confidence,
        )

    def impact_of(self, changes: DataFrame, options: ImpactOptions = ImpactOptions(), **more: bool) -> Report:
        """What diffs reach; each ``diff_id`` is a query."""
        seeds = self.changed(changes).select(F.col("diff_id").alias("seed_id"), F.col("id").alias("node"))
        return self.impact(cut(seeds), options, **more)
