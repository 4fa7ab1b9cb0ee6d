"""Registered queries of the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_code
from .functions import paths
from .model import ImpactOptions, parse_id, symbol_id
from .operators import changed, filters, graph, ranking, resolve, sets, summary
from .plans import store
from .sources import tables as T
from .work import cut, spread

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return add


DEPTH = 4


def _reach_sql(direction: str, depth: int, where: str = "TRUE", keep: str = "TRUE") -> str:
    """Common table expressions up to ``reached`` (seed_id, node, depth)."""
    back, ahead = "SELECT dst AS cur, src AS next FROM edges", "SELECT src AS cur, dst AS next FROM edges"
    adj = {"callers": f"{back} WHERE {where}", "callees": f"{ahead} WHERE {where}", "both": f"{back} WHERE {where} UNION ALL {ahead} WHERE {where}"}[direction]
    return f"""WITH RECURSIVE {T.EDGES_SQL}, {T.SEEDS_SQL}, adj AS (SELECT DISTINCT cur, next FROM ({adj})),
walk AS (SELECT seed_id, node, 0 AS depth FROM seeds WHERE {keep} UNION SELECT seed_id, next, depth + 1 FROM walk JOIN adj ON cur = node WHERE depth < {depth}),
reached AS (SELECT seed_id, node, min(depth)::INTEGER AS depth FROM walk GROUP BY ALL)"""


def _impacted_sql(direction: str, depth: int, where: str = "TRUE", ignore: str = "FALSE") -> str:
    keep = f"node NOT IN (SELECT id FROM symbols WHERE {ignore})"
    again = f"""UNION ALL SELECT seed_id, next, min(depth + 1)::INTEGER FROM reached r JOIN adj ON cur = node
WHERE depth < {depth} AND cur <> next AND (seed_id, next) IN (SELECT (seed_id, node) FROM reached WHERE depth = 0) GROUP BY seed_id, next""" if direction == "callees" else ""
    return f"""{_reach_sql(direction, depth, where, keep)},
impacted AS (SELECT seed_id, s.*, depth FROM (SELECT * FROM reached WHERE depth > 0 {again}) JOIN symbols s ON id = node WHERE NOT ({ignore}))"""


def _impact(spark: SparkSession, d: str, direction: str = "callers", depth: int = DEPTH, dirs: tuple[str, ...] = (), least: str | None = None, drop: bool = False) -> DataFrame:
    options = ImpactOptions(direction, depth, min_confidence=least, exclude_dynamic_fallback=drop)
    return graph.impact(T.edges(spark, d), T.symbols(spark, d), T.seeds(spark, d), options, ["seed_id"], paths.ignored(F.col("file"), dirs) if dirs else None)


@query(_reach_sql("callers", DEPTH) + " SELECT * FROM reached")
def impact_callers_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(T.edges(spark, d), T.seeds(spark, d), "callers", DEPTH, ["seed_id"])


@query(_reach_sql("callees", DEPTH) + " SELECT * FROM reached")
def impact_callees_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(T.edges(spark, d), T.seeds(spark, d), "callees", DEPTH, ["seed_id"])


@query(_reach_sql("both", 2) + " SELECT * FROM reached")
def impact_both_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(T.edges(spark, d), T.seeds(spark, d), "both", 2, ["seed_id"])


@query(_impacted_sql("callees", 3) + " SELECT * FROM impacted")
def impact_callees(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, "callees", 3)


@query(_impacted_sql("callers", DEPTH) + " SELECT seed_id, depth, count(*) AS symbol_count, count(DISTINCT file) AS file_count FROM impacted GROUP BY ALL")
def impact_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return summary.by_depth(_impact(spark, d), ["seed_id"])


LABEL = r"CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') WHEN regexp_matches(file, '^(mod\.rs|lib\.rs|main\.rs|index\.(js|ts|tsx)|__init__\.py)$') THEN '(root)' ELSE file END"


@query(_impacted_sql("callers", 1) + f" SELECT seed_id, {LABEL} AS module, count(*) AS symbol_count, count(DISTINCT file) AS file_count FROM impacted GROUP BY ALL")
def impact_modules(spark: SparkSession, d: str) -> DataFrame:
    return summary.affected_modules(_impact(spark, d, depth=1), ["seed_id"])


RISK = """, c AS (SELECT q.seed_id, count(*) FILTER (depth = 1) AS direct_hits, count(*) FILTER (depth >= 2) AS transitive_hits, count(DISTINCT file) AS impacted_files, count(id) AS impacted_symbols
FROM (SELECT DISTINCT seed_id FROM seeds) q LEFT JOIN impacted i ON i.seed_id = q.seed_id GROUP BY q.seed_id)
SELECT *, CASE WHEN direct_hits >= 3 OR (direct_hits >= 2 AND transitive_hits >= 2) OR (direct_hits >= 1 AND transitive_hits >= 3) OR impacted_files >= 4 OR impacted_symbols >= 8 THEN 'high'
WHEN direct_hits >= 1 OR transitive_hits >= 3 OR impacted_files >= 2 OR impacted_symbols >= 4 THEN 'medium' ELSE 'low' END AS level FROM c"""


@query(_impacted_sql("callers", 2, "certainty = 'confirmed'") + RISK)
def impact_risk(spark: SparkSession, d: str) -> DataFrame:
    return summary.risk(_impact(spark, d, depth=2, least="confirmed"), ["seed_id"], T.seeds(spark, d))


IGNORE = ("Brand_1", "./Brand_2/", "")
IGNORE_SQL = "file = 'Brand_1' OR starts_with(file, 'Brand_1/') OR file = 'Brand_2' OR starts_with(file, 'Brand_2/')"


@query(_impacted_sql("callers", 2, ignore=IGNORE_SQL) + " SELECT * FROM impacted")
def impact_ignore_dirs(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, depth=2, dirs=IGNORE)


@query(_impacted_sql("callers", 1) + " SELECT * FROM impacted")
def impact_max_depth(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, depth=1)


@query(_impacted_sql("callers", 0) + " SELECT * FROM impacted")
def impact_depth_zero(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, depth=0)


@query(_impacted_sql("callers", 2, "certainty <> 'dynamic_fallback'") + " SELECT * FROM impacted")
def impact_confidence_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, depth=2, least="inferred", drop=True)


@query(f"WITH {T.EDGES_SQL} SELECT 'inferred' AS min_confidence, TRUE AS exclude_dynamic_fallback, count(*) AS input_edge_count, count(*) FILTER (certainty <> 'dynamic_fallback') AS kept_edge_count FROM edges")
def confidence_filter_summary(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_summary(T.edges(spark, d), "inferred", True)


@query(f"WITH {T.EDGES_SQL} SELECT kind, count(*) FILTER (certainty = 'confirmed') AS confirmed, count(*) FILTER (certainty = 'inferred') AS inferred, count(*) FILTER (certainty = 'dynamic_fallback') AS dynamic_fallback FROM edges GROUP BY kind")
def confidence_distribution(spark: SparkSession, d: str) -> DataFrame:
    return summary.confidence_distribution(T.edges(spark, d), ["kind"])


@query(f"WITH {T.EDGES_SQL} SELECT * FROM edges WHERE kind = 'call' AND provenance = 'call_graph'")
def call_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return filters.call_graph(T.edges(spark, d))


SCOPE = """, scope AS (SELECT seed_id, n, bool_or(c) AS c FROM (SELECT seed_id, node AS n, TRUE AS c FROM seeds UNION ALL SELECT seed_id, id, FALSE FROM impacted) GROUP BY ALL)"""


@query(_impacted_sql("callees", 1) + SCOPE + " SELECT a.seed_id, e.* FROM edges e JOIN scope a ON a.n = src JOIN scope b ON b.n = dst AND a.seed_id = b.seed_id")
def impact_edges_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.scope_edges(T.edges(spark, d), T.seeds(spark, d), _impact(spark, d, "callees", 1), "callees", ["seed_id"])


@query(
    _impacted_sql("callers", 1)
    + SCOPE
    + """, q AS (SELECT DISTINCT seed_id FROM scope), ends AS (SELECT q.seed_id, e.*, a.c AS ac, b.c AS bc FROM q CROSS JOIN edges e LEFT JOIN scope a ON a.seed_id = q.seed_id AND a.n = src
LEFT JOIN scope b ON b.seed_id = q.seed_id AND b.n = dst WHERE a.n IS NOT NULL OR b.n IS NOT NULL),
places AS (SELECT DISTINCT seed_id, file, line FROM ends WHERE kind = 'call' AND provenance = 'call_graph')
SELECT seed_id, src, dst, kind, file, line, certainty, provenance FROM ends
WHERE NOT (provenance IN ('local_dfg', 'symbolic_propagation') AND (ac IS NULL OR bc IS NULL)) OR coalesce(ac, FALSE) OR coalesce(bc, FALSE) OR (seed_id, file, line) IN (SELECT (seed_id, file, line) FROM places)"""
)
def impact_edges_scoped(spark: SparkSession, d: str) -> DataFrame:
    return graph.scope_edges(T.edges(spark, d), T.seeds(spark, d), _impact(spark, d, "callers", 1), "callers", ["seed_id"])


@query(
    f"""WITH RECURSIVE {T.EDGES_SQL}, {T.SEEDS_SQL}, adj AS (SELECT DISTINCT 'callers' AS direction, dst AS cur, src AS next FROM edges UNION SELECT DISTINCT 'callees', src, dst FROM edges),
walk AS (SELECT seed_id, direction, node, 0 AS depth FROM seeds CROSS JOIN (SELECT unnest(['callers', 'callees']) AS direction)
UNION SELECT seed_id, w.direction, next, depth + 1 FROM walk w JOIN adj a ON cur = node AND a.direction = w.direction WHERE depth < 2)
SELECT seed_id, direction, node, min(depth)::INTEGER AS depth FROM walk GROUP BY ALL"""
)
def impact_per_seed(spark: SparkSession, d: str) -> DataFrame:
    parts = [graph.reach(T.edges(spark, d), T.seeds(spark, d), x, 2, ["seed_id"]).withColumn("direction", F.lit(x)) for x in ("callers", "callees")]
    return parts[0].unionByName(parts[1])


WITNESS = """, e AS (SELECT *, CASE provenance WHEN 'symbolic_propagation' THEN 0 WHEN 'local_dfg' THEN 1 ELSE 2 END AS pr, CASE kind WHEN 'data' THEN 0 WHEN 'call' THEN 1 ELSE 2 END AS kr FROM edges),
hop AS (SELECT dst AS cur, src AS next, pr, kr, file, line, (provenance <> 'call_graph')::INTEGER AS flow FROM e),
one AS (SELECT seed_id, next AS node, node AS root, 1 AS n, flow, [[pr, kr]] AS ranks, [struct_pack(pr := pr, kr := kr, file := file, line := line, src := cur, dst := next)] AS path, 1 AS short FROM seeds JOIN hop ON cur = node),
best1 AS (SELECT o.* FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, node ORDER BY -flow, short, path) AS rn FROM one) o JOIN reached r ON r.seed_id = o.seed_id AND r.node = o.node WHERE rn = 1 AND depth = 1),
two AS (SELECT o.seed_id, h.next AS node, root, 2 AS n, o.flow + h.flow AS flow, list_append(path, struct_pack(pr := h.pr, kr := h.kr, file := h.file, line := h.line, src := h.cur, dst := h.next)) AS path,
  CASE WHEN path[1].pr = h.pr AND path[1].kr = h.kr AND path[1].file = h.file AND path[1].line = h.line THEN 1 ELSE 2 END AS short FROM best1 o JOIN hop h ON h.cur = o.node),
best2 AS (SELECT o.* FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, node ORDER BY -flow, short, path) AS rn FROM two) o JOIN reached r ON r.seed_id = o.seed_id AND r.node = o.node WHERE rn = 1 AND depth = 2)
SELECT seed_id, node AS symbol_id, root AS root_symbol_id, n::INTEGER AS depth, flow::INTEGER AS flow_hops, short::INTEGER AS compact_hops, path[-1].src AS via_symbol_id, path[1].line AS first_line FROM best1
UNION ALL SELECT seed_id, node, root, n::INTEGER, flow::INTEGER, short::INTEGER, path[-1].src, path[1].line FROM best2"""


@query(_reach_sql("callers", 2) + WITNESS)
def witness_path(spark: SparkSession, d: str) -> DataFrame:
    found = graph.finish_witnesses(graph.witnesses(T.edges(spark, d), T.seeds(spark, d), "callers", 2, ["seed_id"]), ["seed_id"])
    flow = F.size(F.filter("provenance_chain", lambda p: p != "call_graph"))
    return found.select("seed_id", "symbol_id", "root_symbol_id", "depth", flow.alias("flow_hops"), F.size("path_compact").alias("compact_hops"), "via_symbol_id", F.col("path")[0]["line"].alias("first_line"))


@query(f"WITH {T.SITES_SQL} SELECT DISTINCT diff_id, s.* FROM symbols s JOIN sites t ON s.file = t.file AND line BETWEEN start_line AND end_line")
def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return changed.changed_symbols(T.sites(spark, d), T.symbols(spark, d), ["diff_id"])


@query(
    f"WITH {T.SITES_SQL}, pts AS (SELECT DISTINCT file, line FROM sites) SELECT t.file, line, arg_min(id, (end_line - start_line, -start_line, id)) AS symbol_id FROM pts t JOIN symbols s ON s.file = t.file AND line BETWEEN start_line AND end_line GROUP BY ALL"
)
def enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    return changed.enclosing(T.sites(spark, d).select("file", "line").distinct(), T.symbols(spark, d), "file")


RESOLVE = f"""WITH {T.SYMBOLS_SQL}, refs AS (SELECT id AS ref, name, file, language = 'java' AS is_method, replace(regexp_replace(file, '/[^/]*$', ''), '/', '::') AS prefix FROM symbols),
pairs AS (SELECT ref, c.id, c.start_line, CASE WHEN c.file = r.file THEN 30 ELSE 0 END + CASE WHEN regexp_replace(c.file, '/[^/]*$', '') = regexp_replace(r.file, '/[^/]*$', '') THEN 10 ELSE 0 END
  + CASE WHEN list_bool_or(list_transform([{", ".join(f"'{e}'" for e in paths.ENDINGS)}], lambda x: ends_with(c.file, replace(prefix, '::', '/') || x))) THEN 15 ELSE 0 END
  + CASE WHEN is_method THEN CASE WHEN c.kind = 'method' THEN 25 WHEN c.language IN ('ruby', 'python') THEN 20 ELSE 0 END WHEN c.kind = 'function' THEN 5 ELSE 0 END AS score
  FROM refs r JOIN symbols c ON c.name = r.name AND c.kind IN ('function', 'method'))
SELECT ref, arg_max(id, (score, -start_line, id)) AS target, max(score)::INTEGER AS score FROM pairs GROUP BY ref"""


@query(RESOLVE)
def resolve_top1(spark: SparkSession, d: str) -> DataFrame:
    s = T.symbols(spark, d)
    refs = s.select(F.col("id").alias("ref"), "name", "file", (F.col("language") == "java").alias("is_method"), F.replace(paths.parent(F.col("file")), F.lit("/"), F.lit("::")).alias("prefix"))
    c = filters.callable_only(s).select(F.col("name").alias("key"), *(F.col(x).alias(f"c_{x}") for x in ("id", "file", "kind", "language")), F.col("start_line").alias("c_line"))
    asked = refs.select(F.col("ref").alias("ref_id"), F.col("name").alias("key"), "file", F.lit(None).cast("string").alias("qualifier"), F.lit(False).alias("only"), F.array("prefix").alias("prefixes"), "is_method")
    return resolve.best(asked, c).select(F.col("ref_id").alias("ref"), F.col("dst").alias("target"), "score")


SUFFIX = f"""WITH {T.SYMBOLS_SQL}, files AS (SELECT DISTINCT file FROM symbols), mods AS (SELECT DISTINCT replace(p_brand, '#', '_') || '::' || p_type AS module FROM part UNION SELECT DISTINCT p_type FROM part)
SELECT file, module FROM files, mods WHERE list_bool_or(list_transform([{", ".join(f"'{e}'" for e in paths.ENDINGS)}], lambda x: file = replace(module, '::', '/') || x OR ends_with(file, '/' || replace(module, '::', '/') || x)))"""


@query(SUFFIX)
def module_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "part")
    mods = p.select(F.concat(F.translate("p_brand", "#", "_"), F.lit("::"), "p_type").alias("module")).union(p.select("p_type")).distinct()
    files = T.symbols(spark, d).select("file").distinct()
    return files.withColumn("module", F.explode(paths.module_keys(F.col("file")))).join(mods, "module").select("file", "module")


EXPORTS = """WITH RECURSIVE ex AS (SELECT 'm' || n_nationkey AS prefix, 'm' || ((n_nationkey * 7 + 3) % 30) AS nxt FROM nation),
walk AS (SELECT prefix AS start, prefix AS cur, [prefix] AS seen, 0 AS hops FROM ex
UNION ALL SELECT start, nxt, list_append(seen, nxt), hops + 1 FROM walk JOIN ex ON prefix = cur WHERE hops < 10 AND NOT list_contains(seen[1:len(seen) - 1], cur))
SELECT start AS prefix, arg_max(cur, hops) AS real_prefix FROM walk GROUP BY start"""


@query(EXPORTS)
def reexport_chain(spark: SparkSession, d: str) -> DataFrame:
    n = T.read(spark, d, "nation")
    m = F.concat(F.lit("m"), F.col("n_nationkey").cast("string"))
    to = F.concat(F.lit("m"), ((F.col("n_nationkey") * 7 + 3) % 30).cast("string"), F.lit("::f"))
    imports = n.select(F.concat(m, F.lit(".ts")).alias("file"), F.lit("export").alias("entry_type"), F.lit("f").alias("key"), to.alias("target"))
    return resolve.follow_exports(n.select(m.alias("prefix"), F.lit("f").alias("name")), imports).select("prefix", "real_prefix")


@query(f"WITH {T.LINES_SQL} SELECT doc_id, line, first, coalesce(max(line) OVER (PARTITION BY doc_id, first ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_line FROM lines")
def reaching_defs(spark: SparkSession, d: str) -> DataFrame:
    rows = T.lines(spark, d).select("doc_id", "line", "first")
    return changed.last_before(rows, rows, ["doc_id", "first"], "line", "line").na.fill(0, ["last_line"])


NEAR = f"""WITH {T.SITES_SQL}, pts AS (SELECT DISTINCT file, line FROM sites), marks AS (SELECT file, start_line AS line, id FROM symbols),
hits AS (SELECT a.file, a.line, id, ord, delta FROM pts a CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS ord, unnest([0, -1, 1, -2, 2]) AS delta) o JOIN marks m ON m.file = a.file AND m.line = a.line + delta)
SELECT file, line, id, delta FROM (SELECT *, bool_or(delta = 0) OVER (PARTITION BY file, line) AS own FROM hits) WHERE NOT own OR delta = 0"""


@query(NEAR)
def callsite_proximity(spark: SparkSession, d: str) -> DataFrame:
    rows = T.sites(spark, d).select("file", "line").distinct().withColumn("row_id", F.xxhash64("file", "line"))
    marks = T.symbols(spark, d).select("file", F.col("start_line").alias("line"), "id")
    return changed.near(rows, marks, ["file"], [0, -1, 1, -2, 2]).select("file", "line", "id", "delta")


CLOSURE = f"""WITH RECURSIVE {T.EDGES_SQL}, inside AS (SELECT a.file AS fn, src, dst FROM edges e JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.file = b.file),
walk AS (SELECT DISTINCT fn, src AS input, src AS node FROM inside UNION SELECT w.fn, input, dst FROM walk w JOIN inside i ON i.fn = w.fn AND i.src = node)
SELECT fn, input, node FROM walk WHERE node <> input"""


@query(CLOSURE)
def function_flow_closure(spark: SparkSession, d: str) -> DataFrame:
    s = T.symbols(spark, d).select("id", "file")
    # an edge's file is its source's
    e = spread(T.edges(spark, d).select(F.col("file").alias("fn"), "src", "dst"), "dst")
    inside = cut(e.join(s.select(F.col("id").alias("dst"), F.col("file").alias("f2")), "dst").where("fn = f2").select("fn", "src", "dst"), "inside")
    inputs = inside.select("fn", F.col("src").alias("input"), F.col("src").alias("node")).distinct()
    return graph.closure(inside, inputs, ["fn", "input"])


UNION = f"""WITH {T.EDGES_SQL}, base AS (SELECT * FROM edges WHERE provenance = 'call_graph'), loc AS (SELECT dst AS src, src AS dst, kind FROM edges WHERE provenance = 'local_dfg'),
pdg AS (SELECT src, dst, kind FROM edges WHERE provenance = 'symbolic_propagation' UNION SELECT src, dst, 'data' FROM base WHERE kind = 'call'),
have AS (SELECT src, dst, kind FROM base UNION SELECT src, dst, 'data' FROM base WHERE kind = 'call'),
one AS (SELECT DISTINCT * FROM loc EXCEPT SELECT * FROM have), two AS (SELECT DISTINCT * FROM pdg EXCEPT SELECT * FROM have EXCEPT SELECT * FROM loc)
SELECT src, dst, kind, certainty, provenance FROM base UNION ALL SELECT *, 'inferred', 'local_dfg' FROM one UNION ALL SELECT *, 'inferred', 'symbolic_propagation' FROM two"""


@query(UNION)
def edge_union_provenance(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d)
    base = e.where("provenance = 'call_graph'")
    local = e.where("provenance = 'local_dfg'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    pdg = e.where("provenance = 'symbolic_propagation'").select("src", "dst", "kind").union(base.where("kind = 'call'").select("src", "dst", F.lit("data")))
    return sets.merge_pdg(base, local, pdg).select("src", "dst", "kind", "certainty", "provenance")


@query(f"WITH {T.SYMBOLS_SQL} SELECT file, id, (row_number() OVER (PARTITION BY file ORDER BY end_line - start_line, id))::INTEGER AS rn, CASE WHEN row_number() OVER (PARTITION BY file ORDER BY end_line - start_line, id) > 1 THEN 'weaker_same_path_duplicate' END AS prune_reason FROM symbols")
def best_per_key_with_losers(spark: SparkSession, d: str) -> DataFrame:
    s = T.symbols(spark, d)
    return ranking.best_per_key(s, ["file"], [F.col("end_line") - F.col("start_line"), F.col("id")], "weaker_same_path_duplicate").select("file", "id", "rn", "prune_reason")


@query(
    f"""WITH {T.SYMBOLS_SQL}, r AS (SELECT language, name, id, row_number() OVER (PARTITION BY language ORDER BY end_line, id) AS rn FROM symbols), f AS (SELECT *, min(rn) OVER (PARTITION BY language, name) AS f FROM r)
SELECT language, name, id, place::INTEGER AS place, place <= 3 AS admitted, CASE WHEN place > 3 THEN 'ranked_out' END AS prune_reason FROM (SELECT *, dense_rank() OVER (PARTITION BY language ORDER BY f) AS place FROM f)"""
)
def top_k_budget(spark: SparkSession, d: str) -> DataFrame:
    return ranking.budget(T.symbols(spark, d), ["language"], [F.col("end_line"), F.col("id")], "name", 3).select("language", "name", "id", "place", "admitted", "prune_reason")


RLE = f"""WITH {T.EDGES_SQL}, h AS (SELECT src, dst, kind, provenance, row_number() OVER (PARTITION BY src ORDER BY dst) AS i, lag(kind) OVER w AS k, lag(provenance) OVER w AS p FROM edges WINDOW w AS (PARTITION BY src ORDER BY dst))
SELECT src, count(*) FILTER (k IS DISTINCT FROM kind OR p IS DISTINCT FROM provenance)::INTEGER AS compact_hops, count(*)::INTEGER AS hops FROM h GROUP BY src"""


@query(RLE)
def path_rle_compact(spark: SparkSession, d: str) -> DataFrame:
    hop = F.struct("src", "dst", "kind", "provenance", F.lit("f").alias("file"), F.lit(1).alias("line"))
    p = T.edges(spark, d).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("dst", hop.alias("h")))), lambda x: x["h"]).alias("path"))
    short = graph.compact(F.col("path"))
    return p.select("src", F.size(short).alias("compact_hops"), F.aggregate(short, F.lit(0), lambda a, x: a + x["collapsed_hops"]).alias("hops"))


@query(f"WITH {T.EDGES_SQL}, a AS (SELECT src, dst FROM edges WHERE kind = 'call'), b AS (SELECT dst AS src, src AS dst FROM edges WHERE kind = 'data') (SELECT src, dst, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT src, dst, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
def oracle_diff(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d)
    return sets.difference(e.where("kind = 'call'"), e.where("kind = 'data'").select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])


@query(f"""WITH {T.SYMBOLS_SQL}, a AS (SELECT language, id FROM symbols WHERE kind IN ('function', 'method')), b AS (SELECT language, id FROM symbols WHERE end_line - start_line > 10)
SELECT language, count(*) FILTER (b.id IS NULL) AS fn, count(*) FILTER (a.id IS NULL) AS fp FROM a FULL JOIN b USING (language, id) GROUP BY language""")
def fn_fp_totals(spark: SparkSession, d: str) -> DataFrame:
    s = T.symbols(spark, d)
    return summary.fn_fp(s.where("kind IN ('function', 'method')"), s.where("end_line - start_line > 10"), "language", ["id"])


@query(f"WITH {T.SYMBOLS_SQL}, a AS (SELECT *, contains(file, 'Brand_1') AS p FROM symbols), b AS (SELECT * FROM a WHERE p OR NOT (SELECT bool_or(p) FROM a)), c AS (SELECT *, 1000 BETWEEN start_line AND end_line AS q FROM b), e AS (SELECT * FROM c WHERE q OR NOT (SELECT bool_or(q) FROM c)), f AS (SELECT *, name LIKE '%bolt' AS r FROM e) SELECT id, name, kind, file, start_line, end_line, language FROM f WHERE r OR NOT (SELECT bool_or(r) FROM f)")
def id_narrowing(spark: SparkSession, d: str) -> DataFrame:
    return filters.narrow(T.symbols(spark, d), [F.col("file").contains("Brand_1"), F.lit(1000).between(F.col("start_line"), F.col("end_line")), F.col("name").like("%bolt")])


@query(f"WITH {T.SYMBOLS_SQL} SELECT DISTINCT file, {LABEL} AS label, replace(CASE WHEN regexp_matches(file, '/mod\\.rs$') THEN regexp_replace(file, '/[^/]*$', '') ELSE regexp_replace(file, '\\.(rs|rb|js|ts|tsx|py|go|java)$', '') END, '/', '::') AS module FROM symbols")
def module_path_label(spark: SparkSession, d: str) -> DataFrame:
    return T.symbols(spark, d).select("file").distinct().select("file", paths.module_label(F.col("file")).alias("label"), paths.module_path(F.col("file")).alias("module"))


@query(f"WITH {T.SYMBOLS_SQL} SELECT id, language || ':' || file || ':' || CASE kind WHEN 'function' THEN 'fn' WHEN 'method' THEN 'method' WHEN 'struct' THEN 'struct' WHEN 'enum' THEN 'enum' WHEN 'trait' THEN 'trait' ELSE 'mod' END || ':' || name || ':' || start_line AS symbol_id, language, file, kind, name, start_line AS line FROM symbols")
def symbol_id_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    s = T.symbols(spark, d).select("id", symbol_id(F.col("language"), F.col("file"), F.col("kind"), F.col("name"), F.col("start_line")).alias("symbol_id"))
    return s.withColumn("p", parse_id(F.col("symbol_id"))).select("id", "symbol_id", "p.language", "p.file", "p.kind", "p.name", "p.line")


@query(f"WITH {T.EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return summary.degrees(T.edges(spark, d))


@query(f"WITH {T.SYMBOLS_SQL} SELECT language, count(*) AS symbol_count FROM symbols GROUP BY language")
def language_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.languages(T.symbols(spark, d))


@query(f"WITH {T.EDGES_SQL} SELECT file, line, arg_max(certainty, CASE certainty WHEN 'confirmed' THEN 2 WHEN 'inferred' THEN 1 ELSE 0 END) AS certainty FROM edges GROUP BY file, line")
def strongest_certainty(spark: SparkSession, d: str) -> DataFrame:
    return summary.strongest_certainty(T.edges(spark, d))


@query(_impacted_sql("callers", 1) + " SELECT seed_id, file, array_to_string(list_sort(list(DISTINCT id)), ',') AS symbols FROM impacted GROUP BY ALL")
def impacted_by_file(spark: SparkSession, d: str) -> DataFrame:
    return summary.impacted_by_file(_impact(spark, d, depth=1), ["seed_id"]).withColumn("symbols", F.array_join("symbols", ","))


@query(_impacted_sql("callers", 1) + " SELECT DISTINCT seed_id, file FROM impacted")
def impacted_files(spark: SparkSession, d: str) -> DataFrame:
    return summary.impacted_files(_impact(spark, d, depth=1), ["seed_id"])


@query(f"WITH {T.EDGES_SQL} SELECT src, dst, kind, min(struct_pack(file := file, line := line, certainty := certainty, provenance := provenance)).line AS line FROM (SELECT src, dst, kind, file, line, certainty, provenance FROM edges UNION ALL SELECT dst, src, kind, file, line, certainty, provenance FROM edges) GROUP BY src, dst, kind")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *e.columns[2:]))
    return sets.unique_edges(both, ["src", "dst", "kind"]).select("src", "dst", "kind", "line")


BOUNDARY = f"""WITH {T.EDGES_SQL}, {T.SEEDS_SQL}, b AS (SELECT DISTINCT seed_id, node AS root, src AS via FROM seeds JOIN edges ON dst = node WHERE src <> node),
far AS (SELECT DISTINCT seed_id, via, e.src AS id FROM b JOIN edges e ON e.dst = via WHERE e.src <> root AND e.src <> via)
SELECT seed_id, via, f.id FROM far f JOIN symbols s ON s.id = f.id WHERE (seed_id, s.file) NOT IN (SELECT (seed_id, file) FROM b JOIN symbols s ON s.id = via)"""


@query(BOUNDARY)
def boundary_two_hop(spark: SparkSession, d: str) -> DataFrame:
    from .operators.slicing import completions

    return completions(T.edges(spark, d), T.seeds(spark, d), T.symbols(spark, d), ["seed_id"], "callers").select("seed_id", "via", "id")


FILES_A = "SELECT file AS path, min(language) AS lang, sum(start_line) AS digest FROM symbols WHERE kind <> 'enum' GROUP BY file"
FILES_B = "SELECT file AS path, min(language) AS lang, sum(CASE WHEN name LIKE 'red%' THEN start_line + 1 ELSE start_line END) AS digest FROM symbols WHERE kind <> 'trait' GROUP BY file"


@query(f"WITH {T.SYMBOLS_SQL}, a AS ({FILES_A}), b AS ({FILES_B}) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'gone' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path) WHERE a.path IS NULL OR b.path IS NULL OR a.digest <> b.digest OR a.lang <> b.lang")
def store_delta_detect(spark: SparkSession, d: str) -> DataFrame:
    s = T.symbols(spark, d)
    a = s.where("kind <> 'enum'").groupBy(F.col("file").alias("path")).agg(F.min("language").alias("lang"), F.sum("start_line").alias("digest")).withColumn("present", F.lit(True))
    b = s.where("kind <> 'trait'").groupBy(F.col("file").alias("path")).agg(F.min("language").alias("lang"), F.sum(F.when(F.col("name").like("red%"), F.col("start_line") + 1).otherwise(F.col("start_line"))).alias("digest"))
    return store.delta(a, b)


@query(f"WITH {T.SYMBOLS_SQL}, new AS (SELECT 'n' || id AS id, file FROM symbols WHERE kind = 'method'), paths AS (SELECT DISTINCT file FROM symbols WHERE name LIKE 'red%') SELECT id, file FROM symbols WHERE file NOT IN (SELECT file FROM paths) UNION ALL SELECT id, file FROM new WHERE file IN (SELECT file FROM paths)")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = T.symbols(spark, d).select("id", "file")
    new = T.symbols(spark, d).where("kind = 'method'").select(F.concat(F.lit("n"), "id").alias("id"), "file")
    touched = T.symbols(spark, d).where("name LIKE 'red%'").select(F.col("file").alias("path")).distinct()
    return store.replace(s, new, touched, "file")


@query(f"WITH {T.EDGES_SQL} SELECT (SELECT count(DISTINCT file) FROM symbols) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    s = T.symbols(spark, d)
    return summary.store_stats(s.select("file").distinct().withColumn("present", F.lit(True)), s, T.edges(spark, d))


@query(f"WITH {T.SYMBOLS_SQL} SELECT file AS path, bool_or(kind = 'function') AS cache_update, bool_or(ends_with(file, '.rs')) AS local_dfg, bool_or(start_line > 50) AS explanation, array_to_string(list_sort(list(DISTINCT name)), ',') AS reasons FROM symbols GROUP BY file")
def slice_merge(spark: SparkSession, d: str) -> DataFrame:
    s = T.symbols(spark, d)
    rows = s.select(F.col("file").alias("path"), (F.col("kind") == "function").alias("cache_update"), F.col("file").endswith(".rs").alias("local_dfg"), (F.col("start_line") > 50).alias("explanation"), F.col("name").alias("reason"))
    return summary.merge_slices(rows).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {T.EDGES_SQL} SELECT src, dst, line, max(line) OVER (PARTITION BY src) AS last_line FROM edges")
def side_last_call(spark: SparkSession, d: str) -> DataFrame:
    return summary.side_last_call(T.edges(spark, d), ["src"]).select("src", "dst", "line", "last_line")


@query(f"WITH {T.SYMBOLS_SQL} SELECT DISTINCT file FROM symbols WHERE ends_with(file, '.rs') OR ends_with(file, '.rb')")
def local_dfg_files(spark: SparkSession, d: str) -> DataFrame:
    return filters.local_dfg_files(T.symbols(spark, d), "file").select("file").distinct()


@query(
    """SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN 'c' || n_nationkey WHEN 1 THEN 'a::b' || n_nationkey || '::c' WHEN 2 THEN 'a::c' WHEN 3 THEN 'a::c' ELSE 'a::b' || n_nationkey || '::x::y' END AS expanded,
CASE n_nationkey % 3 WHEN 0 THEN 'a/c' || n_nationkey WHEN 1 THEN '../z' ELSE 'x/y' END AS normalised FROM nation"""
)
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    n = T.read(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    path = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("crate::c"), k)).when(F.col("n_nationkey") % 5 == 1, "self::c").when(F.col("n_nationkey") % 5 == 2, "super::c").when(F.col("n_nationkey") % 5 == 3, "self::super::super::c").otherwise("x::y")
    raw = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("./a/b/../c"), k)).when(F.col("n_nationkey") % 3 == 1, "a/../../z").otherwise("x//./y/")
    return n.select(F.col("n_nationkey").alias("k"), paths.expand_relative(F.concat(F.lit("a::b"), k), path).alias("expanded"), paths.normalise(raw).alias("normalised"))


@query(
    f"""WITH {T.EDGES_SQL}, s AS (SELECT src, count(*) AS calls, count(*) FILTER (kind = 'data') AS flows, min(line) AS at FROM edges GROUP BY src), p AS (SELECT a.src AS winner, b.src AS loser, a.calls AS ac, b.calls AS bc, a.flows AS af, b.flows AS bf, a.at AS aa, b.at AS ba
FROM s a JOIN edges e ON e.src = a.src JOIN s b ON b.src = e.dst)
SELECT winner, loser, CASE WHEN ac <> bc THEN CASE WHEN ac > bc THEN 'primary_evidence_count' END WHEN af <> bf THEN CASE WHEN af > bf THEN 'secondary_evidence_count' END WHEN aa <> ba THEN CASE WHEN aa > ba THEN 'call_position_rank' END WHEN winner <> loser THEN CASE WHEN winner < loser THEN 'lexical_tiebreak' END END AS better_by FROM p"""
)
def first_better_field(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges(spark, d)
    none = F.lit(0)
    fields = {"source_rank": none, "lane_rank": none, "primary_evidence_count": F.count("*"), "negative_evidence_count": none, "semantic_support_rank": none, "secondary_evidence_count": F.count(F.when(F.col("kind") == "data", 1)), "call_position_rank": F.min("line")}
    s = e.groupBy("src").agg(*(c.alias(n) if n not in ("source_rank", "lane_rank", "negative_evidence_count", "semantic_support_rank") else F.max(none).alias(n) for n, c in fields.items()))
    s = s.select("src", F.struct(*fields, F.col("src").alias("lexical_tiebreak")).alias("score"))
    pairs = e.select("src", "dst").join(s.withColumnRenamed("score", "w"), "src").join(s.select(F.col("src").alias("dst"), F.col("score").alias("l")), "dst")
    return pairs.select(F.col("src").alias("winner"), F.col("dst").alias("loser"), ranking.first_better("w", "l").alias("better_by"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth buckets and risk of what reaches the first part of each brand."""
    found = _impact(spark, sf_dir)
    return summary.by_depth(found, ["seed_id"]).join(summary.risk(found, ["seed_id"]), "seed_id")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()} | catalog_code.queries()


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items() if sql} | catalog_code.oracle_sql()
