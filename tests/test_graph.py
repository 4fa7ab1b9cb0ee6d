import pytest
from pyspark.sql import functions as F

from ripplespark.functions import paths
from ripplespark.model import EDGES, SYMBOLS, ImpactOptions, profile
from ripplespark.operators import filters, graph, resolve, sets, summary


def edge(a, b, kind="call", provenance="call_graph", certainty="inferred", file="m.rs", line=1):
    return (a, b, kind, file, line, certainty, provenance)


def table(spark, pairs, files=None):
    rows = [p if len(p) == 7 else edge(*p) for p in pairs]
    names = sorted({x for r in rows for x in r[:2]})
    files = files or {}
    return spark.createDataFrame(rows, EDGES), spark.createDataFrame([(n, n, "function", files.get(n, "src/m.rs"), i + 1, i + 1, "rust") for i, n in enumerate(names)], SYMBOLS)


def seeds(spark, *nodes):
    return spark.createDataFrame([("q", n) for n in nodes], "seed_id string, node string")


def test_chain(spark):
    e, s = table(spark, [("mid", "leaf"), ("top", "mid")])
    out = graph.impact(e, s, seeds(spark, "leaf"), by=["seed_id"])
    assert [tuple(r) for r in summary.by_depth(out).orderBy("depth").collect()] == [(1, 1, 1), (2, 1, 1)]
    assert tuple(summary.risk(out).first()) == ("medium", 1, 1, 1, 2)


def test_confirmed_only_is_empty(spark):
    e, s = table(spark, [("mid", "leaf"), ("top", "mid")])
    q = seeds(spark, "leaf")
    out = graph.impact(e, s, q, ImpactOptions(min_confidence="confirmed"), ["seed_id"])
    assert tuple(summary.risk(out, ["seed_id"], q).first())[1:] == ("low", 0, 0, 0, 0)
    assert filters.filter_summary(e, "confirmed").first()["kept_edge_count"] == 0


def test_module_fanout(spark):
    files = {"leaf": "leaf.rs", "a1": "alpha/a.rs", "a2": "alpha/b.rs", "b1": "beta/b.rs", "r1": "main.rs", "main": "main.rs"}
    e, s = table(spark, [("a1", "leaf"), ("a2", "leaf"), ("b1", "leaf"), ("r1", "leaf"), ("main", "a1")], files)
    out = graph.impact(e, s, seeds(spark, "leaf"))
    got = [tuple(r) for r in summary.affected_modules(out).orderBy(*summary.module_order()).collect()]
    assert got == [("alpha", 2, 2), ("(root)", 2, 1), ("beta", 1, 1)]
    assert tuple(summary.risk(out).first()) == ("high", 4, 1, 4, 5)


def test_linear_five_is_high(spark):
    e, s = table(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")])
    out = graph.impact(e, s, seeds(spark, "a"))
    assert tuple(summary.risk(out).first()) == ("high", 1, 3, 1, 4)


@pytest.mark.parametrize("depth,want", [(0, set()), (1, {"c"}), (5, {"c", "d"})])
def test_depth_bound(spark, depth, want):
    e, s = table(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    out = graph.impact(e, s, seeds(spark, "b"), ImpactOptions("callees", depth))
    assert {r["id"] for r in out.collect()} == want


def test_cycle_reports_the_seed_for_callees_only(spark):
    e, s = table(spark, [("a", "b"), ("b", "a")])
    assert {(r["id"], r["depth"]) for r in graph.impact(e, s, seeds(spark, "a"), ImpactOptions("callees")).collect()} == {("b", 1), ("a", 2)}
    assert {r["id"] for r in graph.impact(e, s, seeds(spark, "a")).collect()} == {"b"}


def test_self_edge_is_no_result(spark):
    e, s = table(spark, [("a", "a"), ("b", "a")])
    assert {r["id"] for r in graph.impact(e, s, seeds(spark, "a"), ImpactOptions("callees")).collect()} == set()


def test_ignored_folders_are_passed_through(spark):
    files = {"a": "src/a.js", "g": "dist/g.js", "b": "src/b.js"}
    e, s = table(spark, [("g", "a"), ("b", "g")], files)
    skip = paths.ignored(F.col("file"), ["./dist/"])
    assert {r["id"] for r in graph.impact(e, s, seeds(spark, "a"), ignored=skip).collect()} == {"b"}
    assert graph.impact(e, s, seeds(spark, "g"), ignored=skip).count() == 0


def test_queries_are_apart(spark):
    e, s = table(spark, [("b", "a"), ("c", "b"), ("d", "c")])
    q = spark.createDataFrame([("x", "a"), ("y", "c")], "seed_id string, node string")
    out = {(r["seed_id"], r["id"], r["depth"]) for r in graph.impact(e, s, q, by=["seed_id"]).collect()}
    assert out == {("x", "b", 1), ("x", "c", 2), ("x", "d", 3), ("y", "d", 1)}


def test_witness_prefers_explained_hops_then_compact_ones(spark):
    e, _ = table(spark, [edge("m1", "s"), edge("m2", "s", "data", "local_dfg"), edge("t", "m1"), edge("t", "m2")])
    w = {r["node"]: r for r in graph.witnesses(e, seeds(spark, "s")).collect()}
    assert [h["dst"] for h in w["t"]["path"]] == ["m2", "t"] and w["t"]["root"] == "s"
    e, _ = table(spark, [edge("m1", "s", line=1), edge("m2", "s", line=2), edge("t", "m1", line=9), edge("t", "m2", line=2)])
    w = {r["node"]: r for r in graph.finish_witnesses(graph.witnesses(e, seeds(spark, "s"))).withColumnRenamed("symbol_id", "node").collect()}
    assert w["t"]["via_symbol_id"] == "m2" and len(w["t"]["path_compact"]) == 1 and w["t"]["path_compact"][0]["collapsed_hops"] == 2


def test_edge_scope(spark):
    e, s = table(spark, [edge("b", "a"), edge("c", "b"), edge("x", "v", "data", "local_dfg", line=7), edge("v", "b", "data", "local_dfg", line=7)])
    q = seeds(spark, "a")
    out = graph.impact(e.where("provenance = 'call_graph'"), s, q, ImpactOptions(max_depth=1), ["seed_id"])
    got = {(r["src"], r["dst"]) for r in graph.scope_edges(e, q, out, "callers", ["seed_id"]).collect()}
    assert got == {("b", "a"), ("c", "b")}
    got = {(r["src"], r["dst"]) for r in graph.scope_edges(e, q, out, "callees", ["seed_id"]).collect()}
    assert got == {("b", "a")}


def test_highlight(spark):
    e, _ = table(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")])
    got = {tuple(r) for r in graph.highlight(e, seeds(spark, "a"), spark.createDataFrame([("d",)], "node string")).collect()}
    assert got == {(p, q) for a, b in [("a", "b"), ("b", "c"), ("c", "d")] for p, q in [(a, b), (b, a)]}


def test_merge_keeps_base_and_tags_the_rest(spark):
    base, _ = table(spark, [edge("a", "b", certainty="confirmed", file="f.rs", line=3)])
    local = spark.createDataFrame([("f:def:x:1", "f:use:x:3", "data")], "src string, dst string, kind string")
    pdg = spark.createDataFrame([("a", "b", "data"), ("f:use:x:3", "b", "data"), ("f:def:x:1", "f:use:x:3", "data")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([("f:use:x:3", "f.rs", 3), ("f:def:x:1", "f.rs", 1)], "id string, file string, line int")
    got = {(r["src"], r["dst"], r["kind"], r["certainty"], r["provenance"], r["line"]) for r in sets.merge_pdg(base, local, pdg, nodes).collect()}
    assert got == {
        ("a", "b", "call", "confirmed", "call_graph", 3),
        ("f:def:x:1", "f:use:x:3", "data", "inferred", "local_dfg", 3),
        ("f:use:x:3", "b", "data", "confirmed", "symbolic_propagation", 3),
    }


def test_profiles():
    assert profile("balanced") == ("inferred", False) and profile("precision-first") == ("confirmed", True)
    assert profile("precision-first", "inferred") == ("inferred", True)
    with pytest.raises(ValueError):
        profile("other")


def test_one_language(spark):
    ok = spark.createDataFrame([("go",), ("go",)], "language string")
    assert filters.one_language(ok).count() == 2
    with pytest.raises(Exception, match="more than one language"):
        filters.one_language(spark.createDataFrame([("go",), ("rust",)], "language string")).collect()


def test_crowded_names_get_the_best_that_pairs_would(spark):
    """Looking places up gives what comparing every pair gives, and alike references and candidates aren't paired."""
    import random

    pick = random.Random(5).choice
    files = ["a/m.rs", "a/n.py", "b/m.rs", "b/c/mod.rs", "./b/x.java", "m.rs", "b/index.ts", "za/m.rs", "", None]
    modules = ["a::m", "m", "b", "b::c", "", None, "none"]
    refs = [(i, pick("fgh"), pick(files), pick(modules), False, [pick(modules) for _ in range(i % 3)], pick((True, False, None))) for i in range(150)]
    cand = [(pick("fgh"), f"c{i}", pick(files), pick(("function", "method")), pick(("rust", "python")), pick((1, 2, None))) for i in range(90)]
    r = spark.createDataFrame(refs, "ref_id long, key string, file string, qualifier string, only boolean, prefixes array<string>, is_method boolean")
    c = spark.createDataFrame(cand, "key string, c_id string, c_file string, c_kind string, c_language string, c_line int")
    for rows in (r, r.where("qualifier <> ''").withColumn("only", F.lit(True))):
        pairs, places = ({tuple(x) for x in resolve.best(rows, c, few).collect()} for few in (1000, 0))
        assert pairs == places and pairs
    n = 30_000
    many = spark.range(n).select("id", F.lit("f").alias("key"), F.concat(F.lit("d"), (F.col("id") % 7).cast("string"), F.lit("/m.rs")).alias("file"))
    r = many.select(F.col("id").alias("ref_id"), "key", "file", F.lit(None).cast("string").alias("qualifier"), F.lit(False).alias("only"), F.array(F.lit("d1")).alias("prefixes"), F.lit(False).alias("is_method"))
    c = many.select("key", F.format_string("c%05d", "id").alias("c_id"), F.col("file").alias("c_file"), F.lit("function").alias("c_kind"), F.lit("rust").alias("c_language"), F.lit(1).alias("c_line"))
    got = resolve.best(r, c)  # 900 million pairs
    assert {(x["ref_id"] % 7, x["dst"], x["score"]) for x in got.collect()} == {(k, f"c{n - 1 - (n - 1 - k) % 7:05d}", 45) for k in range(7)}


@pytest.fixture
def parts(spark, tmp_path, monkeypatch):
    """The parts of what a function of stored edges gives or cuts, over a small table and one of ten times its rows."""
    from ripplespark import work

    stored = []
    for n in (2_000, 20_000):
        row = spark.range(0, n, 1, 1).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("id") * 7 % n).cast("string")).alias("dst"), F.lit("call").alias("kind"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit("inferred").alias("certainty"), F.lit("call_graph").alias("provenance"))
        row.write.parquet(f"{tmp_path}/{n}")
        stored.append(spark.read.parquet(f"{tmp_path}/{n}"))
    monkeypatch.setattr(work, "PART", 2_000)

    def measured(f):
        found = []
        for e in stored:
            seen = []
            monkeypatch.setattr(graph, "cut", lambda df, what="step", seen=seen: (seen.append(df), work.cut(df, what))[1])
            f(e, seen)
            found.append(max(df.rdd.getNumPartitions() for df in seen))
        return found

    return measured


def test_adjacency_has_more_parts_for_more_edges(spark, parts):
    few, many = parts(lambda e, seen: graph.reach(e, seeds(spark, "n1"), "both", 1))
    assert many >= 4 * few


def test_unique_edges_have_more_parts_for_more_edges(parts):
    few, many = parts(lambda e, seen: seen.append(sets.unique_edges(e, ["src", "dst", "kind"])))
    assert many >= 4 * few


def test_closure_has_more_parts_for_more_edges(parts):
    few, many = parts(lambda e, seen: graph.closure(e.where("src <= 'n3'"), e.where("src < 'n10'").select(F.col("src").alias("node"), F.col("src").alias("input")), ["input"]))
    assert many >= 4 * few


def test_difference_has_more_parts_for_more_edges(spark, parts):
    few, many = parts(lambda e, seen: seen.append(sets.difference(e, e.where("src > 'n5'"), ["src", "dst"])))
    assert many >= 4 * few
    a, b = (spark.createDataFrame(x, "k string") for x in ([("a",), ("b",), ("b",), (None,)], [("b",), ("c",), ("c",), (None,)]))
    assert sorted(map(tuple, sets.difference(a, b, ["k"]).collect())) == [("a", "missing"), ("c", "extra")]
