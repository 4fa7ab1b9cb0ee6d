import pytest
from pyspark.sql import functions as F

from ripplespark import contracts, render
from ripplespark.extract import analyze
from ripplespark.functions import paths
from ripplespark.model import ImpactOptions, parse_id
from ripplespark.operators import dataflow, explain, ranking, slicing
from ripplespark.plans.impact import Engine
from ripplespark.plans.store import Store
from ripplespark.sources import code, seeds
from ripplespark.sources.diff import parse, parse_diffs
from ripplespark.streaming.diffs import impact_stream


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string").withColumn("language", code.language_of())


def names(rows):
    return {r.name for r in rows}


def test_diff_cases():
    added = "diff --git a/x b/x\n--- /dev/null\n+++ b/x\n@@ -0,0 +1,3 @@\n+a\n+b\n+c\n"
    assert [r[4:7] for r in parse(added)] == [("added", None, 1), ("added", None, 2), ("added", None, 3)] and parse(added)[0][2] is None
    many = "--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n l\n+m\n@@ -10,0 +11,2 @@\n+n\n+o\n\\ No newline at end of file\n--- a/y\n+++ b/y\n@@ -3,2 +3,0 @@\n--- header like\n-b\n"
    rows = parse(many)
    assert [(r[0], r[3], r[4], r[5], r[6]) for r in rows] == [(0, "x", "context", 1, 1), (0, "x", "added", None, 2), (0, "x", "added", None, 11), (0, "x", "added", None, 12), (1, "y", "removed", 3, None), (1, "y", "removed", 4, None)]
    with pytest.raises(ValueError):
        parse("nothing")


def test_diffs_without_header_are_empty(spark):
    d = spark.createDataFrame([("a", "nothing"), ("b", None)], "diff_id string, text string")
    assert parse_diffs(d).count() == 0
    with pytest.raises(Exception):
        parse_diffs(d, strict=True).collect()


def test_rust():
    f = analyze("rust", "src/a.rs", "use crate::b::{f, g as h, self};\nuse super::z::*;\nstruct S;\nimpl S {\n    fn m(&self) { f(1); self.k(); b::foo::<u8>(2) }\n}\nfn top() {\n    println!(\"{}\", f());\n    h('x');\n}\n")
    assert [(s.name, s.kind, s.start_line, s.end_line) for s in f.symbols] == [("S", "struct", 3, 3), ("m", "method", 5, 5), ("top", "function", 7, 10)]
    assert [tuple(r) for r in f.refs] == [("f", 5, None, False), ("k", 5, None, True), ("foo", 5, "b", False), ("h", 9, None, False)]
    assert ("alias", "h", "crate::b::g") in f.imports and ("glob", "super::z", "super::z") in f.imports


def test_go_masks_comments_and_knows_aliases():
    f = analyze("go", "x.go", 'package x\nimport f "fmt"\nfunc (s *S) M() {\n\t// gone()\n\tf.Println("call()")\n\ts.k.Run()\n\tmake(x)\n}\n')
    assert {(r.name, r.qualifier, r.is_method) for r in f.refs} == {("Println", "f", False), ("Run", "s.k", True)}
    assert [(s.name, s.kind) for s in f.symbols] == [("M", "method")]


def test_java_this_inference_and_method_references():
    f = analyze("java", "A.java", "import a.b.C;\nclass A {\n  void init() { C.go(); list.map(A::run); other(); run(); }\n  int run() {\n    return 1;\n  }\n}\n")
    got = {(r.name, r.qualifier, r.is_method) for r in f.refs}
    assert {("go", "C", False), ("map", "list", True), ("run", "A", False), ("other", None, False), ("run", None, False), ("run", "this", True)} == got


def test_python_dynamic_references():
    f = analyze("python", "p/a.py", "from .r import s as t\n@t\ndef f(a):\n    n = 'go'\n    getattr(a, n)()\n    return a.b(t())\n\nclass C:\n    def g(self):\n        pass\n")
    assert {("go", 5), ("t", 3), ("b", 6), ("t", 6)} <= {(r.name, r.line) for r in f.refs}
    assert [(s.name, s.kind, s.start_line, s.end_line) for s in f.symbols][0] == ("f", "function", 3, 7)
    assert ("alias", "t", "p::r::s") in f.imports
    assert names(analyze("python", "b.py", "def f(:\n  g(1)\n").refs) == {"g"}


def test_typescript_exports_and_members():
    f = analyze("typescript", "src/m.ts", "import d, {a as b} from './x';\nexport { q as r } from './w';\nexport * from './v';\nclass K {\n  private m(x: string): number { return b(); }\n  fld = () => { d(); };\n}\ninterface I {\n  p(x: number): void;\n}\n")
    assert {(s.name, s.kind) for s in f.symbols} == {("K", "struct"), ("m", "method"), ("fld", "method"), ("I", "trait"), ("p", "method")}
    assert {("alias", "b", "src::x::a"), ("alias", "d", "src::x::default"), ("export", "r", "src::w::q"), ("export_glob", "src::v", "src::v")} <= set(map(tuple, f.imports))


def test_ruby_ends_and_sends():
    f = analyze("ruby", "lib/a.rb", "require_relative './b'\nclass A\n  def f(x)\n    if x\n      g(x)\n    end\n    n = :go\n    send(n)\n  end\n  define_method(:dyn) { }\nend\n")
    assert [(s.name, s.start_line, s.end_line) for s in f.symbols] == [("A", 2, 11), ("f", 3, 9), ("dyn", 10, 10)]
    assert names(f.refs) == {"g", "go"} and f.imports[0].target == "lib::b"


def test_reexport_chain_end_to_end(spark):
    e = Engine(spark, files(spark, [("src/c.ts", "export function f() {\n  return 1;\n}\n"), ("src/b.ts", "export { f } from './c';\n"), ("src/a.ts", "export { f as g } from './b';\n"), ("src/main.ts", "import { g } from './a';\nfunction run() {\n  return g();\n}\n"), ("src/other.ts", "export function g() {\n  return 2;\n}\n")]))
    assert [(r["src"], r["dst"]) for r in e.calls.collect()] == [("typescript:src/main.ts:fn:run:2", "typescript:src/c.ts:fn:f:1")]
    text = "--- a/src/c.ts\n+++ b/src/c.ts\n@@ -2 +2 @@\n-  return 0;\n+  return 1;\n"
    report = e.impact_of(e.diff(text), ImpactOptions(with_edges=True), witnesses=True)
    assert [r["name"] for r in report.changed.collect()] == ["f"] and [r["name"] for r in report.impacted.collect()] == ["run"]
    assert report.edges.count() == 1 and report.witnesses.first()["via_symbol_id"].endswith("f:1")
    assert [r["name"] for r in e.ids(path="main.ts", name="nothing").collect()] == ["run"]


def test_python_alias_and_method_scores(spark):
    e = Engine(spark, files(spark, [("p/m.py", "class A:\n    def go(self):\n        pass\n"), ("p/n.py", "def go():\n    pass\n"), ("p/u.py", "from p.n import go as run\n\ndef f(a):\n    run()\n    a.go()\n")]))
    assert {(r["src"].split(":")[3], r["dst"]) for r in e.calls.collect()} == {("f", "python:p/n.py:fn:go:1"), ("f", "python:p/m.py:method:go:2")}


RUST = [("src/lib.rs", "fn callee(a: i32, b: i32) -> i32 {\n    let r = b;\n    r\n}\nfn caller() -> i32 {\n    let x = 1;\n    let y = 2;\n    let out = callee(x, y);\n    out\n}\n")]


def test_propagation_binds_by_position(spark):
    e = Engine(spark, files(spark, RUST))
    got = {(r["src"].removeprefix("src/lib.rs:"), r["dst"].removeprefix("src/lib.rs:")) for r in e.dependence(True).where("provenance = 'symbolic_propagation'").collect()}
    assert ("use:y:8", "def:out:8") in got and ("use:x:8", "def:out:8") not in got


def test_tail_evidence(spark):
    f = files(spark, RUST)
    tokens = dataflow.token_table(f)
    node = dataflow.nodes(tokens)
    s = code.symbols(f)
    _, flows = dataflow.summaries(s, node, dataflow.edges(tokens))
    rows = {r["function_id"]: r["param_flows"] for r in dataflow.tail_evidence(s, flows, node, tokens).collect()}
    assert rows == {"rust:src/lib.rs:fn:callee:1": 1}


def test_slice_plan(spark):
    text = [("a.rs", "fn seed() -> i32 {\n    1\n}\n"), ("wrapper.rs", "fn wrapper() -> i32 {\n    noise();\n    seed()\n}\n"), ("main.rs", "fn source_main() -> i32 {\n    wrapper()\n}\n"), ("helper.rs", "fn helper() -> i32 {\n    wrapper()\n}\n")]
    e = Engine(spark, files(spark, text))
    q = spark.createDataFrame([("q", "rust:a.rs:fn:seed:1")], "seed_id string, node string")
    chosen, pruned = slicing.plan_slice(e.calls, q, e.symbols)
    assert {(r["path"], r["tier"]) for r in chosen.collect()} == {("a.rs", 0), ("wrapper.rs", 1), ("main.rs", 2)}
    assert [(r["path"], r["prune_reason"]) for r in pruned.collect()] == [("helper.rs", "suppressed_before_admit")]
    report = e.impact(q, pdg=True)
    assert {r["name"] for r in report.impacted.collect()} == {"wrapper", "source_main", "helper"}


def test_ruby_fallback(spark):
    f = files(spark, [("lib/a.rb", "require_relative './b'\ndef entry\n  send(:work)\nend\n"), ("lib/b.rb", "def work\n  1\nend\ndef rest\n  2\nend\n")])
    s, r, i = code.extract(f)
    near = spark.createDataFrame([("q", "ruby:lib/a.rb:method:entry:2", "lib/a.rb")], "seed_id string, via string, via_file string")
    assert [x["id"] for x in slicing.ruby_fallback(near, i, r, s).collect()] == ["ruby:lib/b.rb:method:work:1"]


def test_supported_sibling_goes_first():
    common = {"prune_reason": None, "lane": "return", "via": "v", "via_file": "w.rs", "bridge_kind": "wrapper_return", "family": "return", "primary_evidence": ["return_flow"], "secondary_evidence": [], "noisy": False, "source_rank": 0, "lane_rank": 0, "primary_evidence_count": 1, "negative_evidence_count": 0, "secondary_evidence_count": 0, "call_position_rank": 1}
    a = common | {"id": "b", "file": "b.rs", "semantic_support_rank": 3, "lexical_tiebreak": "b"}
    b = common | {"id": "a", "file": "a.rs", "semantic_support_rank": 0, "lexical_tiebreak": "a"}
    assert slicing.compare(a, b) == -1
    alias = common | {"id": "c", "file": "c.rb", "lane": "alias", "primary_evidence": ["alias_chain", "assigned_result"], "lane_rank": 1, "semantic_support_rank": 0, "lexical_tiebreak": "c"}
    assert slicing.compare(alias, b) == -1 and slicing.compare(b, alias) == 1


def test_explanations(spark):
    scoring = "struct<source_rank:int,lane_rank:int,primary_evidence_count:int,negative_evidence_count:int,semantic_support_rank:int,secondary_evidence_count:int,call_position_rank:int,lexical_tiebreak:string>"
    ddl = f"seed_id string, via string, path string, primary_evidence array<string>, scoring {scoring}"
    a = spark.createDataFrame([("q", "v", "good.rs", ["return_flow"], (0, 0, 2, 0, 0, 1, 3, "a"))], ddl)
    b = spark.createDataFrame([("q", "v", "bad.rs", ["assigned_result"], (0, 0, 1, 0, 0, 1, 3, "b"))], ddl).withColumn("prune_reason", F.lit("ranked_out"))
    r = explain.selected_vs_pruned(a, b).first()
    assert r["better_by"] == "primary_evidence_count" and r["winning_evidence"] == ["return_flow"] and "good.rs was chosen over bad.rs" in r["summary"]
    s = spark.createDataFrame([("q", "a.rs", 1, "direct_caller", "x", None), ("q", "b.rs", 2, "bridge_completion_file", "x", "wrapper_return")], "seed_id string, path string, tier int, reason string, via string, bridge_kind string")
    r = explain.bridge_chain(s).first()
    assert [x["step"] for x in r["steps"]] == ["callsite_input_binding", "summary_return_bridge"] and r["family"] == "return"
    w = spark.createDataFrame([("q", "rust:b.rs:fn:t:1", [("rust:a.rs:fn:s:1", "rust:b.rs:fn:t:1", "b.rs")])], "seed_id string, symbol_id string, path array<struct<src:string,dst:string,file:string>>")
    assert [x["path"] for x in explain.slice_context(w, s).first()["slice_context"]] == ["a.rs", "b.rs"]


def test_labels(spark):
    row = spark.range(1).select(ranking.shorten(F.array(*map(F.lit, "abcd"))).alias("x"), ranking.shorten(F.array(F.lit("a"))).alias("y")).first()
    assert tuple(row) == ("a, b (+2 more)", "a")


def test_store_delta_equals_rebuild(spark, tmp_path):
    before = [("a.py", "def f():\n    return g()\n"), ("b.py", "def g():\n    return 1\n"), ("gone.py", "def h():\n    return g()\n")]
    after = [("a.py", "def f():\n    return g()\n"), ("b.py", "\n\ndef g():\n    return 2\n"), ("new.py", "def k():\n    return f()\n")]
    one, two = Store(spark, f"{tmp_path}/one"), Store(spark, f"{tmp_path}/two")
    one.build(files(spark, before), code.extract)
    changed = {(r["path"], r["status"]) for r in one.update(files(spark, after), code.extract).collect()}
    assert changed == {("b.py", "changed"), ("gone.py", "gone"), ("new.py", "new")}
    two.build(files(spark, after), code.extract)
    for t in ("symbols", "edges", "imports"):
        assert sorted(map(tuple, one.read(t).collect())) == sorted(map(tuple, two.read(t).collect()))
    assert one.verify(files(spark, after)).count() == 0 and tuple(one.stats().first()) == (3, 3, 2)
    one.clear()
    with pytest.raises(Exception):
        one.read("files")


def test_workspace(spark, tmp_path):
    for p in ("src/a.py", "node_modules/b.py", ".git/c.py", "src/d.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert [(r["path"], r["language"]) for r in code.workspace(spark, str(tmp_path)).collect()] == [("src/a.py", "python")]


def test_seeds(spark):
    rows = seeds.from_json(spark, '["rust:a.rs:fn:f:3", {"id": "go:b.go:method:m:1"}, {"lang": "ruby", "path": "c.rb", "kind": "function", "name": "k", "line": 2}]').collect()
    assert [r["node"] for r in rows] == ["rust:a.rs:fn:f:3", "go:b.go:method:m:1", "ruby:c.rb:fn:k:2"]
    with pytest.raises(Exception, match="bad seed"):
        seeds.literals(spark.createDataFrame([("x:y",)], "seed string")).collect()
    odd = spark.createDataFrame([("rust:a:b.rs:fn:f:3",)], "s string").select(parse_id(F.col("s")).alias("p")).first()["p"]
    assert odd["file"] == "a:b.rs"


def test_paths(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert one(paths.module_path(F.lit("./src/a/mod.rs"))) == "src::a" and one(paths.module_path(F.lit("mod.rs"))) == "mod"
    assert one(paths.expand_relative(F.lit("a::b"), F.lit("super::super::c"))) == "a::c"
    assert one(paths.expand_relative(F.lit("a::b"), F.lit("crate::c"))) == "c" and one(paths.expand_relative(F.lit("a"), F.lit("self::c"))) == "a::c"
    assert one(paths.normalise(F.lit("a/./b/../c"))) == "a/c" and one(paths.normalise(F.lit("../a"))) == "../a"
    assert one(paths.resolve_specifier(F.lit("src/m.ts"), F.lit("../y/z.js"))) == "y::z"
    assert one(paths.file_matches(F.lit("x/foo/index.ts"), F.lit("foo"))) and not one(paths.file_matches(F.lit("x/foo.c"), F.lit("foo")))
    assert one(paths.module_label(F.lit("main.rs"))) == "(root)" and one(paths.module_label(F.lit("x.rs"))) == "x.rs" and one(paths.module_label(F.lit("a/b/x.rs"))) == "a/b"
    assert one(paths.snake_case(F.lit("FooBar::HTMLPage"))) == "foo_bar/html_page"


def test_stream(spark, tmp_path):
    e = Engine(spark, files(spark, [("a.py", "def f():\n    return g()\n"), ("b.py", "def g():\n    return 1\n")]))
    text = "--- a/b.py\n+++ b/b.py\n@@ -2 +2 @@\n-    return 0\n+    return 1\n"
    spark.createDataFrame([("d1", text)], "diff_id string, text string").write.parquet(f"{tmp_path}/in")
    q = impact_stream(e, spark.readStream.schema("diff_id string, text string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert [(r["seed_id"], r["name"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("d1", "f")]


def test_reports():
    assert render.to_yaml({"a": [1, {"b": "x y"}], "c": {}}) == 'a:\n  - 1\n  - b: "x y"\nc: {}'
    text = render.dot([{"id": 'a"', "role": "changed"}], [{"src": 'a"', "dst": "b", "kind": "control"}], [('a"', "b")])
    assert "#fee" in text and "dashed" in text and "red" in text and '\\"' in text
    page = render.html({"changed_symbols": [{"id": "<x>", "name": "</script>"}]})
    assert "&lt;x&gt;" in page and "</script></td>" not in page
    with pytest.raises(ValueError):
        render.check_format("diff", "dot")


def test_contracts():
    assert len(contracts.names()) == 15
    assert contracts.resolve("impact", with_edges=True, with_pdg=True, with_propagation=True) == "impact/default/with_edges/propagation"
    assert contracts.get("diff")["schema"]["fields"][0]["name"] == "diff_id"
    with pytest.raises(ValueError):
        contracts.resolve("id", raw=True)
    with pytest.raises(KeyError):
        contracts.get("nothing")


def test_extraction_parses_files_once(spark):
    rows = files(spark, [("a/x.py", "from b import g as h\ndef f():\n    h()\n    q.k()\n"), ("b.ts", "export { z } from './c';\nfunction g() { f(); }\n"), ("c.rs", ""), ("e.go", None)])
    apart = code.symbols(rows), code.refs(rows), code.imports(rows)
    for one, alone in zip(code.extract(rows), apart):
        assert one.columns == alone.columns and sorted(map(str, one.collect())) == sorted(map(str, alone.collect())) != []
        assert "MapInPandas" not in one._jdf.queryExecution().toString()  # read back, not parsed again
