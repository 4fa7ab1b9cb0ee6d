"""Registered queries over source text and diffs.

The driver's tables hold no code, so parts are written out as small functions
that call one another (a file for each brand and thousand part numbers) and
suppliers as diffs; the SQL gives the rows that analysis must find in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import dataflow, resolve
from .sources import code, diff
from .sources.tables import read
from .streaming.diffs import change_counts
from .work import cut

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return add


#: Language, extension, header with {b}, header lines, function with {k} and {n}, function lines, kind.
LANGS = (
    ("python", "py", "import lib.h{b} as q", 1, "def f{k}():\n    return f{n}()", 2, "function"),
    ("go", "go", 'package m\nimport q "lib/h{b}"', 2, "func f{k}() int {{\n\treturn f{n}()\n}}", 3, "function"),
    ("rust", "rs", "use lib::h{b} as q;", 1, "fn f{k}() -> i32 {{\n    f{n}()\n}}", 3, "function"),
    ("ruby", "rb", "require 'lib/h{b}'", 1, "def f{k}\n  f{n}()\nend", 3, "method"),
    ("javascript", "js", "import q from 'lib/h{b}';", 1, "function f{k}() {{\n  return f{n}();\n}}", 3, "function"),
    ("java", "java", "import lib.h{b};\nclass K {{", 2, "  int f{k}() {{\n    return f{n}();\n  }}", 3, "method"),
    ("typescript", "ts", "import {{ z as q }} from 'lib/h{b}';", 1, "const f{k} = (): number => {{\n  return f{n}();\n}};", 3, "function"),
)


def _fill(template: str, **parts: F.Column) -> F.Column:
    """A template's text with columns in its places; doubled braces are single ones."""
    pieces, rest = [], template
    while rest:
        at = min((i for i in (rest.find("{" + k + "}") for k in parts) if i >= 0), default=-1)
        text = rest if at < 0 else rest[:at]
        if text:
            pieces.append(F.lit(text.replace("{{", "{").replace("}}", "}")))
        if at < 0:
            break
        key = rest[at + 1 : rest.index("}", at)]
        pieces.append(parts[key].cast("string"))
        rest = rest[at + len(key) + 2 :]
    return F.concat(*pieces)


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of about forty functions each; a function calls the next of its file, the last the first."""
    p = read(spark, d, "part").select("p_partkey", "p_brand", F.floor(F.col("p_partkey") / 1000).alias("b"))
    key = Window.partitionBy("p_brand", "b")
    n = F.coalesce(F.lead("p_partkey").over(key.orderBy("p_partkey")), F.min("p_partkey").over(key))
    lang = (F.col("b") + F.length("p_brand") + F.substring_index("p_brand", "#", -1).cast("int")) % len(LANGS)
    rows = p.withColumns({"n": n, "lang": lang})
    body = head = path = name = None
    for i, (language, ext, header, _, function, _, _) in enumerate(LANGS):
        pick = F.col("lang") == i
        parts = (_fill(function, k=F.col("p_partkey"), n=F.col("n")), _fill(header, b=F.col("b")), F.concat(F.translate("p_brand", "#", "_"), F.lit("/m"), F.col("b").cast("string"), F.lit(f".{ext}")), F.lit(language))
        body, head, path, name = (F.when(pick, x) if old is None else old.when(pick, x) for old, x in zip((body, head, path, name), parts))
    rows = rows.select("p_partkey", body.alias("body"), head.alias("head"), path.alias("path"), name.alias("language"))
    group = rows.groupBy("path", "language", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "body"))), lambda x: x["body"]).alias("fs"))
    end = F.when(F.col("language") == "java", F.lit("\n}\n")).otherwise(F.lit("\n"))
    return group.select("path", "language", F.concat("head", F.lit("\n"), F.array_join("fs", "\n"), end).alias("content"))


def _case(values: list) -> str:
    return "CASE lang " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


FILES_SQL = f"""base AS (SELECT p_partkey AS k, p_brand, p_partkey // 1000 AS b, (p_partkey // 1000 + length(p_brand) + CAST(split_part(p_brand, '#', 2) AS INTEGER)) % {len(LANGS)} AS lang FROM part),
fn AS (SELECT *, row_number() OVER w AS i, coalesce(lead(k) OVER w, min(k) OVER (PARTITION BY p_brand, b)) AS n, replace(p_brand, '#', '_') || '/m' || b || '.' || {_case([x[1] for x in LANGS])} AS file,
{_case([x[0] for x in LANGS])} AS language, {_case([x[6] for x in LANGS])} AS kind, {_case([x[3] for x in LANGS])} AS h, {_case([x[5] for x in LANGS])} AS c FROM base WINDOW w AS (PARTITION BY p_brand, b ORDER BY k)),
sym AS (SELECT 'f' || k AS name, kind, file, (h + (i - 1) * c + 1)::INTEGER AS start_line, (h + i * c)::INTEGER AS end_line, language, n,
  language || ':' || file || ':' || CASE kind WHEN 'function' THEN 'fn' ELSE 'method' END || ':f' || k || ':' || (h + (i - 1) * c + 1)::INTEGER AS id FROM fn)"""


@query(
    f"""WITH {FILES_SQL} SELECT id, name, kind, file, start_line, CASE WHEN language = 'python' THEN CASE WHEN end_line = max(end_line) OVER (PARTITION BY file) THEN end_line + 1 ELSE end_line END ELSE end_line END AS end_line, language FROM sym
UNION ALL SELECT 'java:' || file || ':struct:K:2', 'K', 'struct', file, 2, (2 + count(*) * 3 + 1)::INTEGER, language FROM sym WHERE language = 'java' GROUP BY file, language"""
)
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    return code.symbols(source_files(spark, d))


@query(
    f"""WITH {FILES_SQL} SELECT 'f' || n AS name, file, start_line + 1 AS line, '' AS qualifier, language = 'ruby' AS is_method FROM sym
UNION ALL SELECT 'f' || n, file, start_line + 1, 'this', TRUE FROM sym WHERE language = 'java'"""
)
def code_refs(spark: SparkSession, d: str) -> DataFrame:
    return code.refs(source_files(spark, d)).select("name", "file", "line", F.coalesce("qualifier", F.lit("")).alias("qualifier"), "is_method")


@query(
    f"""WITH {FILES_SQL}, f AS (SELECT DISTINCT file, language, 'lib::h' || b AS m FROM fn) SELECT file, 'alias' AS entry_type, CASE WHEN language = 'java' THEN replace(m, 'lib::', '') ELSE 'q' END AS key,
CASE language WHEN 'javascript' THEN m || '::default' WHEN 'typescript' THEN m || '::z' ELSE m END AS target FROM f WHERE language <> 'ruby'
UNION ALL SELECT file, 'glob', m, m FROM f WHERE language IN ('python', 'ruby', 'javascript', 'typescript') UNION ALL SELECT file, 'glob', m || '/index', m || '::index' FROM f WHERE language IN ('javascript', 'typescript')"""
)
def code_imports(spark: SparkSession, d: str) -> DataFrame:
    return code.imports(source_files(spark, d))


@query(f"WITH {FILES_SQL} SELECT DISTINCT a.id AS src, b.id AS dst, a.file, a.start_line + 1 AS line FROM sym a JOIN sym b ON b.name = 'f' || a.n")
def code_edges(spark: SparkSession, d: str) -> DataFrame:
    symbols, refs, imports = code.extract(cut(source_files(spark, d), "sources"))
    found = resolve.resolve(refs, imports, symbols)
    return found.select("src", "dst", "file", "line").distinct()


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    k, a = F.col("s_suppkey"), F.col("s_suppkey") % 50 + 1
    text = _fill("diff --git a/s{k}.rs b/s{k}.rs\n--- a/s{k}.rs\n+++ b/s{k}.rs\n@@ -{a},2 +{a},3 @@ fn x\n ctx{k}\n-old{k}\n+new{k}\n+more\n\\ No newline at end of file", k=k, a=a)
    return s.select(k.cast("string").alias("diff_id"), text.alias("text"))


DIFF_SQL = """WITH s AS (SELECT s_suppkey AS k, (s_suppkey % 50 + 1)::INTEGER AS a FROM supplier), r AS (
SELECT k, a, 0 AS o, 'context' AS kind, a AS ol, a AS nl, 'ctx' || k AS content FROM s UNION ALL SELECT k, a, 1, 'removed', a + 1, 0, 'old' || k FROM s
UNION ALL SELECT k, a, 2, 'added', 0, a + 1, 'new' || k FROM s UNION ALL SELECT k, a, 3, 'added', 0, a + 2, 'more' FROM s)
SELECT k::VARCHAR AS diff_id, 0 AS file_ord, o::INTEGER AS line_ord, 's' || k || '.rs' AS old_path, 's' || k || '.rs' AS new_path, kind, ol::INTEGER AS old_line, nl::INTEGER AS new_line, content FROM r"""


@query(DIFF_SQL)
def diff_parse(spark: SparkSession, d: str) -> DataFrame:
    return diff.parse_diffs(_diffs(spark, d)).na.fill(0, ["old_line", "new_line"])


@query(DIFF_SQL)
def diff_parse_windows(spark: SparkSession, d: str) -> DataFrame:
    lines = _diffs(spark, d).select("diff_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return diff.parse_lines(lines).na.fill(0, ["old_line", "new_line"])


def _rust(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    text = _fill("fn g{k}(a: i32) -> i32 {{\n    let b = a;\n    if b > 1 {{\n        b = 2;\n    }}\n    let c = b + a;\n    c\n}}\n", k=F.col("s_suppkey"))
    return s.select(F.concat(F.lit("g"), F.col("s_suppkey").cast("string"), F.lit(".rs")).alias("path"), F.lit("rust").alias("language"), text.alias("content"))


FLOW = [
    ("def:a:1", "use:a:2", "data"),
    ("def:a:1", "use:a:6", "data"),
    ("def:b:2", "use:b:3", "data"),
    ("def:b:2", "use:b:6", "data"),
    ("def:b:4", "use:b:6", "data"),
    ("def:c:6", "use:c:7", "data"),
    ("def:a:1", "def:b:2", "data"),
    ("ctrl:3:5", "use:b:3", "control"),
    ("ctrl:3:5", "def:b:4", "control"),
]
FLOW_SQL = "SELECT 'g' || s_suppkey || '.rs:' || a AS src, 'g' || s_suppkey || '.rs:' || b AS dst, kind FROM supplier, (VALUES " + ", ".join(map(str, FLOW)) + ") t(a, b, kind)"


@query(FLOW_SQL)
def dataflow_edges(spark: SparkSession, d: str) -> DataFrame:
    return dataflow.edges(dataflow.token_table(_rust(spark, d)))


@query("SELECT 'rust:g' || s_suppkey || '.rs:fn:g' || s_suppkey || ':1' AS function_id, 0 AS input_ord, 'g' || s_suppkey || '.rs:def:a:1' AS input_id, 'g' || s_suppkey || '.rs:' || x AS impacted_id FROM supplier, (SELECT unnest(['use:a:2', 'use:a:6', 'def:b:2', 'use:b:3', 'use:b:6']) AS x)")
def function_summaries(spark: SparkSession, d: str) -> DataFrame:
    files = _rust(spark, d)
    tokens = dataflow.token_table(files)
    return dataflow.summaries(code.symbols(files), dataflow.nodes(tokens), dataflow.edges(tokens))[1]


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def change_windows(spark: SparkSession, d: str) -> DataFrame:
    return change_counts(read(spark, d, "events"))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items() if sql}
