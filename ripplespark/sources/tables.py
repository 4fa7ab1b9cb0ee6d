"""The driver's tables as the engine's relations: parts are symbols, neighbours within an order are edges.

Each adapter has its SQL twin (a chain of common table expressions) beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..work import spread

KIND_OF = ("function", "method", "struct", "enum", "trait", "module")
EXT_OF = (".rs", ".rb", ".py", ".js", ".ts", ".go", ".java", "/mod.rs")
LANG_OF = ("rust", "ruby", "python", "javascript", "typescript", "go", "java", "rust")


def _choose(by: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))


def _case(by: str, names: tuple[str, ...]) -> str:
    return f"CASE {by} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file() -> Column:
    return F.concat(F.translate("p_brand", "#", "_"), F.lit("/"), "p_type", _choose(F.col("p_size"), EXT_OF))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    size, start = F.col("p_size"), (F.col("p_partkey") % 100 + 1).cast("int")
    return p.select(
        F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        _choose(size, KIND_OF).alias("kind"),
        _file().alias("file"),
        start.alias("start_line"),
        (start + size).cast("int").alias("end_line"),
        _choose(size, LANG_OF).alias("language"),
    )


SYMBOLS_SQL = f"""symbols AS (
  SELECT 'p:' || p_partkey AS id, p_name AS name, {_case("p_size", KIND_OF)} AS kind,
         replace(p_brand, '#', '_') || '/' || p_type || {_case("p_size", EXT_OF)} AS file,
         CAST(p_partkey % 100 + 1 AS INTEGER) AS start_line, CAST(p_partkey % 100 + 1 + p_size AS INTEGER) AS end_line, {_case("p_size", LANG_OF)} AS language
  FROM part)"""

CERT_OF = ("confirmed", "inferred", "dynamic_fallback")
PROV_OF = ("call_graph", "local_dfg", "call_graph", "symbolic_propagation", "call_graph")
REF_OF = ("call", "data", "call", "control")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of parts on neighbouring lines of an order; the least supplier decides an edge's attributes."""
    over = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    l = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    l = l.select("l_partkey", "l_suppkey", F.lead("l_partkey").over(over).alias("b")).where("b IS NOT NULL")
    # parted and joined by the number: the pairs need no second shuffle to meet their file
    e = spread(l, "l_partkey").groupBy("l_partkey", "b").agg(F.min("l_suppkey").alias("s"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), _file().alias("file"))
    return e.join(p, "l_partkey").select(
        F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("p:"), F.col("b").cast("string")).alias("dst"),
        _choose(F.col("s"), REF_OF).alias("kind"),
        "file",
        (F.col("s") % 100 + 1).cast("int").alias("line"),
        _choose(F.col("s"), CERT_OF).alias("certainty"),
        _choose(F.col("s"), PROV_OF).alias("provenance"),
    )


EDGES_SQL = f"""{SYMBOLS_SQL},
pairs AS (SELECT l_partkey AS a, l_suppkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem),
edges AS (
  SELECT 'p:' || a AS src, 'p:' || b AS dst, {_case("s", REF_OF)} AS kind, file, CAST(s % 100 + 1 AS INTEGER) AS line,
         {_case("s", CERT_OF)} AS certainty, {_case("s", PROV_OF)} AS provenance
  FROM (SELECT a, b, min(s) AS s FROM pairs WHERE b IS NOT NULL GROUP BY a, b) JOIN symbols ON id = 'p:' || a)"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of each brand: ``seed_id`` (brand) and ``node``."""
    p = read(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("seed_id")).agg(F.min("p_partkey").alias("k")).select("seed_id", F.concat(F.lit("p:"), F.col("k").cast("string")).alias("node"))


SEEDS_SQL = "seeds AS (SELECT p_brand AS seed_id, 'p:' || min(p_partkey) AS node FROM part GROUP BY p_brand)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: ``doc_id``, ``line`` (from 1), ``content``, ``first`` word."""
    d = read(spark, sf_dir, "documents")
    out = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "content"))
    return out.select("doc_id", (F.col("p") + 1).cast("int").alias("line"), "content", F.split(F.col("content"), " ")[0].alias("first"))


LINES_SQL = r"""raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, CAST(i AS INTEGER) AS line, ls[i] AS content, string_split(ls[i], ' ')[1] AS first FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw))"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files that order items touch: ``diff_id``, ``file``, ``line``."""
    l = read(spark, sf_dir, "lineitem")
    s = symbols(spark, sf_dir).select("id", "file")
    return l.join(s, F.concat(F.lit("p:"), F.col("l_partkey").cast("string")) == F.col("id")).select(F.col("l_returnflag").alias("diff_id"), "file", (F.col("l_suppkey") % 150 + 1).cast("int").alias("line")).distinct()


SITES_SQL = f"{SYMBOLS_SQL}, sites AS (SELECT DISTINCT l_returnflag AS diff_id, file, CAST(l_suppkey % 150 + 1 AS INTEGER) AS line FROM lineitem JOIN symbols ON id = 'p:' || l_partkey)"
