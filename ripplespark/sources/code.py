"""Source files as tables, and what analyzers extract from them on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EXTENSIONS, IMPORTS, KINDS, SYMBOLS
from ..work import cut

SKIPPED = (".git", "target", "node_modules")


def language_of(path: str = "path"):
    """The language of a path by its extension; null for others."""
    ext = F.regexp_extract(F.col(path), r"\.([A-Za-z]+)$", 1)
    out = None
    for e, name in EXTENSIONS.items():
        out = F.when(ext == e, name) if out is None else out.when(ext == e, name)
    return out


def workspace(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIPPED, hidden: bool = False, language: str | None = None) -> DataFrame:
    """Files below a folder: ``path`` (relative), ``content``, ``language``, ``mtime``. Folders of ``skip`` and, unless ``hidden``, dot folders are left out.

    ``language`` overrides the extension's.
    """
    at = root.rstrip("/")
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    rows = read.text(at).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("full"), F.col("_metadata.file_modification_time").cast("long").alias("mtime"))
    here = f"{at.removeprefix('file://')}/"
    path = F.substring_index(F.url_decode("full"), here, -1)
    parts = F.split("path", "/")
    rows = rows.select(path.alias("path"), "content", "mtime")
    keep = ~F.exists(parts, lambda x: x.isin(*skip))
    if not hidden:
        keep = keep & ~F.exists(parts, lambda x: x.startswith("."))
    found = F.lit(language) if language else language_of()
    return rows.where(keep).withColumn("language", found).where("language IS NOT NULL")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files`` (path, content, language)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..extract import analyze

        for pdf in parts:
            rows = []
            for path, text, lang in zip(pdf["path"], pdf["content"], pdf["language"]):
                for s in analyze(lang, path, text or "").symbols:
                    rows.append((f"{lang}:{path}:{KINDS[s.kind]}:{s.name}:{s.start_line}", s.name, s.kind, path, s.start_line, s.end_line, lang))
            yield _frame(rows, SYMBOLS)

    return files.select("path", "content", "language").mapInPandas(run, SYMBOLS)


REFS = "file string, nth int, name string, kind string, line int, qualifier string, is_method boolean"


def refs(files: DataFrame) -> DataFrame:
    """Call references of ``files``; ``ref_id`` is a hash of place and name."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..extract import analyze

        for pdf in parts:
            rows = []
            for path, text, lang in zip(pdf["path"], pdf["content"], pdf["language"]):
                rows += [(path, i, r.name, "call", r.line, r.qualifier, r.is_method) for i, r in enumerate(analyze(lang, path, text or "").refs)]
            yield _frame(rows, REFS)

    found = files.select("path", "content", "language").mapInPandas(run, REFS)
    return found.select(F.xxhash64("file", "nth").alias("ref_id"), "name", "kind", "file", "line", "qualifier", "is_method")


def imports(files: DataFrame) -> DataFrame:
    """Imports, globs and re-exports of ``files``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..extract import analyze

        for pdf in parts:
            rows = []
            for path, text, lang in zip(pdf["path"], pdf["content"], pdf["language"]):
                rows += [(path, *i) for i in analyze(lang, path, text or "").imports]
            yield _frame(rows, IMPORTS)

    return files.select("path", "content", "language").mapInPandas(run, IMPORTS)


#: Files of a task, so that few large groups of files don't keep cores idle.
FILES = 256


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, references and imports, for which each file is parsed once and its rows are written once."""
    parts = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..extract import analyze

        for pdf in pdfs:
            rows = []
            for path, text, lang in zip(pdf["path"], pdf["content"], pdf["language"]):
                got = analyze(lang, path, text or "")
                rows += [(0, f"{lang}:{path}:{KINDS[s.kind]}:{s.name}:{s.start_line}", s.name, s.kind, path, s.start_line, s.end_line, lang, None, None) for s in got.symbols]
                rows += [(1, r.qualifier, r.name, "call", path, r.line, i, None, r.is_method, None) for i, r in enumerate(got.refs)]
                rows += [(2, i[1], None, i[0], path, 0, 0, None, None, i[2]) for i in got.imports]
            yield _frame(rows, TAGGED)

    all_ = cut(files.select("path", "content", "language").repartition(parts).mapInPandas(run, TAGGED), "extracted")
    a = all_.where("tag = 0").select("id", "name", "kind", "file", F.col("a").alias("start_line"), F.col("b").alias("end_line"), "language")
    r = all_.where("tag = 1").select(F.xxhash64("file", F.col("b")).alias("ref_id"), "name", "kind", "file", F.col("a").alias("line"), F.col("id").alias("qualifier"), "is_method")
    i = all_.where("tag = 2").select("file", F.col("kind").alias("entry_type"), F.col("id").alias("key"), "target")
    return a, r, i


#: Rows of all three: ``a`` and ``b`` are the lines of a symbol, or the line of a reference and its number in the file.
TAGGED = "tag int, id string, name string, kind string, file string, a int, b int, language string, is_method boolean, target string"
