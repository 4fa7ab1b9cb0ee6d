"""The persistent store: full build, change detection, and delta updates, as Parquet tables.

Tables: files (path, lang, digest, present), symbols, refs, imports, edges. All
edge columns are kept, and unresolved references and imports with them, so a
delta resolves exactly as a full build would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import resolve
from ..operators.summary import store_stats
from ..work import cut

TABLES = ("files", "symbols", "refs", "imports", "edges")


def digest(content: str = "content"):
    return F.sha2(F.col(content), 256)


def delta(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Paths to update: ``new``, ``changed`` (digest, language or presence differ) or ``gone``."""
    a = stored.select("path", F.col("lang").alias("_l"), F.col("digest").alias("_d"), F.col("present").alias("_p"))
    both = a.join(current.select("path", "lang", "digest"), "path", "full")
    status = (
        F.when(F.col("_p").isNull(), "new")
        .when(F.col("digest").isNull(), F.when(F.col("_p"), "gone"))
        .when((F.col("digest") != F.col("_d")) | (F.col("lang") != F.col("_l")) | ~F.col("_p"), "changed")
    )
    return both.select("path", status.alias("status")).where("status IS NOT NULL")


def replace(old: DataFrame, new: DataFrame, paths: DataFrame, column: str) -> DataFrame:
    """``old`` without rows of the paths, and the rows of ``new`` that are of those paths."""
    p = paths.select(F.col("path").alias(column)).distinct()
    return old.join(p, column, "left_anti").select(*old.columns).unionByName(new.join(p, column, "left_semi").select(*old.columns))


class Store:
    """Tables in a folder; each version is written whole beside the last, then the pointer file is replaced."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _version(self) -> str | None:
        try:
            return self.spark.read.text(f"{self.root}/current").first()[0]
        except Exception as e:  # no pointer yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def read(self, table: str) -> DataFrame:
        v = self._version()
        if v is None:
            raise FileNotFoundError(f"no store at {self.root}")
        return self.spark.read.parquet(f"{self.root}/{v}/{table}")

    def _write(self, tables: dict[str, DataFrame]) -> None:
        v = f"v{int((self._version() or 'v0')[1:]) + 1}"
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{self.root}/{v}/{name}")
        self.spark.createDataFrame([(v,)], "v string").coalesce(1).write.mode("overwrite").text(f"{self.root}/current")

    def build(self, files: DataFrame, extract) -> None:
        """Everything anew from ``files`` (path, content, language); ``extract`` gives symbols, refs, imports."""
        symbols, refs, imports = (cut(x) for x in extract(files))
        self._write({"files": self._listing(files), "symbols": symbols, "refs": refs, "imports": imports, "edges": resolve(refs, imports, symbols)})

    @staticmethod
    def _listing(files: DataFrame) -> DataFrame:
        return files.select("path", F.col("language").alias("lang"), digest().alias("digest"), F.lit(True).alias("present"))

    def update(self, files: DataFrame, extract, paths: DataFrame | None = None) -> DataFrame:
        """Bring the store up to the files; only changed ones are extracted again, or those of ``paths``. Returns what changed.

        Edges are resolved again for all references, which are stored: a change of
        one file's lines or exports moves edges of others.
        """
        found = delta(self.read("files"), self._listing(files))
        if paths is not None:
            found = found.join(paths.select("path").distinct(), "path", "left_semi")
        found = cut(found)
        changed = files.join(found.where("status <> 'gone'"), "path", "left_semi")
        fresh = dict(zip(("symbols", "refs", "imports"), extract(changed)))
        tables = {name: cut(replace(self.read(name), fresh[name], found, "file")) for name in fresh}
        gone = found.where("status = 'gone'").select("path")
        old = self.read("files")
        kept = old.join(found.select("path"), "path", "left_anti")
        left = old.join(gone, "path", "left_semi").withColumn("present", F.lit(False))
        tables["files"] = cut(kept.unionByName(left).unionByName(self._listing(changed)))
        tables["edges"] = resolve(tables["refs"], tables["imports"], tables["symbols"])
        self._write(tables)
        return found

    def verify(self, files: DataFrame) -> DataFrame:
        return delta(self.read("files"), self._listing(files))

    def stats(self) -> DataFrame:
        return store_stats(self.read("files"), self.read("symbols"), self.read("edges"))

    def clear(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
