"""Helpers shared by the corpus operators: tables, work folder, key filters.

Tables that cut a plan's lineage are written to the folder that the cluster
names in ``spark.checkpoint.dir``, which every executor shares; a lost executor
therefore never loses them.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key filter: 2**23 bits are 2**17 words, however many keys there are.
FILTER_BITS = 1 << 23

#: Bytes of a batch of rows on its way to Python, where the session names no limit.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session send rows to Python in batches of about ``BATCH_BYTES``, unless it names a limit itself.

    By default a batch is 64 MB or 10,000 rows, and both the JVM, outside its heap,
    and the worker hold one or two of a task's batches at once. Rows aren't changed.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, as in
    local tests, a temporary folder is made and set on the context; a cluster,
    whose machines don't share such a folder, must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ripplespark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path under the work folder."""
    return f"{work_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the work folder, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut lineage."""
    spark = df.sparkSession
    path = new_path(spark, what)
    if _listening:
        _listening[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


_listening: list[list[str]] = []


def free(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` gave, once nothing reads them any more."""
    for t in tables:
        path = getattr(t, "cut_path", None)
        if path:
            remove_path(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are deleted at the end, where what they led to is written by then."""
    _listening.append([])
    try:
        yield
    finally:
        for path in _listening.pop():
            remove_path(spark, path)


def unused(names: Sequence[str], *wanted: str) -> list[str]:
    """The ``wanted`` column names, each made longer until it differs from all of ``names`` in whatever case."""
    have, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in have:
            w += "_"
        have.add(w.lower())
        out.append(w)
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if pa.types.is_null(kind):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    large = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)
        if (np.diff(offs) != sizes).any():  # a null may cover bytes
            parts = [data[offs[i] : offs[i] + sizes[i]] for i in range(n)]
            data = np.concatenate(parts) if parts else data[:0]
            return data, np.concatenate([[0], np.cumsum(sizes)])
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, size: int = 1 << 18):
    """Row ranges ``(first, end)`` of about ``size`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


def split_by_keys(docs: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows that may be among ``keys``, rows that surely aren't.

    The second part needs no join, so its texts are never shuffled. The first is
    a superset of the rows with a key (a bit may be shared) and goes on to an
    exact join. The filter is a table of ``FILTER_BITS / 64`` words of bits at
    most, however many keys there are, so it is safe to broadcast.
    """
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS)).cast("int")
    slot, word, bits = unused(docs.columns, "_slot", "_word", "_bits")
    words = keys.select(at.alias("a")).groupBy(F.shiftright("a", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, a & 63)")).alias(bits))
    marked = docs.withColumn(slot, at).join(F.broadcast(cut(words, "filter")), F.shiftright(slot, 6) == F.col(word), "left")
    hit = F.coalesce(F.expr(f"shiftright({bits}, {slot} & 63) & 1L") == 1, F.lit(False))
    return marked.where(hit).select(*docs.columns), marked.where(~hit).select(*docs.columns)


def drop_keys(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``keys``; only likely rows are shuffled."""
    maybe, clear = split_by_keys(docs, keys, key)
    return clear.unionByName(maybe.join(keys.select(key).distinct(), key, "left_anti").select(*docs.columns))


def numbered(table: DataFrame, order: Sequence[Column], name: str, rows: int, rows_at_once: int = 100_000) -> DataFrame:
    """``table`` (of about ``rows`` rows) with the column ``name``, the place of each row in the whole ``order`` (from 0)."""
    parts = max(1, -(-rows // rows_at_once))
    placed = table.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts > 1 else table.coalesce(1).sortWithinPartitions(*order)
    placed = cut(placed.withColumn(name, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(name, 33)
    counts = placed.groupBy(part.alias("part")).count().collect()  # a row a part
    before, seen = [], 0
    for p, n in sorted((r["part"], r["count"]) for r in counts):
        before.append(F.when(part == p, F.lit(seen)))
        seen += n
    inside = F.col(name) - F.shiftleft(part, 33)
    return placed.withColumn(name, (inside + F.coalesce(*before, F.lit(0))).cast("long"))


def edit_text(rows: DataFrame, names: Sequence[str], mark: str, edit, rows_at_once: int = 128) -> DataFrame:
    """The columns ``names`` of ``rows`` with ``text`` as ``edit(text, mark)`` makes it, where the column ``mark`` isn't null.

    A few rows are edited at a time, so a worker holds little beside the batch that it reads.
    """
    shape = rows.select(*names).schema
    at = list(names).index("text")

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(lo, rows_at_once)
                texts, marks = b.column(at).to_pylist(), b.column(len(names)).to_pylist()
                out = [t if t is None or m is None else edit(t, m) for t, m in zip(texts, marks)]
                columns = [b.column(i) for i in range(len(names))]
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, list(names))

    return rows.select(*names, mark).mapInArrow(tidy(run), shape)


def tidy(run):
    """``run`` (for ``mapInArrow``), which gives unused memory back to the system when a task ends: workers are kept and reused."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def fs_of(path: str):
    """The pyarrow file system of a URI or local path, and the path on it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        return fs.LocalFileSystem(), path[5:]
    return fs.FileSystem.from_uri(path)


def publish(path: str, data: bytes) -> None:
    """Write a file whole or not at all: a retried or doubled task can't tear it."""
    files, at = fs_of(path)
    files.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, at)
