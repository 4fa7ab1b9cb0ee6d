"""Packing by power-of-two decomposition.

A document's ids are cut into whole sequences of ``max_len`` and, for the rest,
pieces whose lengths are the binary digits of what remains, longest first. Each
piece is a sequence of its own in the bucket of its length, so no sequence
crosses documents and none is padded.

One pass over the texts; ids never leave the worker. Sequence numbers are
gapless from 0, bucket by bucket (longest first): pieces are counted by scan
partition and bucket, and those counts, not the pieces, are summed in order.

Null and empty texts have the end id alone: one piece of length 1. Repeated
rows are packed each for itself. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import blocks, cut, read_table, text_buffer, tidy

#: Bounds of a worker's token tables. Workers share an executor's memory with a JVM that
#: holds all it ever took; larger tables save few CPU seconds here.
ENTRIES, NAMES = 400_000, 20_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Lengths of a document's pieces in order: whole sequences, then the binary digits of the rest."""
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(max_len.bit_length() - 2, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, max_len: int) -> DataFrame:
    """A row per piece with its scan partition and its number among that partition's pieces of its length."""
    bits = max_len.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.encoder(tokenizer, ENTRIES, NAMES)
        part, seen = TaskContext.get().partitionId(), np.zeros(bits, np.int64)
        for b in batches:
            buf, offs = text_buffer(b.column(1))
            for lo, hi in blocks(offs):
                docs_ = b.column(0).slice(lo, hi - lo).to_pylist()
                ids, ends = enc.encode(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], end_id)
                view, first = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, end in zip(docs_, ends.tolist()):
                    n, at = end - first, 0
                    for size in piece_lengths(n, max_len):
                        out[0].append(doc)
                        out[1].append(at)
                        out[2].append(size)
                        out[3].append(zlib.crc32(view[4 * (first + at) : 4 * (first + at + size)]))
                        out[4].append(n)
                        at += size
                    first = end
                size = np.array(out[2], np.int64)
                kind = np.log2(size).astype(np.int64) if len(size) else size
                nth = np.zeros(len(size), np.int64)
                for k in np.unique(kind):
                    at_k = np.flatnonzero(kind == k)
                    nth[at_k] = seen[k] + np.arange(len(at_k))
                    seen[k] += len(at_k)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int64()) for x in out), pa.array(np.full(len(size), part, np.int32)), pa.array(nth)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"],
                )
        enc.clear()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, max_len: int = 2048) -> DataFrame:
    """Pack whole documents: a row per piece, with its sequence and its place there (always 0).

    ``docs`` has ``doc_id`` and ``text``. ``bucket`` is the length of the sequence.
    """
    found = cut(pieces(docs, tokenizer or tokens.default_path(), end_id, max_len), "pieces")
    counts = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    # at most log2(max_len)+1 rows: one a bucket
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(longer), F.lit(0)))
    starts = inside.join(F.broadcast(buckets.select("length", "base")), "length").select("length", "part", (F.col("before") + F.col("base")).alias("first"))
    return found.join(starts, ["length", "part"]).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("bucket"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 ids."""
    return pack(read_table(spark, sf_dir, "documents"))
