"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Equal texts are one key. A key's hash is its place on the ring; it belongs to
the shard of the next virtual node clockwise, and where that shard is full it
continues clockwise to the first that has room. Law: ``bytes``, shards hold
nearly equal sizes; no shard holds more than ``1 + slack`` times the mean, but
for keys too large to fit anywhere.

The ring is cut into a fixed number of cells, so what the driver decides is
bounded however many rows there are: bytes are summed by cell, and whole cells
are placed in hash order. A cell heavier than ``1/HEAVY`` of a mean shard (at
most ``HEAVY * shards`` such) is split by a second hash, so a large key is met
alone and placed first. A key larger than a shard may hold can't be kept whole:
its rows are split by a hash of ``doc_id`` into slices, which then go clockwise.

Slots are numbered in two levels: rows within small hash buckets of a shard,
after the counts of the buckets before.

A null text has size 1 and checksum 0 and is a key like any other; null
``doc_id`` and repeated rows are rows like any other. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table

CELLS = 1 << 16
SUBCELLS = 32
HEAVY = 512
SLACK = 1 / 256
NODES = 128
BUCKET_ROWS = 200_000


def _hash(*x: int) -> int:
    """A 64-bit mix of small integers, the same in every process."""
    h = 0x9E3779B97F4A7C15
    for v in x:
        h = ((h ^ (v + 0x9E3779B97F4A7C15 + (h << 6) + (h >> 2))) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
        h ^= h >> 31
    return h


class Ring:
    """Shards' virtual nodes on ``CELLS`` places, loads, and clockwise placing under a capacity."""

    def __init__(self, shards: int, total: int, slack: float = SLACK, nodes: int = NODES):
        at = sorted((_hash(1, s, k) % CELLS, _hash(2, s, k), s) for s in range(shards) for k in range(nodes))
        self.places, self.owner = [a for a, _, _ in at], [s for _, _, s in at]
        self.room = [math.ceil(total / shards * (1 + slack))] * shards

    def place(self, cell: int, size: int) -> int:
        """The first shard clockwise with room; if none has, the one with most."""
        k, seen = bisect.bisect_left(self.places, cell), set()
        for j in range(len(self.owner)):
            s = self.owner[(k + j) % len(self.owner)]
            if s not in seen:
                seen.add(s)
                if self.room[s] >= size:
                    break
                if len(seen) == len(self.room):
                    s = max(range(len(self.room)), key=lambda x: (self.room[x], -x))
                    break
        self.room[s] -= size
        return s


def assign(docs: DataFrame, shards: int = 16, slack: float = SLACK) -> DataFrame:
    """Rows doc_id, size, text_crc32, shard for every row of ``docs`` (``doc_id``, ``text``)."""
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(17), F.col("text"), F.octet_length("text"))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(key, F.lit(CELLS)).cast("int").alias("cell"),
        F.pmod(F.shiftright(key, 20), F.lit(SUBCELLS)).cast("int").alias("sub"),
        key.alias("key"),
    )
    rows = cut(rows, "sizes")
    cells = rows.groupBy("cell").agg(F.sum("size").alias("size")).collect()  # CELLS rows at most
    total = sum(r.size for r in cells) if cells else 0
    most = total / shards / HEAVY
    heavy = {r.cell for r in cells if r["size"] > most}
    units = [(r["size"], r["cell"], -1, -1) for r in cells if r["cell"] not in heavy]
    slices: dict[tuple[int, int, int], int] = {}
    if heavy:  # at most HEAVY * shards cells
        marked = spark.createDataFrame([(c,) for c in sorted(heavy)], "cell int")
        inner = rows.join(F.broadcast(marked), "cell", "left_semi").groupBy("cell", "sub").agg(F.sum("size").alias("size")).collect()
        whole = math.ceil(total / shards * (1 + slack))
        left = {(r["cell"], r["sub"]): r["size"] for r in inner}
        big = [u for u, size in left.items() if size > whole]
        if big:  # fewer than ``shards`` units and keys are larger than a shard
            table = spark.createDataFrame(big, "cell int, sub int")
            keys = rows.join(F.broadcast(table), ["cell", "sub"]).groupBy("cell", "sub", "key").agg(F.sum("size").alias("size"))
            for r in keys.where(F.col("size") > whole).collect():
                slices[r["cell"], r["sub"], r["key"]] = math.ceil(r["size"] / max(1, most))
                left[r["cell"], r["sub"]] -= r["size"]
        units += [(size, c, s, -1) for (c, s), size in left.items() if size]
    giant = spark.createDataFrame([(x, k) for (_, _, x), k in slices.items()], "key long, k int")
    if slices:
        parts = (
            rows.join(F.broadcast(giant), "key")
            .groupBy("cell", "sub", "key", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int").alias("slice"))
            .agg(F.sum("size").alias("size"))
            .collect()
        )
        units += [(r["size"], r["cell"], r["sub"], r["slice"], r["key"]) for r in parts]
    ring = Ring(shards, total, slack)
    units.sort(key=lambda u: (-u[0] if u[0] > most else 0, _hash(3, *(x + 1 for x in u[1:4])), u[1:]))
    placed = [(u[1], u[2], u[3], u[4] if len(u) > 4 else None, ring.place(u[1], u[0])) for u in units]
    plan = spark.createDataFrame(placed, "cell int, u int, k int, key long, shard int")
    light = F.broadcast(plan.where("u < 0").select("cell", "shard"))
    out = rows.join(light, "cell", "left")
    if heavy:
        some = F.broadcast(plan.where("u >= 0 and k < 0").select("cell", F.col("u").alias("sub"), F.col("shard").alias("inner")))
        out = out.join(some, ["cell", "sub"], "left").withColumn("shard", F.coalesce("shard", "inner")).drop("inner")
    if slices:
        last = F.broadcast(plan.where("k >= 0").select("key", F.col("k").alias("slice"), F.col("shard").alias("own")))
        out = out.join(F.broadcast(giant), "key", "left").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
        out = out.join(last, ["key", "slice"], "left").withColumn("shard", F.coalesce("own", "shard"))
    return out.select("doc_id", "size", "text_crc32", "shard")


def number(assigned: DataFrame) -> DataFrame:
    """``assigned`` with ``slot``, gapless from 0 in each shard."""
    n = assigned.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    # rows may be equal in all columns, so their places in the table divide them
    place = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))
    rows = assigned.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", place), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.withColumn("nth", F.row_number().over(order) - 1).join(counts.drop("n"), ["shard", "bucket"]).withColumn("slot", (F.col("first") + F.col("nth")).cast("long")).drop("bucket", "first", "nth")


def shard(docs: DataFrame, shards: int = 16, slack: float = SLACK) -> DataFrame:
    """Shard and slot of every row, by the law ``bytes``."""
    placed = cut(assign(docs, shards, slack), "placed")
    return number(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 15 of nearly equal bytes."""
    return shard(read_table(spark, sf_dir, "documents"))
