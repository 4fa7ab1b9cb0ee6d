"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are permuted by a hash and cut into blocks. Its target is
whole passes over all its blocks and a last pass over as many permuted blocks as
still fit; of the block at the edge those documents are taken, in hash order, that
still fit. How many block draws of each source go to which output shard is decided
exactly, not at random per row: a binary tree over the shards splits the vector of
draws by multivariate hypergeometric draws, and leaves take that many consecutive
blocks of each source's permutation, so draws are disjoint. Documents are shuffled
within a shard by a hash of shard and document.

The tree is split in two steps, which have the same distribution: the driver splits
the draws of ``STRATA`` groups of sources, and a task for each group splits its
sources' draws with the totals so found. Sources and blocks stay in tables, however
many there are; blocks grow with the data, so there are ``MAX_BLOCKS`` of them and
one more for each source. Tables are only broadcast below ``MOST_BROADCAST`` rows.
Every choice depends on hashes and seeds alone, so reruns agree.

Null texts have size 0 and a null source is a source of its own, sorted last.
Documents with equal hash (repeated rows) are drawn together. A source of size 0
has target 0. An empty table gives no rows. Other columns are ignored by
``plan`` and kept by ``mix``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, numbered, read_table, split_by_keys

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
MAX_BLOCKS = 1 << 15
BLOCK_ROWS = 64
STRATA = 1024
MOST_BROADCAST = 200_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Targets by weight; what a source can't take (over ``cap`` times its size) is shared again among the others."""
    left, out, active = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while active:
        w = sum(weights[i] for i in active)
        over = {i for i in active if left * weights[i] / w > cap * sizes[i]}
        if not over:
            for i in active:
                out[i] = left * weights[i] / w
            break
        for i in sorted(over):
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        active -= over
    return out


def split(draws: np.ndarray, shards: int, seed: int | list[int], totals: np.ndarray | None = None) -> np.ndarray:
    """Draws of each source (columns) by shard (rows): the splitting tree. ``totals``: draws of each shard, else equal shares."""
    out = np.zeros((shards, len(draws)), np.int64)
    seed = seed if isinstance(seed, list) else [seed]

    def down(v: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = v
            return
        mid = (lo + hi) // 2
        left = int(v.sum()) * (mid - lo) // (hi - lo) if totals is None else int(totals[lo:mid].sum())
        part = np.random.default_rng([*seed, lo, hi]).multivariate_hypergeometric(v, left, method="marginals") if v.sum() else v * 0
        down(part, lo, mid)
        down(v - part, mid, hi)

    down(np.asarray(draws, np.int64), 0, shards)
    return out


def level(sources: DataFrame, total: float, cap: float) -> float:
    """The words a unit of weight gets, when sources (``size``, ``weight``) stop at ``cap`` times their size: as in :func:`targets`."""
    now = 0.0
    while True:
        over = F.col("size") * cap < F.col("weight") * now
        full, weight = sources.agg(F.sum(F.when(over, F.col("size") * cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if not weight:
            return math.inf
        new = (total - (full or 0.0)) / weight
        if new <= now:
            return now
        now = new


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


def _columns(seed: int) -> dict[str, Column]:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return {"size": size, "h": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))}


def _block(h: str, n: Column) -> Column:
    """The block of a hash: its 31 high bits as a share of ``n``."""
    return F.floor(F.shiftrightunsigned(h, 33) * n / F.lit(float(1 << 31))).cast("int")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = 16, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents with size and hash, the sources with targets, the blocks with what is drawn of them, and what is taken at edges.

    Sources: s, source, source_size, target, blocks (how many), edge (block or
    null). Blocks: s, block, shards (one for each draw). Taken: s, h.
    """
    c = _columns(seed)
    rows = cut(docs.select("doc_id", "source", c["size"].alias("size"), c["h"].alias("h")), "sizes")
    found = cut(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "found")
    total, n, many = found.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    per = max(BLOCK_ROWS, math.ceil(n / MAX_BLOCKS))
    found = numbered(found, [F.col("source").isNull(), F.col("source")], "s", many)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("s") % len(weights) + 1).cast("int"))
    found = cut(found.withColumn("weight", weight).withColumn("blocks", F.ceil(F.col("n") / per).cast("int")), "weights")
    unit = level(found, share * total, cap)
    sources = found.select("s", "source", F.col("size").alias("source_size"), F.least(F.col("size") * cap, F.when(F.col("weight") > 0, F.col("weight") * unit).otherwise(0.0)).alias("target"), "blocks")
    sources = cut(sources, "sources")

    by_source = _small(sources.select("s", F.col("source").alias("_source"), "blocks"), many)
    placed = rows.join(by_source, rows["source"].eqNullSafe(F.col("_source"))).select("s", "size", "h", _block("h", F.col("blocks")).alias("block"))
    sums = placed.groupBy("s", "block").agg(F.sum("size").alias("size"))
    last = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed), F.lit(1), "s", "block"), "block")
    sums = sums.join(_small(sources.select("s", "source_size", "target"), many), "s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sums = sums.withColumn("passes", whole).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    sums = sums.withColumn("nth", F.row_number().over(last)).withColumn("until", F.sum("size").over(last.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("fits", (F.col("rest") > 0) & (F.col("until") <= F.col("rest")))
    sums = cut(sums, "blocks")
    edge = F.min(F.when((F.col("rest") > 0) & ~F.col("fits"), F.struct("nth", "block", (F.col("rest") - F.col("until") + F.col("size")).alias("room"))))
    edges = cut(sums.groupBy("s").agg(edge.alias("edge")).where("edge IS NOT NULL").select("s", "edge.block", "edge.room"), "edges")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        """Hashes, in the block's order, that fill the room: what doesn't fit is skipped."""
        pdf = pdf.sort_values("h")
        room, taken = pdf["room"].iloc[0], []
        for h, size in zip(pdf["h"].tolist(), pdf["size"].tolist()):
            if size <= room:
                taken.append(h)
                room -= size
        return pd.DataFrame({"s": np.full(len(taken), pdf["s"].iloc[0]), "h": taken})

    # one block of each source, equal hashes added up
    at_edge = placed.join(_small(edges, many), ["s", "block"]).groupBy("s", "h").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
    taken = cut(at_edge.groupBy("s").applyInPandas(take, "s long, h long"), "taken")

    # a row for each draw, in the order in which leaves take them
    passes = sums.where("passes > 0").select("s", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("p"))
    passes = passes.select("s", "block", "p", F.xxhash64(F.lit(seed), F.lit(2), "s", "p", "block").alias("o"))
    drawn = passes.unionByName(sums.where("fits").select("s", "block", F.col("passes").alias("p"), F.col("nth").cast("long").alias("o")))
    drawn = cut(drawn.withColumn("nth", F.row_number().over(Window.partitionBy("s").orderBy("p", "o", "block"))), "drawn")
    stratum = F.pmod(F.xxhash64(F.lit(11), "s"), F.lit(STRATA)).cast("int").alias("stratum")
    wanted = cut(drawn.groupBy("s").agg(F.count("*").alias("draws")).withColumn("stratum", stratum), "wanted")
    draws = np.zeros(STRATA, np.int64)
    for r in wanted.groupBy("stratum").agg(F.sum("draws").alias("draws")).collect():  # STRATA rows at most
        draws[r["stratum"]] = r["draws"]
    tree = split(draws, shards, seed)

    def leaves(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        part = split(pdf["draws"].to_numpy(), shards, [seed, 1 + key[0]], tree[:, key[0]])
        return pd.DataFrame({"s": pdf["s"].to_numpy(), "until": np.cumsum(part, 0).T.tolist()})

    shares = wanted.groupBy("stratum").applyInPandas(leaves, "s long, until array<long>")
    shard = F.size(F.filter("until", lambda x: x < F.col("nth")))
    at = drawn.join(shares, "s").groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("p", shard.alias("shard")))).alias("at"))  # at most cap and one
    blocks = cut(sums.select("s", "block").join(at.select("s", "block", F.col("at.shard").alias("shards")), ["s", "block"], "left"), "draws")
    sources = cut(sources.join(edges.select("s", F.col("block").alias("edge")), "s", "left"), "sources")
    return rows, sources, blocks.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>"))), taken


def draw(rows: DataFrame, sources: DataFrame, blocks: DataFrame, taken: DataFrame, shards: int = 16) -> DataFrame:
    """``rows`` (with ``source`` and ``h``) with ``source_size``, ``target`` and ``shards``, one shard for each time a row is drawn."""
    many = sources.count()
    src = _small(sources.withColumnRenamed("source", "_source"), many)
    out = rows.join(src, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    out = out.withColumn("block", _block("h", F.col("blocks"))).join(_small(blocks, MAX_BLOCKS + many), ["s", "block"])
    edge = F.coalesce(F.col("block") == F.col("edge"), F.lit(False))
    maybe, _ = split_by_keys(out.where(edge), taken, "h")
    extra = F.array(F.pmod(F.xxhash64(F.lit(3), F.col("s")), F.lit(shards)).cast("int"))
    more = maybe.join(taken.withColumn("more", F.lit(True)), ["s", "h"], "left").withColumn("shards", F.when(F.col("more"), F.concat("shards", extra)).otherwise(F.col("shards"))).drop("more")
    _, clear = split_by_keys(out.where(edge), taken, "h")
    whole = out.where(~edge).unionByName(clear).unionByName(more.select(*out.columns))
    return whole.drop("s", "block", "blocks", "edge")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = 16, seed: int = 7, order: bool = True) -> DataFrame:
    """The mix itself: a row for each time a document is drawn, and with ``order`` the columns ``mix_shard`` and ``mix_key``, by which a shard is ordered."""
    _, sources, blocks, taken = plan(docs, weights, share, cap, shards, seed)
    # the rows themselves travel as one column, so their names can't clash with the plan's
    rows = docs.select("source", _columns(seed)["h"].alias("h"), F.struct("*").alias("row"))
    drawn = draw(rows, sources, blocks, taken, shards).select("row", "h", F.posexplode("shards").alias("nth", "mix_shard"))
    return drawn.select("row.*", "mix_shard", F.xxhash64("mix_shard", "h", "nth").alias("mix_key")) if order else drawn.select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed by weights 5, 2, 1 to 150 % of their words, no source over twice its size."""
    return draw(*plan(read_table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")
