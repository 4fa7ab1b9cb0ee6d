"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are brought to the unit sphere so that inner product order is distance
order: candidates are divided by the largest norm and given the coordinate that
completes norm 1, queries are divided by their own norm. A table hashes a vector
by Gaussian (2-stable) projections, each cut into ``CUTS`` intervals of width
``WIDTH``, the outer two open. For a query, a bucket's estimated success is the
probability that a neighbour of similarity ``rho`` falls there, the product of
normal masses of its intervals around ``rho`` times the query's projections.
Buckets are visited in that order until the visited mass promises, over all tables,
the target recall.

``rho`` is the similarity of the ``k``-th neighbour, estimated on bounded samples
(``SAMPLE`` vectors, ``ASKED`` of them as queries); every row is indexed. How many
tables and projections to use is chosen on the same samples, as what promises the
recall with the fewest candidates scored: where neighbours are much closer than
other vectors, more projections and tables leave fewer candidates; where they
aren't, one table does, of which most is visited.

Buckets are gathered into parts of about ``PART`` candidates; larger buckets are
split by a hash, so no task gets an unbounded group. Queries that visit a part are
divided into blocks of ``PART`` by their number there, and candidates are sent to
the blocks of their part alone. A part scores its visited candidates exactly and
returns each query's best ``k``; parts are merged by score. Candidates are never
capped. Candidates are sifted in single precision by scaled vectors, with the bound
of its error as margin, and scored in double precision by the original ones.

A vector that is null, zero, of another length than most, or holds null or
non-finite components takes no part; nor does a null id. A query's own id is no
candidate. Ties go to the smaller id. Fewer candidates give fewer rows; empty
tables give none. Repeated ids are candidates like any other, of which the best
counts. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table, tidy

#: Tables and projections of a table to choose from.
SHAPES = ((1, 4), (1, 6), (2, 6), (2, 8), (3, 8), (4, 8))
CUTS = 4
WIDTH = 1.3
RECALL = 0.98
SAMPLE = 4096
ASKED = 64
PART = 40_000
SEED = 11


def usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows ``id``, ``v`` (array of double) that can take part."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    sound = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    most = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.where(F.size("v") == (most[0] if most else 0))


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 7.1.26; error below 1e-6)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    e = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x >= 0, 0.5 * (1 + e), 0.5 * (1 - e))


class Family:
    """The hash functions of all tables for vectors of ``dim`` components with norms up to ``top``."""

    def __init__(self, dim: int, top: float, tables: int = 1, hashes: int = 6, cuts: int = CUTS, width: float = WIDTH):
        rng = np.random.default_rng(SEED)
        self.top, self.tables, self.hashes, self.cuts = top, tables, hashes, cuts
        self.a = rng.normal(size=(tables, dim + 1, hashes))
        # inner borders lie around 0, shifted by the p-stable scheme's random offset
        shift = rng.uniform(-width / 4, width / 4, (tables, hashes, 1))
        self.borders = (np.arange(1, cuts) - cuts / 2) * width + shift

    def _project(self, v: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tdh->tnh", np.concatenate([v, extra[:, None]], 1), self.a)

    def buckets(self, v: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table (tables by rows)."""
        v = v / self.top
        x = self._project(v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1))))
        digit = (x[..., None] >= self.borders[:, None]).sum(-1)
        return (digit * self.cuts ** np.arange(self.hashes)).sum(-1)

    def success(self, q: np.ndarray, rho: float) -> np.ndarray:
        """Estimated success of every bucket for each query: tables by queries by buckets."""
        q = unit(q)
        x = self._project(q, np.zeros(len(q))) * rho
        low = _phi((self.borders[:, None] - x[..., None]) / math.sqrt(max(1e-6, 1 - rho * rho)))
        ends = np.concatenate([np.zeros(low.shape[:-1] + (1,)), low, np.ones(low.shape[:-1] + (1,))], -1)
        mass = np.maximum(np.diff(ends), 0)
        out = mass[..., 0, :]
        for j in range(1, self.hashes):
            out = (mass[..., j, :, None] * out[..., None, :]).reshape(*out.shape[:-1], -1)
        return out


def probes(success: np.ndarray, filled: np.ndarray, share: float) -> np.ndarray:
    """Which buckets to visit: in order of success until ``share`` of the mass; queries by buckets. Empty buckets are free."""
    order = np.argsort(-success, axis=1, kind="stable")
    mass = np.take_along_axis(success, order, 1)
    before = np.cumsum(mass, 1) - mass
    out = np.zeros(success.shape, bool)
    np.put_along_axis(out, order, before < share * before[:, -1:], 1)
    return out & filled


def unit(v: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, which needn't fit a double."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def choose(s: np.ndarray, asked: np.ndarray, top: float, rho: float, recall: float) -> tuple[Family, float, float]:
    """The family of ``SHAPES`` that scores the fewest of the sample ``s`` for the queries ``asked``, the mass to visit in a table, and that share of candidates."""
    best = None
    for tables, hashes in SHAPES:
        family = Family(s.shape[1], top, tables, hashes)
        share = 1 - (1 - recall) ** (1 / tables)
        scored = 0.0
        for lo in range(0, len(asked), 8):
            some = asked[lo : lo + 8]
            for bucket, success in zip(family.buckets(s), family.success(some, rho)):
                visit = probes(success, np.ones(success.shape[1], bool), share)
                scored += visit[:, bucket].mean() * len(some) / len(asked)
        if best is None or scored < 0.9 * best[2]:  # a larger family must be worth it
            best = family, share, scored
    return best


def _top(q_ids: np.ndarray, q: np.ndarray, visit: np.ndarray, ids: np.ndarray, v: np.ndarray, at: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's best ``k`` among the candidates whose bucket (``at``) it visits."""
    out: tuple[list, list, list] = ([], [], [])
    order = np.argsort(ids, kind="stable")
    ids, v, at = ids[order], v[order], at[order]
    # scaled to norms of 1 at most, single precision is off by (d + 4) * 2**-24 at most, at the edge and at a candidate
    largest = np.abs(v).max()
    small = v / largest
    small = (small / np.linalg.norm(small, axis=1).max()).astype(np.float32)
    slack = 2 * (v.shape[1] + 4) * 2.0**-24
    for lo in range(0, len(q), 64):
        approx = unit(q[lo : lo + 64]).astype(np.float32) @ small.T
        approx[~visit[lo : lo + 64][:, at]] = -np.inf
        for i, row in enumerate(approx):
            own = np.searchsorted(ids, [q_ids[lo + i], q_ids[lo + i] + 1])
            row[own[0] : own[1]] = -np.inf
            if len(row) > k:
                edge = np.partition(row, len(row) - k)[len(row) - k]
                near = np.flatnonzero(row >= edge - slack) if np.isfinite(edge) else np.flatnonzero(np.isfinite(row))
            else:
                near = np.flatnonzero(np.isfinite(row))
            score = (v[near] * q[lo + i]).sum(1)
            best = near[np.lexsort((ids[near], -score))][:k]
            out[0].append(np.full(len(best), q_ids[lo + i]))
            out[1].append(ids[best])
            out[2].append((v[best] * q[lo + i]).sum(1))
    return out


def _norm(v: str) -> Column:
    """The norm of an array, by its largest component."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return most * F.sqrt(F.aggregate(F.transform(v, lambda x: x / most), F.lit(0.0), lambda a, x: a + x * x))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", recall: float = RECALL, part: int = PART) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    base, asked = cut(usable(rows, id_col, vector), "vectors"), cut(usable(queries, id_col, vector), "queries")
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    empty = "query_id long, rank int, vec_id long, score double"
    n = base.count()
    if not n or not asked.limit(1).count():
        return spark.createDataFrame([], empty)
    s = np.stack(sample["v"].to_numpy())
    top = base.agg(F.max(_norm("v"))).first()[0] * (1 + 1e-9)
    near = unit(s[:ASKED]) @ (s / top).T
    near[np.arange(len(near)), np.arange(len(near))] = -1
    at = max(1, round(k * len(s) / n))
    rho = float(np.clip(np.median(np.sort(near, 1)[:, -min(at, near.shape[1])]), 0.05, 0.95))
    family, share, _ = choose(s, s[:ASKED], top, rho, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            for t, codes in enumerate(family.buckets(v)):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, t, np.int32)), pa.array(codes.astype(np.int32))], ["id", "v", "t", "bucket"])

    table = base.mapInArrow(tidy(hashed), "id long, v array<double>, t int, bucket int")
    counts = table.groupBy("t", "bucket").count().collect()  # at most tables * CUTS**hashes rows
    size = np.zeros((family.tables, family.cuts**family.hashes), np.int64)
    for r in counts:
        size[r["t"], r["bucket"]] = r["count"]
    # parts of neighbouring buckets; a bucket larger than a part is split into several
    of, pieces = np.zeros(size.shape, np.int32), []
    for t in range(family.tables):
        held, now = 0, len(pieces)
        pieces.append(1)
        for c in np.flatnonzero(size[t]):
            if held and held + size[t, c] > part:
                now, held = len(pieces), 0
                pieces.append(1)
            of[t, c] = now
            held += size[t, c]
            pieces[now] = max(1, math.ceil(held / part))
    index = spark.sparkContext.broadcast((family, size > 0, of, np.array(pieces, np.int32)))

    def visits(whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
        """Some queries, a table, a part of it, those queries that visit it, and which of its buckets."""
        family, filled, of, _ = index.value
        for lo in range(0, whole.num_rows, 32):
            b = whole.slice(lo, 32)
            for t, success in enumerate(family.success(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), rho)):
                visit = probes(success, filled[t], share)
                for p in np.unique(of[t][filled[t]]).tolist():
                    mine = visit[:, (of[t] == p) & filled[t]]
                    yield b, t, p, np.flatnonzero(mine.any(1)), mine

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(len(index.value[3]), np.int64)
        for b in batches:
            for _, _, p, hit, _ in visits(b):
                got[p] += len(hit)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got)], ["part", "n"])

    asking = asked.mapInArrow(tidy(ask), "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
    blocks = np.ones(len(pieces), np.int32)
    for r in asking.collect():  # a row a part
        blocks[r["part"]] = math.ceil(r["n"] / part)
    fixed = spark.sparkContext.broadcast(blocks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, _, of, pieces), blocks = index.value, fixed.value
        for b in batches:
            t, c, ids = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(0).to_numpy()
            p = of[t, c]
            piece = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % pieces[p].astype(np.uint64)
            for block in range(int(blocks[p].max(initial=0))):
                here = np.flatnonzero(blocks[p] > block)
                at = pa.array(here)
                yield pa.RecordBatch.from_arrays([pa.array(p[here]), pa.array(piece[here].astype(np.int32)), pa.array(np.full(len(here), block, np.int32)), b.column(0).take(at), b.column(1).take(at), pa.array(c[here]), pa.nulls(len(here), pa.binary())], PLACED_NAMES)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, blocks = index.value[3], fixed.value
        for whole in batches:
            for b, t, p, hit, mine in visits(whole):
                ids, at = b.column(0).to_numpy()[hit], pa.array(hit)
                block = ((ids.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(max(1, blocks[p]))
                bits = [x.tobytes() for x in np.packbits(mine[hit], axis=1)]
                for piece in range(pieces[p]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hit), p, np.int32)), pa.array(np.full(len(hit), piece, np.int32)), pa.array(block.astype(np.int32)), pa.array(ids), b.column(1).take(at), pa.array(np.full(len(hit), t, np.int32)), pa.array(bits, pa.binary())],
                        PLACED_NAMES,
                    )

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, filled, of, _ = index.value
        ask = pdf["visit"].notna().to_numpy()
        if ask.all() or not ask.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, c = pdf[ask], pdf[~ask]
        t = int(q["bucket"].iloc[0])
        own = np.flatnonzero((of[t] == key[0]) & filled[t])
        visit = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in q["visit"]]), axis=1)[:, : len(own)].astype(bool)
        got = _top(q["id"].to_numpy(), np.stack(q["v"].to_numpy()), visit, c["id"].to_numpy(), np.stack(c["v"].to_numpy()), np.searchsorted(own, c["bucket"].to_numpy()), k)
        return pd.DataFrame({"query_id": np.concatenate(got[0]), "vec_id": np.concatenate(got[1]), "score": np.concatenate(got[2])})

    placed = table.mapInArrow(tidy(place), PLACED).unionByName(asked.mapInArrow(tidy(probe), PLACED))
    found = placed.groupBy("part", "piece", "block").applyInPandas(score, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


PLACED = "part int, piece int, block int, id long, v array<double>, bucket int, visit binary"
PLACED_NAMES = [x.split()[0] for x in PLACED.split(", ")]


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector of ``embeddings``."""
    rows = read_table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
