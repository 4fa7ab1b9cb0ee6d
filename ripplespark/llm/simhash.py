"""Near-duplicate documents by SimHash and an LSH forest.

A document's features are its distinct words (ASCII capitals as small letters,
ASCII signs apart from words); its fingerprint has 256 bits. Documents with equal
texts are one class, and classes with equal fingerprints one node.

The forest has several tries, each over its own random permutation of the bits.
A trie's prefix depth follows density: the depth at which a bucket of evenly
spread nodes would hold ``BUCKET`` of them. From there depth is climbed up (made
shorter) until the tries needed for the target recall at ``REACH`` (a share of
differing bits) are at most ``MOST_TRIES``; the number of tries is then whatever
recall needs. A bucket that is still dense (over ``DENSE`` nodes) is divided by a
forest of its own over further bits, again with as many tries as recall needs;
what stays dense after ``LEVELS`` of that is compared whole, in pairs of blocks.
So there is no cap on candidates.

Verification is exact Hamming distance of whole fingerprints, all pairs of a
bucket compared inside its task, which emits a spanning forest of its links, never
all of them. Groups are the connected components. Every link lies inside a group, so
links are then counted there: each document's distance to all of its group, a group
(or a pair of blocks of a large one) inside one task, which emits one count a row.

Result, a row per document: ``class_id`` (least doc_id of the near-duplicates that
it is grouped with), ``n_links`` (different texts of the group within the limit of
its own), ``text_id`` (least doc_id of the equal texts) and ``n_copies`` (documents
with that text).

Null texts are alone: their own doc_id is class and text. Texts without words only
group with equal texts. A null doc_id takes part like any other; a group that only
null ids hold has a null class. Repeated rows each get a row. An empty table gives no
rows. Other columns are ignored by ``near_duplicates`` and kept by
``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut, read_table, split_by_keys, text_buffer, tidy, unused
from .graph import components
from .words import LOWER, SPACE, Words, mix

BITS = 256
#: Most differing bits of a link: a fifth.
LIMIT = 51
#: The share of differing bits at which recall is promised: the limit itself.
REACH = LIMIT / BITS
RECALL = 0.95
#: The recall of a forest inside a dense bucket, of which a pair may pass ``LEVELS``: 0.91 in all.
INNER_RECALL = 0.98
BUCKET = 128
MOST_TRIES = 64
DENSE = 4096
LEVELS = 2

#: Bytes that end a word here: white space and ASCII signs.
_ENDS = SPACE.copy()
_ENDS[:128] |= ~np.array([chr(i).isalnum() for i in range(128)])
_SIGNS = (2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) - 1)


def fingerprints(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows of four 64-bit words) and numbers of distinct words of a block's rows."""
    n = len(offsets) - 1
    low = LOWER[buf].copy()
    low[_ENDS[buf]] = 32
    w = Words(low, offsets)
    _, first = np.unique(mix(w.hash ^ mix(w.row.astype(np.uint64))), return_index=True)
    row, h = w.row[first], w.hash[first]
    out = np.zeros((n, 32), np.uint8)
    for k in range(4):
        octets = mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts = np.bincount(row * 256 + octets[:, j], minlength=n * 256).reshape(n, 256)
            out[:, 8 * k + j] = np.packbits(counts.astype(np.float32) @ _SIGNS > 0, axis=1)[:, 0]
    return out.view(np.uint64), np.bincount(row, minlength=n)


def text_hashes() -> tuple[Column, Column]:
    """Two hashes of the column ``text``, null where it is."""
    text = F.col("text").cast("string")
    t1, t2 = (F.when(text.isNotNull(), F.xxhash64(F.lit(s), text, F.octet_length(text))) for s in (1, 2))
    return t1, t2


FP = "doc_id long, t1 long, t2 long, words long, f0 long, f1 long, f2 long, f3 long"


def fingerprint(docs: DataFrame) -> DataFrame:
    """Text hashes and fingerprint of every row of ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffer(b.column(3))
            for lo, hi in blocks(offs):
                f, n = fingerprints(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                f = f.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(n.astype(np.int64)), *(pa.array(np.ascontiguousarray(f[:, i])) for i in range(4))],
                    [x.split()[0] for x in FP.split(", ")],
                )

    t1, t2 = text_hashes()
    return docs.select(F.col("doc_id").cast("long"), t1.alias("t1"), t2.alias("t2"), F.col("text").cast("string")).mapInArrow(tidy(run), FP)


def tries_for(depth: int, reach: float = REACH, recall: float = RECALL) -> int:
    """Tries that find a pair differing in ``reach`` of the bits with probability ``recall`` at this prefix depth."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - reach) ** depth))) if depth else 1


def shape(nodes: int, recall: float = RECALL, bucket: int = BUCKET, most_tries: int = MOST_TRIES) -> tuple[int, int]:
    """Prefix depth by density, climbed up until recall is within reach, and the tries for it."""
    depth = max(1, math.ceil(math.log2(max(2, nodes) / bucket)))
    while depth > 1 and tries_for(depth, recall=recall) > most_tries:
        depth -= 1
    return depth, tries_for(depth, recall=recall)


def prefixes(f: np.ndarray, depth: int, tries: int, level: int) -> np.ndarray:
    """Prefix of each row (of four 64-bit words) in each trie: rows by tries, as hashes that differ by trie."""
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), 32), axis=1)
    out = np.empty((len(f), tries), np.uint64)
    for t in range(tries):
        at = np.random.default_rng([99, level, t]).permutation(BITS)[:depth]
        packed = np.packbits(bits[:, at], axis=1)
        key = np.full(len(f), t + 1, np.uint64)
        for j in range(packed.shape[1]):
            key = mix(key * np.uint64(257) + packed[:, j])
        out[:, t] = key
    return out


BUCKETS = "bucket long, node long, f0 long, f1 long, f2 long, f3 long"


def _spread(rows: DataFrame, depth: int, tries: int, level: int) -> DataFrame:
    """A row per row and trie, in the bucket of its prefix; rows that have a bucket stay inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, (1 << 17) // tries)
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                f = np.stack([part.column(i).to_numpy() for i in range(2, 6)], 1)
                key = prefixes(f.view(np.uint64), depth, tries, level)
                old = part.column(0).to_numpy().view(np.uint64)
                key = mix(key ^ mix(old)[:, None]) if level else key
                at = np.repeat(np.arange(len(f)), tries)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *(part.column(i).take(pa.array(at)) for i in range(1, 6))], [x.split()[0] for x in BUCKETS.split(", ")])

    return rows.mapInArrow(tidy(run), BUCKETS)


def close_pairs(bucket: np.ndarray, node: np.ndarray, f: np.ndarray, limit: int = LIMIT, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The links within each bucket, rows of which come bucket by bucket: nodes in another order, places of some, and how far after them the others are.

    All rows are compared with the ``s``-th row after them at once, for every s:
    rows of larger buckets come first, so those with an ``s``-th row are a slice.
    ``side``: with block pairs, rows of one side aren't compared with each other.
    """
    new = np.ones(len(bucket), bool)
    new[1:] = bucket[1:] != bucket[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(bucket)))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    done = np.cumsum(size)
    at = np.arange(len(bucket)) + np.repeat(start - (done - size), size)
    group, node, f = np.repeat(np.arange(len(size)), size), node[at], [np.ascontiguousarray(f[at, k]) for k in range(4)]
    side = None if side is None else side[at]
    for s in range(1, int(size[0]) if len(size) else 0):
        p = int(done[np.searchsorted(-size, -s, "left") - 1])  # rows of buckets larger than s
        d = np.bitwise_count(f[0][: p - s] ^ f[0][s:p]).astype(np.int16)
        for k in range(1, 4):
            d += np.bitwise_count(f[k][: p - s] ^ f[k][s:p])
        a = np.flatnonzero((d <= limit) & (group[: p - s] == group[s:p]))
        if side is not None:
            a = a[side[a] != side[a + s]]
        yield node, a, s


def links_of(bucket: np.ndarray, node: np.ndarray, f: np.ndarray, limit: int = LIMIT, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each bucket; rows come bucket by bucket."""
    label = np.arange(len(node))
    left: list[int] = []
    right: list[int] = []
    for node, a, s in close_pairs(bucket, node, f, limit, side):
        a = a[label[a] != label[a + s]]
        if len(a):
            for i in a.tolist():
                x, y = i, i + s
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                if x != y:
                    label[max(x, y)] = min(x, y)
                    left.append(i)
                    right.append(i + s)
            while (label[label] != label).any():
                label = label[label]
    return node[np.array(left, np.int64)], node[np.array(right, np.int64)]


def counts_of(bucket: np.ndarray, node: np.ndarray, f: np.ndarray, weight: np.ndarray, limit: int = LIMIT, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The weight of all others within ``limit`` of each row in its bucket; rows come bucket by bucket."""
    total = np.zeros(len(node), np.int64)
    at = np.arange(len(node))
    for place, a, s in close_pairs(bucket, at, f, limit, side):
        if len(a):
            x, y = place[a], place[a + s]
            np.add.at(total, x, weight[y])
            np.add.at(total, y, weight[x])
    return node, total


def _compare(rows: DataFrame, limit: int, sided: bool = False, count: bool = False) -> DataFrame:
    """A table with BUCKETS' columns (then ``side`` if ``sided``, then ``texts`` to ``count``), a task's buckets at a time.

    Spanning forests of the links ``u``, ``v``, or with ``count`` rows ``u`` (node), ``v`` (texts within the limit).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            c = [t.column(i).to_numpy() for i in range(len(t.column_names))]
            f, side = np.stack(c[2:6], 1).view(np.uint64), c[6] if sided else None
            u, v = counts_of(c[0], c[1], f, c[-1], limit, side) if count else links_of(c[0], c[1], f, limit, side)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= 1 << 16:
                t = pa.Table.from_batches(held)
                k = t.column(0).to_numpy()
                cut_at = int(np.searchsorted(k, k[-1]))  # the last bucket may go on
                if cut_at:
                    yield from work(t.slice(0, cut_at).combine_chunks())
                    held, n = t.slice(cut_at).to_batches(), len(k) - cut_at
        if n:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "u long, v long")


def block_pairs(crowd: DataFrame, dense: int) -> DataFrame:
    """Rows of large buckets (BUCKETS' columns, ``count`` and more) as pairs of blocks of about ``dense / 2`` rows: each pair a bucket of its own, with ``side``."""
    k = F.ceil(F.col("count") / (dense / 2)).cast("int")
    block = F.pmod(F.xxhash64("node"), k).cast("int")
    pairs = crowd.withColumn("k", k).withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("b") == F.col("o"), F.col("node")).otherwise(F.when(F.col("b") < F.col("o"), F.lit(-1)).otherwise(F.lit(-2))).cast("long")
    more = [c for c in crowd.columns if c not in ("bucket", "node", "f0", "f1", "f2", "f3", "count")]
    return pairs.select(F.xxhash64("bucket", F.least("b", "o"), F.greatest("b", "o")).alias("bucket"), "node", "f0", "f1", "f2", "f3", side.alias("side"), *more)


def forest_links(nodes: DataFrame, limit: int = LIMIT, dense: int = DENSE, levels: int = LEVELS) -> DataFrame:
    """Links between nodes (``node``, ``f0`` to ``f3``), found by the forest and verified: spanning forests of its buckets."""
    n = nodes.count()
    cur = _spread(nodes.select(F.lit(0).cast("long").alias("bucket"), "node", "f0", "f1", "f2", "f3"), *shape(n), 0)
    found = None
    for level in range(levels + 1):
        sizes = cut(cur.groupBy("bucket").count().where(F.col("count") > dense), "dense")
        most = sizes.agg(F.max("count")).first()[0]
        ready = cur if most is None else cur.join(sizes, "bucket", "left_anti")
        links = _compare(ready, limit)
        found = links if found is None else found.unionByName(links)
        if most is None:
            return found
        crowd = cut(cur.join(sizes, "bucket"), "crowd")
        if level < levels:
            cur = _spread(crowd.select("bucket", "node", "f0", "f1", "f2", "f3"), *shape(most, INNER_RECALL), level + 1)
    # still dense: every pair of blocks of at most ``dense`` nodes is a bucket of its own
    return found.unionByName(_compare(block_pairs(crowd, dense), limit, True))


def count_links(nodes: DataFrame, groups: DataFrame, limit: int = LIMIT, dense: int = DENSE) -> DataFrame:
    """``node`` and ``others``: texts of other nodes of its group within the limit."""
    rows = nodes.join(groups, "node").select(F.col("root").alias("bucket"), "node", "f0", "f1", "f2", "f3", "texts")
    sizes = rows.groupBy("bucket").count()
    rows = cut(rows.join(sizes, "bucket"), "members")
    small = _compare(rows.where(F.col("count") <= dense).drop("count"), limit, count=True)
    large = _compare(block_pairs(rows.where(F.col("count") > dense), dense), limit, True, True)
    return small.unionByName(large).groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("others"))


def text_groups(prints: DataFrame, limit: int, dense: int, levels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equal texts (``t1``, ``t2``, first document, copies), nodes (equal fingerprints) and the nodes' groups (``node``, ``root``)."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    classes = prints.where("t1 IS NOT NULL").groupBy("t1", "t2").agg(least.alias("least"), F.count("*").alias("n_copies"), *(F.first(c).alias(c) for c in ("words", "f0", "f1", "f2", "f3")))
    # a node's number is a hash of its fingerprint; texts without words are nodes of their own
    number = F.when(F.col("words") > 0, F.xxhash64("f0", "f1", "f2", "f3")).otherwise(F.xxhash64(F.lit(41), "t1", "t2"))
    classes = cut(classes.withColumn("node", number), "classes")
    nodes = cut(classes.where("words > 0").groupBy("node", "f0", "f1", "f2", "f3").agg(F.count("*").alias("texts")), "nodes")
    links = cut(forest_links(nodes, limit, dense, levels).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    return classes, nodes, cut(components(links), "groups")


def near_duplicates(docs: DataFrame, limit: int = LIMIT, dense: int = DENSE, levels: int = LEVELS) -> DataFrame:
    """Class, links and copies of every document (see the module's text)."""
    prints = cut(fingerprint(docs), "prints")
    classes, nodes, groups = text_groups(prints, limit, dense, levels)
    named = classes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("root").agg(F.min("least").alias("first"))
    links = nodes.join(count_links(nodes, groups, limit, dense), "node", "left").select("node", (F.coalesce("others", F.lit(0)) + F.col("texts") - 1).alias("n_links"))
    of = named.join(firsts, "root").join(links, "node", "left")
    of = of.select("t1", "t2", F.col("first.doc_id").alias("class_id"), "n_links", F.col("least.doc_id").alias("text_id"), "n_copies")
    out = prints.join(of, ["t1", "t2"], "left")
    own = [F.when(F.col("t1").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "text_id")]
    return out.select("doc_id", own[0], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own[1], F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, limit: int = LIMIT, dense: int = DENSE, levels: int = LEVELS) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id (a null id last), then the least hash of the text.

    Rows that share an id are judged each by its own text; of rows equal in id and
    text one stays. Rows of null texts all stay.
    """
    names = docs.columns
    row, stays = unused(names, "_row", "_stays")
    prints = cut(fingerprint(docs), "prints")
    classes, _, groups = text_groups(prints, limit, dense, levels)
    named = classes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("root").agg(F.min(F.struct("least.none", "least.doc_id", "t1", "t2")).alias("kept"), F.sum("n_copies").alias("n")).where("n > 1")
    crowd = named.join(several, "root").select("t1", "t2", F.xxhash64("kept.doc_id", "kept.t1", "kept.t2").alias("kept"))
    key = F.xxhash64("doc_id", "t1", "t2").alias(row)
    members = prints.join(crowd, ["t1", "t2"]).select(key, (key == F.col("kept")).alias(stays))
    members = members.groupBy(row).agg(F.max(stays).alias(stays), F.count("*").alias("n")).where(f"NOT {stays} OR n > 1").select(row, stays)
    members = cut(members, "copies")
    t1, t2 = text_hashes()
    maybe, clear = split_by_keys(docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), t1, t2)), members, row)
    judged = maybe.join(members, row, "left")
    whole = judged.where(F.col(stays).isNull()).select(*names)
    one = judged.where(F.col(stays)).dropDuplicates([row]).select(*names)
    return clear.select(*names).unionByName(whole).unionByName(one)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all ``documents``."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
