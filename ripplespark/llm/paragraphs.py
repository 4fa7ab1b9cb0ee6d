"""Substring dedup: paragraph MinHash banding, and exact passages inside paragraphs.

A paragraph is a line of at least ``LEAST_WORDS`` words. Its MinHash signature,
over 3-word shingles, is cut into ``BANDS`` bands of ``ROWS`` values, tuned so that
paragraphs at the limit, of Jaccard similarity 0.5, collide with probability 0.91
(0.6: 0.99). Equal paragraphs are one class from the start; classes that share a
band are joined to the least and greatest class of that band (a star, never all
pairs), and every link is verified by exact Jaccard of the two shingle sets, at
least ``JACCARD``. Then all pairs that share a band are compared, in blocks, but
for those that links already put in one component, so no component is lost.
Verified links are clustered by connected components, and of each cluster the
first paragraph (by doc_id and place) stays.

A passage that lies inside longer, different paragraphs is found too, among what
paragraphs leave: words of a paragraph that goes are neither kept nor removed
again, so of each passage a copy survives. Seeds are runs of ``PASSAGE_WORDS``
words, picked as the least hash of each ``WINDOW`` successive runs, so every repeat
of 50 words holds a seed that is picked wherever it stands. A seed's places are
compared with its first (by doc_id); seeds at one distance to one document are
joined to a run. From a run's ends that no other run covers, the words around its
last seed are compared, one by one, with those in that first document. Where other
places go on alike beyond that, the longest words that an earlier document has too
are found by hashes of every length, so repeats go to their true ends.
Each row of a passage is thus, word for word, a part of the one document it names.

Words are read with ASCII capitals as small letters, ASCII signs as white space.
A paragraph or passage is only removed where the one that stays is in another
document; rows equal in doc_id and text are one document. Paragraphs without
white space between words are not cut further.

Null and empty texts have no paragraphs and stay as they are. A null doc_id sorts
first. An empty table gives no rows. ``repeats`` ignores other columns, ``remove``
keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, cut, edit_text, free, read_table, split_by_keys, text_buffer, tidy, unused
from .graph import components
from .simhash import _ENDS
from .words import LOWER, P, Q, Words, mix, shingles, spans, sums

LEAST_WORDS = 20
BANDS, ROWS, SHINGLE = 18, 3, 3
JACCARD = 0.5
#: Shingles of a block of a band's members.
BLOCK = 1 << 17
PASSAGE_WORDS = 25
#: Runs of which the least is a seed: a repeat of PASSAGE_WORDS + WINDOW - 1 words surely holds one.
WINDOW = 25

_rng = np.random.default_rng(23)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _read(buf: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[buf]
    low[_ENDS[buf] & (buf != 10)] = 32
    return Words(low, offsets)


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[dict, dict]:
    """Paragraphs (row, start, end, words, hash, bands) and seeds (row, start, end, first word, hash, other) of a block."""
    w = _read(buf, offsets)
    n = len(w.hash)
    breaks = np.flatnonzero(buf == 10)
    before = np.searchsorted(breaks, w.start)
    line = before + w.row
    new = np.ones(n, bool)
    new[1:] = line[1:] != line[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) if n else first
    keep = last - first >= LEAST_WORDS
    first, last = first[keep], last[keep]
    row, at = w.row[first], before[first]
    edges = np.concatenate([[-1], breaks, [len(buf)]])
    prefix = sums(w.hash, Q)
    para = {
        "row": row,
        "start": np.maximum(edges[at] + 1, offsets[row]) - offsets[row],
        "end": np.minimum(edges[at + 1], offsets[row + 1]) - offsets[row],
        "words": last - first,
        "hash": spans(prefix, first, last, Q).view(np.int64),
    }
    if len(first):
        h = w.hash[: n - SHINGLE + 1]
        for j in range(1, SHINGLE):
            h = h * np.uint64(Q) + w.hash[j : n - SHINGLE + 1 + j]
        h = mix(h)
        # windows of a paragraph: reduceat over (first, last - SHINGLE + 1) pairs
        at = np.stack([first, last - SHINGLE + 1], 1).ravel()
        at = np.minimum(at, len(h) - 1) if at[-1] >= len(h) else at
        tail = last - SHINGLE + 1 >= len(h)
        sig = np.empty((BANDS * ROWS, len(first)), np.uint64)
        for k in range(BANDS * ROWS):
            v = h * _A[k] + _B[k]
            m = np.minimum.reduceat(v, at)[::2]
            if tail[-1]:
                m[-1] = v[first[-1] :].min()
            sig[k] = m
        bands = np.empty((len(first), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(first), b + 1, np.uint64)
            for r in range(ROWS):
                key = mix(key * np.uint64(Q) + sig[b * ROWS + r])
            bands[:, b] = key
        para["bands"] = bands.view(np.int64)
    else:
        para["bands"] = np.zeros((0, BANDS), np.int64)

    h, ok = _runs(w, prefix)
    return para, _places(w, offsets, _seeds(h, ok, w.row), prefix)


def _runs(w: Words, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``PASSAGE_WORDS`` words from each word on, and whether they lie in one row."""
    n = max(0, len(w.hash) - PASSAGE_WORDS + 1)
    at = np.arange(n)
    return spans(prefix, at, at + PASSAGE_WORDS, Q), w.row[:n] == w.row[len(w.hash) - n :]


def _slide(x: np.ndarray, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``WINDOW`` successive values."""
    size = 1
    while 2 * size <= WINDOW:
        x, size = best(x[:-size], x[size:]), 2 * size
    return best(x[: len(x) - (WINDOW - size)], x[WINDOW - size :])


def _seeds(h: np.ndarray, ok: np.ndarray, row: np.ndarray) -> np.ndarray:
    """First words of the seeds: the least runs of every window (all, if equal), and of rows shorter than one.

    Of a stretch of equal runs (one word, repeated) the first, the last and every
    ``PASSAGE_WORDS``-th are enough: they touch, and a repeat that ends in a stretch holds
    the stretch's other end.
    """
    at = np.flatnonzero(ok)
    if not len(at):
        return at
    new = np.ones(len(at), bool)
    new[1:] = row[at[1:]] != row[at[:-1]]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    least = np.minimum.reduceat(h[at], begin)
    short = np.repeat(size < WINDOW, size) & (h[at] == np.repeat(least, size))
    pick = np.zeros(len(h), bool)
    pick[at[short]] = True
    if len(h) >= WINDOW:
        whole = np.concatenate([[0], np.cumsum(ok)])
        low = np.where(whole[WINDOW:] - whole[:-WINDOW] == WINDOW, _slide(h, np.minimum), np.uint64(0))
        pad = np.zeros(WINDOW - 1, np.uint64)
        pick |= ok & (_slide(np.concatenate([pad, low, pad]), np.maximum) == h)
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | ~ok[1:] | ~ok[:-1] | (row[1 : len(h)] != row[: len(h) - 1])
    begin = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    last = np.append(first[1:], True)
    return np.flatnonzero(pick & (last | ((np.arange(len(h)) - begin) % PASSAGE_WORDS == 0)))


def _places(w: Words, offsets: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> dict:
    """Runs from the words ``at`` on."""
    row, end = w.row[at], at + PASSAGE_WORDS
    other = spans(sums(mix(w.hash ^ np.uint64(P)), P), at, end, P)
    return {"row": row, "start": w.start[at] - offsets[row], "end": w.end[end - 1] - offsets[row], "first": at - w.first[row], "hash": spans(prefix, at, end, Q).view(np.int64), "other": other.view(np.int64)}


SEEDS = "array<struct<first:int,start:int,end:int,h:long,g:long>>"
UNIT = f"doc long, doc_id long, start int, end int, words int, h long, bands array<long>, seeds {SEEDS}"
NAMES = ["doc", "doc_id", "start", "end", "words", "h", "bands", "seeds"]


def _key(doc_id: str = "doc_id", text: str = "text"):
    return F.xxhash64(F.lit(29), F.col(doc_id), F.col(text))


def find_units(docs: DataFrame) -> DataFrame:
    """A row per paragraph of ``docs`` (``doc_id``, ``text``), and one per document with its ``seeds``; ``doc`` is a hash of both."""
    seed_type = pa.struct([("first", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffer(b.column(2))
            doc, ids = b.column(0), b.column(1)
            for lo, hi in blocks(offs):
                para, seed = units(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                n = len(para["row"])
                at = pa.array(para["row"] + lo)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(para["bands"].ravel()))
                ints = [pa.array(np.asarray(para[k], np.int32)) for k in ("start", "end", "words")]
                yield pa.RecordBatch.from_arrays([doc.take(at), ids.take(at), *ints, pa.array(para["hash"]), bands, pa.nulls(n, pa.list_(seed_type))], NAMES)
                first = pa.array(np.searchsorted(seed["row"], np.arange(hi - lo + 1)).astype(np.int32))
                parts = [pa.array(np.asarray(seed[k], np.int32)) for k in ("first", "start", "end")]
                each = pa.StructArray.from_arrays([*parts, pa.array(seed["hash"]), pa.array(seed["other"])], fields=list(seed_type))
                none = [pa.nulls(hi - lo, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                whole = pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), ids.slice(lo, hi - lo), *none, pa.ListArray.from_arrays(first, each)], NAMES)
                yield whole.filter(pa.array(np.diff(first.to_numpy()) > 0))

    return docs.select(_key().alias("doc"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), UNIT)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets (``h``, ``set`` of 64-bit hashes) of the paragraphs ``wanted`` (``doc``, ``start``, ``end``, ``h``), read from their texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode()
                parts = [raw[p["start"] : p["end"]] for p in places]
                buf, offs = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                w = _read(buf, offs)
                s, at = shingles(w, SHINGLE)
                row, s = w.row[at], s.view(np.int64)
                order = np.lexsort((s, row))
                row, s = row[order], s[order]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
                row, s = row[new], s[new]
                cuts = np.searchsorted(row, np.arange(len(parts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([p["h"] for p in places], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(s))], ["h", "set"])

    places = wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "h")).alias("places"))
    rows = docs.where("text IS NOT NULL").select(_key().alias("doc"), F.col("text").cast("string").alias("text"))
    maybe, _ = split_by_keys(rows, wanted, "doc")
    once = maybe.join(places, "doc").dropDuplicates(["doc"])
    return once.select("text", "places").mapInArrow(tidy(run), "h long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Those of ``pairs`` (``u``, ``v``) whose sets have at least this Jaccard similarity."""
    a, b = sets.select(F.col("h").alias("u"), F.col("set").alias("a")), sets.select(F.col("h").alias("v"), F.col("set").alias("b"))
    both = pairs.join(a, "u").join(b, "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= jaccard * (F.size("a") + F.size("b") - common)).select("u", "v")


def _bucket_links(keys: np.ndarray, h: np.ndarray, root: np.ndarray, side: np.ndarray, flat: np.ndarray, first: np.ndarray, jaccard: float) -> Iterator[tuple[int, int]]:
    """Links that join components within each bucket (rows of one key come together); member i's set is ``flat[first[i]:first[i+1]]``.

    Members of one side (but side 0) aren't compared with each other.
    """
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        label: dict[int, int] = {}

        def find(x: int) -> int:
            while label.get(x, x) != x:
                x = label[x]
            return x

        size = np.diff(first[lo : hi + 1])
        _, shingle = np.unique(flat[first[lo] : first[hi]], return_inverse=True)
        holder = np.repeat(np.arange(hi - lo), size)
        order = np.argsort(shingle, kind="stable")
        posting, begin = holder[order], np.searchsorted(shingle[order], np.arange(shingle.max(initial=-1) + 2))
        at = np.concatenate([[0], np.cumsum(size)])
        for i in range(hi - lo - 1):
            mine = shingle[at[i] : at[i + 1]]
            n = begin[mine + 1] - begin[mine]
            done = np.cumsum(n)
            others = posting[np.arange(done[-1] if len(done) else 0) + np.repeat(begin[mine] - (done - n), n)]
            common = np.bincount(others[others > i], minlength=hi - lo)
            near = np.flatnonzero((common > 0) & (common >= jaccard * (size[i] + size - common)))
            for j in near.tolist():
                if side[lo + i] == side[lo + j] != 0:
                    continue
                a, b = find(int(root[lo + i])), find(int(root[lo + j]))
                if a != b:
                    label[max(a, b)] = min(a, b)
                    u, v = int(h[lo + i]), int(h[lo + j])
                    yield min(u, v), max(u, v)


def _compare(rows: DataFrame, jaccard: float) -> DataFrame:
    """Links ``u``, ``v`` that join components of ``rows`` (``bucket``, ``side``, ``h``, ``root``, ``set``), each bucket compared inside one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            sets = t.column(4).combine_chunks()
            first = sets.offsets.to_numpy().astype(np.int64)
            links = list(_bucket_links(*(t.column(i).to_numpy() for i in (0, 2, 3, 1)), sets.flatten().to_numpy(), first - first[0], jaccard))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                held.append(b.slice(lo, 1024))
                t = pa.Table.from_batches(held)
                key = t.column(0).to_numpy()
                last = int(np.flatnonzero(key == key[-1])[0])  # the last bucket may go on
                if last:
                    yield from work(t.slice(0, last))
                    held = t.slice(last).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "side", "h", "root", "set").mapInArrow(tidy(run), "u long, v long")


def paragraph_links(docs: DataFrame, classes: DataFrame, jaccard: float = JACCARD, block: int = BLOCK) -> DataFrame:
    """Verified links (``u``, ``v``: paragraph hashes) between different paragraphs that share a band, enough of them for its components.

    Members are first compared with the ends of their bands. Bands whose members
    aren't all in one component then are compared whole, as pairs of blocks of
    about ``block`` shingles, each pair in one task.
    """
    held = classes.select("h", F.explode("bands").alias("band"))
    shared = cut(held.groupBy("band").count().where("count > 1").select("band"), "bands")
    maybe, _ = split_by_keys(held, shared, "band")
    members = cut(maybe.join(shared, "band"), "members")
    some, _ = split_by_keys(classes.select("h", "first"), members, "h")
    wanted = cut(some.join(members.select("h").distinct(), "h").select("first.doc", "first.start", "first.end", "h"), "wanted")
    sets = cut(shingle_sets(docs, wanted), "sets")
    ends = members.groupBy("band").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    star = members.join(ends, "band").select("h", F.explode(F.array("lo", "hi")).alias("o")).where("h <> o")
    star = star.select(F.least("h", "o").alias("u"), F.greatest("h", "o").alias("v")).distinct()
    links = cut(verified(star, sets, jaccard), "links")
    roots = components(links).withColumnRenamed("node", "h")
    named = cut(members.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")).join(sets.select("h", F.size("set").alias("n")), "h"), "named")
    k = F.greatest(F.lit(1), F.ceil(F.sum("n") / block)).cast("int").alias("k")
    mixed = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), k).where("lo < hi").select("band", "k")
    open_ = named.join(mixed, "band").withColumn("b", F.pmod(F.xxhash64("h"), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side")
    rows = open_.select(F.xxhash64("band", F.least("b", "o"), F.greatest("b", "o")).alias("bucket"), side, "h", "root")
    # a row of a block meets itself in the block's own pair, once
    out = cut(links.unionByName(_compare(rows.join(sets, "h"), jaccard)).distinct(), "links")
    free(shared, members, wanted, sets, named, links)
    return out


CONTEXT = "doc long, pos int, side int, words array<long>, at array<int>"


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Up to ``WINDOW`` words from each place of ``wanted`` (``doc``, ``pos``, ``side``) outwards.

    Side 0 goes left of word ``pos``, side 1 right from it. ``words`` are hashes;
    ``at`` is where the text begins (ends) with none, one, two, ... of them.
    """
    out = np.arange(WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_py().encode()
                w = _read(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                pos, side = (b.column(2)[i].values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                n, right = len(w.hash), side == 1
                which = np.where(right[:, None], pos[:, None] + out, pos[:, None] - 1 - out)
                ok = (which >= 0) & (which < n)
                which = np.clip(which, 0, n - 1)
                size = ok.sum(1)
                edge = np.concatenate([np.where(right, w.end[np.maximum(pos - 1, 0)], w.start[np.minimum(pos, n - 1)])[:, None], np.where(right[:, None], w.end[which], w.start[which])], 1)
                has = np.concatenate([np.ones((len(pos), 1), bool), ok], 1)
                cuts = np.concatenate([[0], np.cumsum(size)])
                words = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(w.hash[which[ok]].view(np.int64)))
                at = pa.ListArray.from_arrays(pa.array((cuts + np.arange(len(cuts))).astype(np.int32)), pa.array(edge[has].astype(np.int32)))
                same = pa.array(np.zeros(len(pos), np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).take(same), pa.array(pos.astype(np.int32)), pa.array(side.astype(np.int32)), words, at], [x.split()[0] for x in CONTEXT.split(", ")])

    places = wanted.groupBy("doc").agg(F.collect_set(F.struct("pos", "side")).alias("places"))  # at most two for each word of a document
    rows = docs.where("text IS NOT NULL").select(_key().alias("doc"), F.col("text").cast("string").alias("text"))
    maybe, _ = split_by_keys(rows, wanted, "doc")
    once = maybe.join(places, "doc").dropDuplicates(["doc"])
    return once.select("doc", "text", "places").mapInArrow(tidy(run), CONTEXT)


def alike(a: str, b: str) -> Column:
    """How many elements two arrays share from their beginning."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def hits_of(seeds: DataFrame, gone: DataFrame) -> DataFrame:
    """Places of seeds that an earlier document has, with the first such (``kept``); places within spans ``gone`` (``doc``, ``start``, ``end``) don't count."""
    seen = cut(seeds.groupBy("h").count().where("count > 1").select("h"), "seen")
    maybe, _ = split_by_keys(seeds, seen, "h")
    shared = cut(maybe.join(seen, "h"), "shared")
    inside, outside = split_by_keys(shared, gone, "doc")
    # spans of a document are lines, so the last that begins before a seed's end is the only one to overlap it
    lines = gone.select("doc", F.lit(0).alias("k"), F.col("start").alias("key"), F.col("end").alias("until"))
    rows = inside.withColumn("k", F.lit(1)).withColumn("key", F.col("end") - 1).unionByName(lines, allowMissingColumns=True)
    before = Window.partitionBy("doc").orderBy("key", "k").rowsBetween(Window.unboundedPreceding, 0)
    free_ = rows.withColumn("until", F.max("until").over(before)).where("k = 1 AND (until IS NULL OR until <= start)").select(*shared.columns)
    shared = outside.unionByName(free_)
    kept = shared.groupBy("h", "g").agg(F.min(F.struct("doc_id", "doc", "first")).alias("kept"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h", "g", "kept")
    return cut(shared.join(kept, ["h", "g"]).where("doc <> kept.doc"), "hits")


SPAN = ["doc", "doc_id", "kept_doc", "kept_doc_id", "away", "lo", "hi", "start", "end"]


def joined(rows: DataFrame) -> DataFrame:
    """Spans (SPAN) that overlap or touch, at one distance to one document, as one; first and last rows' ``h``, ``g`` too if there."""
    by = Window.partitionBy("doc", "kept_doc", "away").orderBy("lo", "hi")
    until = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(F.col("lo") <= until, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    seeds = [F.min_by(F.struct("h", "g"), "lo").alias("head"), F.max_by(F.struct("h", "g"), "lo").alias("tail")] if "h" in rows.columns else []
    return marked.groupBy("doc", "kept_doc", "away", "run").agg(*(F.first(c).alias(c) for c in ("doc_id", "kept_doc_id")), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("start").alias("start"), F.max("end").alias("end"), *seeds).drop("run")


def grown(docs: DataFrame, hits: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans (SPAN) around the end seeds of ``runs``, out to the last word that an earlier document shares."""
    whole = Window.partitionBy("doc")
    left = F.max("hi").over(whole.orderBy("lo").rangeBetween(Window.unboundedPreceding, -1)) >= F.col("lo")
    right = F.min("lo").over(whole.orderBy(F.desc("hi")).rangeBetween(Window.unboundedPreceding, -1)) <= F.col("hi")
    bare = runs.withColumn("l", F.coalesce(left, F.lit(False))).withColumn("r", F.coalesce(right, F.lit(False)))
    heads = bare.where("NOT l").select("doc", F.col("lo").alias("first"), F.lit(0).alias("side"), "head.*")
    tails = bare.where("NOT r").select("doc", (F.col("hi") - PASSAGE_WORDS).alias("first"), F.lit(1).alias("side"), "tail.*")
    ends = cut(heads.unionByName(tails), "ends")
    places = hits.join(ends.select("h", "g", "side").distinct(), ["h", "g"]).withColumn("pos", F.when(F.col("side") == 0, F.col("first")).otherwise(F.col("first") + PASSAGE_WORDS))
    kept_pos = F.when(F.col("side") == 0, F.col("kept.first")).otherwise(F.col("kept.first") + PASSAGE_WORDS)
    places = cut(places.withColumn("kept_pos", kept_pos), "places")
    wanted = places.select("doc", "pos", "side").unionByName(places.select(F.col("kept.doc").alias("doc"), F.col("kept_pos").alias("pos"), "side")).distinct()
    around = cut(contexts(docs, wanted), "around")
    theirs = around.select(F.col("doc").alias("kept_doc"), F.col("pos").alias("kept_pos"), "side", F.col("words").alias("others"))
    state = places.join(around, ["doc", "pos", "side"]).withColumn("kept_doc", F.col("kept.doc")).join(theirs, ["kept_doc", "kept_pos", "side"])
    state = cut(state.withColumn("n", alike("words", "others")).drop("others", "kept_doc", "kept_pos"), "state")
    # places that go on alike beyond what their kept one shares: the longest words that an earlier document has too
    key = F.xxhash64(F.slice("words", 1, F.col("n") + 1)).alias("node")
    on = state.where(F.size("words") > F.col("n")).drop("kept").withColumn("node", key)
    at = ["h", "g", "side", "n", "node"]
    several = on.groupBy(*at).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select(*at)
    long_ = on.join(several, at).drop("node").withColumn("n", F.explode(F.sequence(F.col("n") + 1, F.size("words"))))
    long_ = cut(long_.withColumn("node", F.xxhash64(F.slice("words", 1, "n"))).withColumn("reach", F.element_at("at", F.col("n") + 1)).drop("words", "at"), "longer")
    firsts = long_.groupBy(*at).agg(F.min(F.struct("doc_id", "doc", "first")).alias("kept"), F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select(*at, "kept")
    longest = long_.join(firsts, at).where("doc <> kept.doc").groupBy("doc", "first", "h", "g", "side")
    longest = longest.agg(F.max(F.struct("n", "reach", "kept", "doc_id", "start", "end")).alias("m")).select("doc", "first", "side", "m.*")
    found = state.withColumn("reach", F.element_at("at", F.col("n") + 1)).select(*longest.columns).unionByName(longest)
    rows = found.join(ends.select("doc", "first", "side").distinct(), ["doc", "first", "side"], "left_semi")
    left_side = F.col("side") == 0
    out = rows.select(
        "doc",
        "doc_id",
        F.col("kept.doc").alias("kept_doc"),
        F.col("kept.doc_id").alias("kept_doc_id"),
        (F.col("first") - F.col("kept.first")).alias("away"),
        F.when(left_side, F.col("first") - F.col("n")).otherwise(F.col("first")).alias("lo"),
        (F.col("first") + PASSAGE_WORDS + F.when(left_side, 0).otherwise(F.col("n"))).alias("hi"),
        F.when(left_side, F.col("reach")).otherwise(F.col("start")).alias("start"),
        F.when(left_side, F.col("end")).otherwise(F.col("reach")).alias("end"),
    )
    out = cut(out, "grown")
    free(ends, places, around, state, long_)
    return out


def passages(docs: DataFrame, seeds: DataFrame, gone: DataFrame) -> DataFrame:
    """Spans (SPAN) of words that an earlier document has."""
    hits = hits_of(seeds, gone)
    each = hits.select("doc", "doc_id", F.col("kept.doc").alias("kept_doc"), F.col("kept.doc_id").alias("kept_doc_id"), (F.col("first") - F.col("kept.first")).alias("away"), F.col("first").alias("lo"), (F.col("first") + PASSAGE_WORDS).alias("hi"), "start", "end", "h", "g")
    runs = cut(joined(each), "runs")
    wide = grown(docs, hits, runs)
    free(hits)
    return joined(runs.select(*SPAN).unionByName(wide.select(*SPAN)))


def repeats(docs: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """What is to be removed: a row per paragraph or passage that another document has before.

    ``doc`` (hash of doc_id and text), ``doc_id``, ``kind`` (paragraph or passage),
    ``start``, ``end`` (bytes of the text), ``n_words``, ``cluster_id``, ``kept_doc_id``.
    """
    found = cut(find_units(docs), "units")
    order = F.struct("doc_id", "doc", "start", "end")
    lines = found.where("seeds IS NULL").drop("seeds")
    classes = cut(lines.groupBy("h").agg(F.min(order).alias("first"), F.max("doc").alias("hi"), F.min("doc").alias("lo"), F.first("bands").alias("bands")), "classes")
    links = paragraph_links(docs, classes, jaccard)
    groups = cut(components(links).withColumnRenamed("node", "h"), "groups")
    some, _ = split_by_keys(classes.select("h", "first"), groups, "h")
    firsts = some.join(groups, "h").groupBy("root").agg(F.min("first").alias("kept"))
    grouped = groups.join(firsts, "root").select("h", "root", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.doc").alias("kept_doc"))
    alone = classes.where("lo < hi").join(groups, "h", "left_anti").select("h", F.col("h").alias("root"), F.col("first.doc_id").alias("kept_doc_id"), F.col("first.doc").alias("kept_doc"))
    known = cut(grouped.unionByName(alone), "known")
    maybe, _ = split_by_keys(lines.drop("bands"), known, "h")
    paragraphs = maybe.join(known, "h").where("doc <> kept_doc").select("doc", "doc_id", F.lit("paragraph").alias("kind"), "start", "end", F.col("words").alias("n_words"), F.col("root").alias("cluster_id"), "kept_doc_id")
    paragraphs = cut(paragraphs, "paragraphs")
    free(classes, links, groups, known)

    seeds = found.where("seeds IS NOT NULL").select("doc", "doc_id", F.inline("seeds"))
    spans_ = cut(passages(docs, seeds, paragraphs.select("doc", "start", "end")), "passages")
    free(found)
    cluster = F.xxhash64("kept_doc", F.col("lo") - F.col("away"))
    rows = spans_.select("doc", "doc_id", F.lit("passage").alias("kind"), "start", "end", (F.col("hi") - F.col("lo")).cast("int").alias("n_words"), cluster.alias("cluster_id"), "kept_doc_id")
    return paragraphs.unionByName(rows)


def remove(docs: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """``docs`` without its repeats, ``n_chars`` set anew; a document of which no word is left goes."""
    names = docs.columns
    doc, marked = unused(names, "_doc", "_mark")
    found = repeats(docs, jaccard).groupBy(F.col("doc").alias(doc)).agg(F.collect_set(F.array("start", "end")).alias(marked))  # a document's own spans
    marks = cut(found, "spans")
    maybe, clear = split_by_keys(docs.withColumn(doc, _key()), marks, doc)

    def without(text: str, mark: list[list[int]]) -> str | None:
        raw, at, keep = text.encode(), 0, []
        for a, b in sorted(map(tuple, mark)):
            a = max(a, at)
            if b <= at:
                continue
            # a whole line goes with its newline
            if b < len(raw) and raw[b] == 10 and (a == 0 or raw[a - 1] == 10):
                b += 1
            elif b == len(raw) and a > at and raw[a - 1] == 10:
                a -= 1
            keep.append(raw[at:a])
            at = b
        left = b"".join([*keep, raw[at:]]).decode()
        return left if left.strip() else None

    both = maybe.join(marks, doc, "left")
    same = both.where(F.col(marked).isNull()).select(*names)
    changed = edit_text(both.where(F.col(marked).isNotNull()), names, marked, without).where("text IS NOT NULL")
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.length("text").cast("long"))
    return clear.select(*names).unionByName(same).unionByName(changed.select(*names))


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and passages of all ``documents`` that another document has before."""
    return repeats(read_table(spark, sf_dir, "documents"))
