"""Token ids in a binary format of grammar-compressed shards (Re-Pair).

Documents are range-partitioned by ``doc_id`` into shards of about ``SHARD_BYTES``
of text, and sorted; each partition writes one shard file. A shard's ids are
compressed by Re-Pair: pairs of neighbouring symbols are counted exactly, and
frequent pairs become nonterminals, the more frequent of two that overlap first,
until no pair is left that occurs ``LEAST`` times. That is done first within words,
each distinct word once with its occurrences as weight, then over whole documents.
Occurrences are replaced without overlap, never across a document's end. A
nonterminal's parts come from earlier rounds only.

File: ``RPR1``, a header of six little-endian 64-bit counts (documents, ids,
symbols, base symbols, rules, version), then document numbers, a validity byte
for each, first id and first symbol of each document (and one past the last),
rules (left, right), the rules' expansion lengths, and symbols in two planes
(low 16 bits, high 8 or 16 bits): fixed widths, so any document's symbols are
found and expanded without reading the rest.

Null and empty texts hold the end id alone. A null ``doc_id`` is kept and sorts
first. Rows with one ``doc_id`` all stay, ordered by a hash of the text, and may
lie in more than one shard. An empty table gives no rows. Other columns are
ignored, whatever their names. Files appear whole or not at all and depend only on
the shard's rows, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import blocks, fs_of, new_path, publish, read_table, text_buffer, tidy
from .tokens import gather

MAGIC = b"RPR1"
#: A rule takes 12 bytes and saves 3 bytes an occurrence.
LEAST = 8
#: Bytes of text of a shard.
SHARD_BYTES = 20 << 20


def _frequent(keys: np.ndarray, least: int, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur ``least`` times (in weight), sorted, and how often."""
    if weights is None:
        keys = np.sort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(keys)))
        keys = keys[start]
    else:
        keys, inverse = np.unique(keys, return_inverse=True)
        count = np.bincount(inverse, weights, len(keys))
    often = count >= least
    return keys[often], count[often]


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each key in ``known`` (sorted), -1 for others."""
    bits = 22
    slot = lambda k: ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
    maybe = np.zeros(1 << bits, bool)
    maybe[slot(known)] = True
    out = np.full(len(keys), -1, np.int32)
    some = np.flatnonzero(maybe[slot(keys)])
    at = np.minimum(np.searchsorted(known, keys[some]), len(known) - 1)
    hit = known[at] == keys[some]
    out[some[hit]] = at[hit]
    return out


def repair(seq: np.ndarray, stop: np.ndarray, top: int, weights: np.ndarray | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs replaced until none occurs ``least`` times: the shorter sequence, its stops, and the new rules as rows (left, right).

    ``stop``: symbols after which no pair may reach. ``top``: the first free
    symbol. ``weights``: occurrences of each symbol's place, where ``seq`` holds
    distinct strings. A round takes every frequent pair that no more frequent one
    overlaps, so at least the most frequent of all. Only places whose pair may still
    be frequent are looked at again: an old pair never becomes more frequent.
    """
    n = len(seq)
    seq, stop = seq.astype(np.uint32), stop.copy()
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    alive, rank = np.ones(n, bool), np.zeros(n + 1, np.int32)
    rules: list[np.ndarray] = []
    at = np.flatnonzero(~stop[: max(0, n - 1)]).astype(np.int32)
    while len(at):
        left, right = seq[at], seq[after[at]]
        key = left.astype(np.uint64)
        key <<= np.uint64(32)
        key |= right
        # of a run of one symbol every other pair counts
        apart = np.ones(len(at), bool)
        same = np.flatnonzero(left == right)
        if len(same):
            begins = np.ones(len(same), bool)
            begins[1:] = (after[at[same[:-1]]] != at[same[1:]]) | (left[same[1:]] != left[same[:-1]])
            begin = np.maximum.accumulate(np.where(begins, np.arange(len(same)), 0))
            apart[same[(np.arange(len(same)) - begin) % 2 == 1]] = False
        often, count = _frequent(key[apart], least, None if weights is None else weights[at[apart]])
        if not len(often):
            break
        which = _among(key, often)
        at, which, apart = at[which >= 0], which[which >= 0], apart[which >= 0]
        order = np.empty(len(often), np.int32)
        order[np.argsort(count, kind="stable")] = 1 + np.arange(len(often))
        now, kind = at[apart], which[apart]
        rank[now] = order[kind]
        won = (rank[now] > rank[before[now]]) & (rank[now] > rank[after[now]])  # place -1 and n have none
        rank[now] = 0
        now, kind = now[won], kind[won]
        pays = np.bincount(kind, None if weights is None else weights[now], len(often)) >= least
        name = np.zeros(len(often), np.uint32)
        name[pays] = top + np.arange(int(pays.sum()), dtype=np.uint32)
        top += int(pays.sum())
        rules.append(np.stack([(often[pays] >> np.uint64(32)).astype(np.uint32), (often[pays] & np.uint64(0xFFFFFFFF)).astype(np.uint32)], 1))
        now, kind = now[pays[kind]], kind[pays[kind]]
        gone = after[now]
        seq[now], stop[now], alive[gone] = name[kind], stop[gone], False
        after[now] = after[gone]
        inner = after[now] < n
        before[after[now][inner]] = now[inner]
        near = np.concatenate([at, now, before[now][before[now] >= 0]])
        near = near[alive[near]]
        flag = np.zeros(n, bool) if len(near) > n // 16 else None
        if flag is None:
            at = np.unique(near)
        else:
            flag[near] = True
            at = np.flatnonzero(flag).astype(np.int32)
        at = at[~stop[at] & (after[at] < n)]
    return seq[alive], stop[alive], np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _layers(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules whose parts all come before the range."""
    most, lo = rules.max(1).astype(np.int64) if len(rules) else np.zeros(0, np.int64), 0
    while lo < len(rules):
        hi, step = lo + 1, 1024
        while hi < len(rules):
            late = np.flatnonzero(most[hi : hi + step] >= base + lo)
            if len(late):
                hi += int(late[0])
                break
            hi, step = min(len(rules), hi + step), step * 2
        yield lo, hi
        lo = hi


def sizes_of(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each symbol expands to."""
    size = np.ones(base + len(rules), np.int64)
    for lo, hi in _layers(rules, base):
        size[base + lo : base + hi] = size[rules[lo:hi]].sum(1)
    return size


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every symbol one after another, and where each symbol's begin."""
    first = np.concatenate([[0], np.cumsum(sizes_of(rules, base))])
    flat = np.empty(first[-1], np.uint32)
    flat[:base] = np.arange(base)
    for lo, hi in _layers(rules, base):
        flat[first[base + lo] : first[base + hi]] = gather(flat, first, rules[lo:hi].ravel().astype(np.int64))[0]
    return flat, first


def encode_shard(doc_ids: list[int | None], words: np.ndarray, doc_words: np.ndarray, flat: np.ndarray, first: np.ndarray) -> bytes:
    """A shard file's bytes. Document i is the strings ``words[doc_words[i]:doc_words[i+1]]``, string j the ids ``flat[first[j]:first[j+1]]``.

    Pairs are replaced within strings first, each distinct string once with its
    occurrences as weight, then in whole documents.
    """
    uses = np.bincount(words, minlength=len(first) - 1)
    used = np.flatnonzero(uses)
    flat, done = gather(flat, first, used)
    sizes = np.diff(np.concatenate([[0], done]))
    place = np.zeros(len(uses), np.int32)
    place[used] = np.arange(len(used))
    words, uses = place[words], uses[used]
    base = int(flat.max()) + 1 if len(flat) else 0
    first_id = np.concatenate([[0], np.cumsum(sizes[words])])[doc_words]

    some = np.flatnonzero(sizes)
    stop = np.zeros(len(flat), bool)
    stop[np.cumsum(sizes[some]) - 1] = True
    weights = np.repeat(uses.astype(np.float64), sizes)
    flat, stop, rules = repair(flat, stop, base, weights)
    first = np.zeros(len(used) + 1, np.int64)
    first[some + 1] = np.diff(np.concatenate([[0], np.flatnonzero(stop) + 1]))
    first = np.cumsum(first)
    out, ends = [], []
    n = 0
    for k in range(0, len(words), 1 << 20):
        part, done = gather(flat, first, words[k : k + (1 << 20)])
        out.append(part)
        ends.append(done + n)
        n += len(part)
    seq = np.concatenate(out) if out else flat[:0]
    ends = np.concatenate([[0], *ends]).astype(np.int64)[doc_words]
    stop = np.zeros(len(seq), bool)
    stop[ends[1:][np.diff(ends) > 0] - 1] = True
    seq, stop, more = repair(seq, stop, base + len(rules))
    first_symbol = np.zeros(len(doc_words), np.int64)
    first_symbol[1:][np.diff(ends) > 0] = np.diff(np.concatenate([[0], np.flatnonzero(stop) + 1]))
    rules = np.concatenate([rules, more])
    size = sizes_of(rules, base).astype(np.uint32)
    wide = base + len(rules) > 1 << 24
    return b"".join(
        [
            MAGIC,
            struct.pack("<6Q", len(doc_words) - 1, int(first_id[-1]), len(seq), base, len(rules), 1),
            np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes(),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            first_id.astype(np.int64).tobytes(),
            np.cumsum(first_symbol).tobytes(),
            rules.astype(np.uint32).tobytes(),
            size[base:].tobytes(),
            seq.astype(np.uint16).tobytes(),
            (seq >> np.uint32(16)).astype(np.uint16 if wide else np.uint8).tobytes(),
        ]
    )


class Shard:
    """A shard file, read as needed: ``doc(i)`` touches the symbols of document ``i`` only."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.n, self.n_ids, symbols, self.base, rules, _ = struct.unpack_from("<6Q", data, 4)
        at = 52

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        number, valid = take(np.int64, self.n), take(np.uint8, self.n)
        self.doc_ids = [int(d) if v else None for d, v in zip(number, valid)]
        self.first_id, self.first_symbol = take(np.int64, self.n + 1), take(np.int64, self.n + 1)
        self.rules = take(np.uint32, 2 * rules).reshape(-1, 2)
        self.sizes = take(np.uint32, rules)
        self.low = take(np.uint16, symbols)
        self.high = take(np.uint16 if self.base + rules > 1 << 24 else np.uint8, symbols)
        self.flat, self.first = expansions(self.rules, self.base)

    def expand(self, a: int, b: int) -> np.ndarray:
        """Ids of the symbols ``[a, b)``."""
        s = self.low[a:b].astype(np.int64) | (self.high[a:b].astype(np.int64) << 16)
        return gather(self.flat, self.first, s)[0]

    def doc(self, i: int) -> np.ndarray:
        """Ids of document ``i``."""
        return self.expand(self.first_symbol[i], self.first_symbol[i + 1])


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Write ``docs`` (``doc_id``, ``text``) to shard files in ``folder``; a row per file: shard, path, n_docs, n_ids, n_symbols, n_bytes.

    ``shards``: how many, by default as ``SHARD_BYTES`` says. The frame is lazy: files are written when it runs.
    """
    tokenizer = tokenizer or tokens.default_path()
    text = F.col("text").cast("string")
    n = shards or max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        enc.begin()
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        last = enc.add(np.array([end_id], np.uint32))
        for b in batches:
            buf, offs = text_buffer(b.column(1))
            names += b.column(0).to_pylist()
            for lo, hi in blocks(offs):
                words, first = enc.numbers(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                parts.append(np.insert(words, first[1:], last))
                counts.append(np.diff(first) + 1)
        if names:
            path = f"{folder}/shard-{shard:06d}.rpr"
            doc_words = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
            words = np.concatenate(parts)
            parts.clear()
            data = encode_shard(names, words, doc_words, enc.strings.flat, enc.strings.first)
            publish(path, data)
            _, n_ids, n_symbols, *_ = struct.unpack_from("<6Q", data, 4)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(names)], "n_ids": [n_ids], "n_symbols": [n_symbols], "n_bytes": [len(data)]})

    # rows equal in id and text may be many, so their places in the input divide them
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("nth"))
    sorted_docs = keyed.repartitionByRange(n, "doc_id", "h", "nth").sortWithinPartitions("doc_id", "h", "nth").select("doc_id", "text")
    return sorted_docs.mapInArrow(tidy(run), "shard int, path string, n_docs long, n_ids long, n_symbols long, n_bytes long")


def read_shards(files: DataFrame) -> DataFrame:
    """Documents of the shard files (rows ``shard``, ``path``, ``n_ids``), decoded: doc_id, start, n_tokens, ids_crc32, shard."""
    # one row a file: the running sum is over the number of files, not of documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                files, at = fs_of(row["path"])
                with files.open_input_stream(at) as f:
                    shard = Shard(f.read())
                n = shard.n
                sums = np.empty(n, np.int64)
                per = max(1, int(n * (1 << 20) // max(1, shard.n_ids)))
                for lo in range(0, n, per):
                    hi = min(n, lo + per)
                    data = memoryview(shard.expand(shard.first_symbol[lo], shard.first_symbol[hi]).tobytes())
                    a = (4 * (shard.first_id[lo : hi + 1] - shard.first_id[lo])).tolist()
                    sums[lo:hi] = [zlib.crc32(data[a[i] : a[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(row["first"] + shard.first_id[:-1]), pa.array(np.diff(shard.first_id)), pa.array(sums), pa.array(np.full(n, row["shard"], np.int32))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    spread = starts.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op10_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as grammar-compressed shard files in the shared folder, then read back from them."""
    folder = new_path(spark, "shards")
    listing = f"{folder}/listing"
    write_shards(read_table(spark, sf_dir, "documents"), folder).write.parquet(listing)
    return read_shards(spark.read.parquet(listing))
