"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``ORDER`` bytes with frozen
counts. A context with ``n`` observations of ``d`` distinct bytes codes a byte
seen ``c`` times there with ``-log2(c / (n + d))`` bits and any other with an
escape, ``-log2(d / (n + d))`` bits, and the context shorter by one byte; a
context never seen costs nothing to leave; below order 0 bytes are equally
likely. A text's code length is the sum over all its bytes, and its language the
one with the shortest code. Lengths are integers (1/1024 bit), so sums are exact
and depend on no order.

Texts are normalised first: ASCII and Latin-1 capitals as small letters, every
run of ASCII signs, digits and white space as one space, three spaces before the
text. All 256 bytes are told apart.

Training is on a bounded sample: of each language the ``PER_LANGUAGE`` rows with
the least hash of id and text, whole; rows equal in both count once. There may be
any number of languages. Grams are counted in Spark and kept in a table of the
shared folder, which workers read; their tables are sparse, ``CHUNK`` languages at
a time. Labels and ids choose the sample only; a prediction sees the text alone.

Null texts and texts without a letter give ``und`` with score 0, as does
everything if there is nothing to learn from. ``score`` is the posterior of the
chosen language under equal priors, ties go to the lesser name. A null doc_id is
never held out and never learned from. Repeated rows get equal rows; an empty
table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, cut, fs_of, read_table, split_by_keys, text_buffer, tidy
from .words import LOWER

ORDER = 3
PER_LANGUAGE = 400
#: Languages whose tables are built and looked up together.
CHUNK = 16
UNIT = 1024

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def normalise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of a block's rows, each after three spaces, and their offsets."""
    n, rows = len(buf), len(offsets) - 1
    low = LOWER[buf]
    after = np.zeros(n, bool)
    after[1:] = buf[:-1] == 0xC3
    capital = after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
    low = np.where(capital, low + 32, low).astype(np.uint8)
    low[~_LETTER[buf]] = 32
    row = np.repeat(np.arange(rows), np.diff(offsets))
    out = np.full(n + 3 * rows, 32, np.uint8)
    at = np.arange(n) + 3 * (row + 1)
    out[at] = low
    keep = np.ones(len(out), bool)
    keep[at] = (low != 32) | np.append(True, low[:-1] != 32)[:n] if n else keep[at]
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[at[starts]] = low[starts] != 32  # the pad is space enough
    done = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], done[offsets + 3 * np.arange(rows + 1)]


@dataclass
class Counts:
    """What is learned: names in order, and for each language and order the contexts' bytes as codes with counts."""

    names: list[str]
    grams: list[list[tuple[np.ndarray, np.ndarray]]]


def count_grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (code, count) pairs of orders 0 to ORDER in texts. In a code the last byte is the lowest digit, the one before the next, and so on."""
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    x, at = normalise(buf, offs)
    scored = np.ones(len(x), bool)
    for k in range(3):
        scored[at[:-1] + k] = False
    y, pos = x.astype(np.int64), np.flatnonzero(scored)
    code, out = y[pos].copy(), []
    for k in range(ORDER + 1):
        if k:
            code |= y[pos - k] << 8 * k
        out.append(np.unique(code, return_counts=True))
    return out


class Index:
    """Places of codes in a sorted array of distinct ones, found by open addressing; -1 for others."""

    def __init__(self, codes: np.ndarray):
        bits = max(8, int(4 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        code, rest = codes.astype(np.uint64) + np.uint64(1), np.arange(len(codes))
        at = self._slot(code)
        while len(rest):
            _, one = np.unique(at, return_index=True)
            won = one[self.key[at[one]] == 0]
            self.key[at[won]], self.value[at[won]] = code[rest[won]], rest[won]
            on = np.ones(len(rest), bool)
            on[won] = False
            rest, at = rest[on], at[on]
            at = np.where(self.key[at] != 0, (at + 1) & self.mask, at)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        code = codes.astype(np.uint64) + np.uint64(1)
        at = self._slot(code)
        have = self.key[at]
        out = self.value[at]
        out[have != code] = -1
        rest = np.flatnonzero((have != code) & (have != 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & self.mask
            have = self.key[at]
            hit = have == code[rest]
            out[rest[hit]] = self.value[at[hit]]
            on = ~hit & (have != 0)
            rest, at = rest[on], at[on]
        return out


class Tables:
    """Code lengths (1/UNIT bit) by gram and language, of some languages: what any of them has seen, each order in turn."""

    def __init__(self, grams: list[list[tuple[np.ndarray, np.ndarray]]]):
        n = self.n = len(grams)
        self.grams: list[tuple[Index, np.ndarray]] = []  # of each order: codes, lengths
        self.contexts: list[tuple[Index, np.ndarray]] = []  # codes, lengths of the escape
        below: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(ORDER + 1):
            codes = np.unique(np.concatenate([g[k][0] for g in grams])).astype(np.int64)
            outer = np.unique(codes >> 8)
            cost, escape = np.full((len(codes), n), np.inf), np.zeros((len(outer), n))
            for lang, g in enumerate(grams):
                code, c = g[k][0].astype(np.int64), g[k][1]
                context = np.searchsorted(outer, code >> 8)
                seen, kinds = np.bincount(context, c, len(outer)), np.bincount(context, minlength=len(outer))
                met = kinds > 0
                escape[met, lang] = -np.log2(kinds[met] / (seen + kinds)[met])
                cost[np.searchsorted(codes, code), lang] = -np.log2(c / (seen + kinds)[context])
            lower = np.full((len(codes), n), 8.0) if below is None else below[1][np.searchsorted(below[0], codes & ((1 << 8 * k) - 1))]
            missed = escape[np.searchsorted(outer, codes >> 8)] + lower
            cost = np.where(np.isinf(cost), missed, cost)
            below = (codes, cost)
            self.grams.append((Index(codes), np.rint(cost * UNIT).astype(np.int32)))
            self.contexts.append((Index(outer), np.rint(escape * UNIT).astype(np.int32)))

    def costs(self, code: np.ndarray) -> np.ndarray:
        """The length of the last byte of each code, given the three before it."""
        found, cost = self.grams[ORDER]
        row = found.find(code)
        out = cost[row]
        rest = np.flatnonzero(row < 0)
        left = code[rest]
        total = np.zeros((len(rest), self.n), np.int32)
        for k in range(ORDER, -1, -1):
            if not len(rest):
                return out
            index, escape = self.contexts[k]
            at = index.find((left & ((1 << 8 * (k + 1)) - 1)) >> 8)
            total += np.where(at[:, None] >= 0, escape[at], 0)
            if not k:
                break
            found, cost = self.grams[k - 1]
            row = found.find(left & ((1 << 8 * k) - 1))
            hit = row >= 0
            out[rest[hit]] = total[hit] + cost[row[hit]]
            rest, left, total = rest[~hit], left[~hit], total[~hit]
        out[rest] = total + 8 * UNIT
        return out


class Model:
    """Frozen counts of all languages."""

    def __init__(self, counts: Counts):
        self.names = counts.names
        self.tables = [Tables(counts.grams[i : i + CHUNK]) for i in range(0, len(counts.names), CHUNK)]

    def lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths (1/UNIT bit) of a block's rows in every language."""
        x, at = normalise(buf, offsets)
        out = np.zeros((len(offsets) - 1, len(self.names)), np.int64)
        if len(x) < 4:
            return out
        y = x.astype(np.int64)
        code = y[3:] | y[2:-1] << 8 | y[1:-2] << 16 | y[:-3] << 24
        skip = np.zeros(len(y), bool)
        for k in range(3):
            skip[at[:-1] + k] = True
        step = 1 << 17
        for t, table in enumerate(self.tables):
            total = np.zeros(table.n, np.int64)
            done = np.zeros((len(y) + 1, table.n), np.int64)
            for lo in range(0, len(code), step):
                c = table.costs(code[lo : lo + step])
                c[skip[3 + lo : 3 + lo + len(c)]] = 0
                part = np.cumsum(c, 0, dtype=np.int64) + total
                done[4 + lo : 4 + lo + len(c)] = part
                total = part[-1]
            out[:, t * CHUNK : t * CHUNK + table.n] = done[np.maximum(at[1:], 3)] - done[np.maximum(at[:-1], 3)]
        return out

    def predict(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = lengths.argmin(1)
        gap = np.minimum((lengths - lengths.min(1, keepdims=True)) / UNIT, 1000.0)
        return best, 1 / np.exp2(-gap).sum(1)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> str | None:
    """The folder of a table of gram counts from a bounded sample of ``docs`` (``doc_id``, ``text``, ``lang``); None if no row has a label."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(5), "doc_id", "lang", "text").alias("key"))
    order = Window.partitionBy("lang").orderBy("key")
    ids = rows.groupBy("lang", "key").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    chosen = cut(ids.select("key", "k"), "chosen")
    maybe, _ = split_by_keys(rows, chosen, "key")
    sample = maybe.join(chosen, "key").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for k, (code, n) in enumerate(count_grams([t for x, t in zip(langs, texts) if x == lang])):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "k", "code", "n"])

    counted = sample.select("lang", "text").mapInArrow(tidy(run), "lang string, k int, code long, n long")
    table = cut(counted.groupBy("lang", "k", "code").agg(F.sum("n").alias("n")), "grams")
    return table.cut_path if table.limit(1).count() else None


def read_counts(folder: str) -> Counts:
    """The counts of a folder that :func:`learn` gave."""
    files, at = fs_of(folder)
    t = pq.read_table(at, filesystem=files)
    names = sorted(t.column("lang").unique().to_pylist())
    lang = np.searchsorted(np.array(names, object), t.column("lang").to_numpy())
    k, code, n = (t.column(c).to_numpy() for c in ("k", "code", "n"))
    order = np.lexsort((code, k, lang))
    lang, k, code, n = lang[order], k[order], code[order], n[order]
    cuts = np.searchsorted(lang * (ORDER + 1) + k, np.arange(len(names) * (ORDER + 1) + 1))
    parts = [(code[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return Counts(names, [parts[i : i + ORDER + 1] for i in range(0, len(parts), ORDER + 1)])


#: The last model that this worker read, by its folder, which no other model ever has.
_models: dict[str, Model] = {}


def identify(docs: DataFrame, folder: str | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of every row of ``docs`` (``doc_id``, ``text``) by the counts of ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder is not None and folder not in _models:
            _models.clear()
            _models[folder] = Model(read_counts(folder))
        model = None if folder is None else _models[folder]
        for b in batches:
            buf, offs = text_buffer(b.column(1))
            letters = np.concatenate([[0], np.cumsum(_LETTER[buf] & (buf < 128))])
            plain = letters[offs[1:]] > letters[offs[:-1]]
            for lo, hi in blocks(offs):
                if model is None:
                    names, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                else:
                    best, score = model.predict(model.lengths(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                    names = [model.names[k] for k in best.tolist()]
                    for i in np.flatnonzero(~plain[lo:hi]).tolist():
                        text = b.column(1)[lo + i].as_py()
                        if not text or not any(map(str.isalpha, text)):
                            names[i], score[i] = "und", 0.0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document's remainder keeps it out of training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
