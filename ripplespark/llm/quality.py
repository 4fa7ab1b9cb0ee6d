"""Quality rules: base counts of each document, and cross-document line frequency.

Lines are normalised (ASCII capitals as small letters, words joined by one
space) and hashed. A host is a ``source``. Documents of a host with the same
normalised lines count as one, so exact copies don't make their own text look
like boilerplate. A line that more distinct documents of its host hold than the
limit, ``max(LEAST_DOCS, LEAST_SHARE * distinct documents of the host)``, is
removed. A document of which less than ``LEAST_LEFT`` of the words are left is
depleted and rejected.

One pass over the texts; the rest works on hashes. Counts are keyed by (host,
line), so a hot host spreads over all tasks; the join of lines with the few
frequent ones is salted by document, so a hot line does too.

Null and empty texts have no words (``base_failed``, not kept). A null source is
a host like any other. Repeated rows, and rows sharing a ``doc_id``, are each
judged and returned. An empty table gives no rows. Other columns are ignored by
``judge`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut, drop_keys, edit_text, read_table, split_by_keys, text_buffer, tidy, unused
from .words import LOWER, P, Q, SPACE, Words, mix, shingles, spans, sums

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
LEAST_DOCS = 20
LEAST_SHARE = 0.01
LEAST_LEFT = 0.5
SALTS = 16
#: Frequent lines (8 bytes each) that may be sent to all tasks.
MOST_FREQUENT = 1_000_000

SCHEMA = "uid long, row_key long, doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<long>, line_words array<int>"


def _counts(groups: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups, minlength=n)


class Lines:
    """Lines with a word of a block: ``row``, first and one past the last word, and bytes ``start``, ``end`` of the whole line."""

    def __init__(self, w: Words, buf: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(buf == 10)
        before = np.searchsorted(breaks, w.start)
        key = before + w.row
        new = np.ones(len(key), bool)
        new[1:] = np.diff(key) != 0
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(key)) if len(key) else self.first
        self.row = w.row[self.first]
        at = before[self.first]
        padded = np.concatenate([[-1], breaks, [len(buf)]])
        self.start = np.maximum(padded[at] + 1, offsets[self.row])
        self.end = np.minimum(padded[at + 1], offsets[self.row + 1])


def folded(w: Words, buf: np.ndarray, lines: Lines) -> np.ndarray:
    """Hashes of the normalised lines."""
    prefix = sums(LOWER[buf].astype(np.uint64) + np.uint64(1), P)
    return spans(sums(spans(prefix, w.start, w.end, P), Q), lines.first, lines.last, Q)


def measure_block(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list]:
    """Base counts of each row of a block, and its distinct normalised lines with their words."""
    n = len(offsets) - 1
    w = Words(buf, offsets)
    lines = Lines(w, buf, offsets)

    def total(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags)])
        return c[offsets[1:]] - c[offsets[:-1]]

    chars = total(((buf & 0xC0) != 0x80) & ~SPACE[buf])
    out: dict[str, np.ndarray | list] = {"n_words": w.counts, "word_chars": chars, "n_symbols": total(SYMBOLS[buf])}

    whole = mix(spans(w.prefix, lines.start, lines.end, P) ^ mix(lines.row.astype(np.uint64)))
    _, kept = np.unique(whole, return_index=True)
    out["n_dup_lines"] = _counts(lines.row, n) - _counts(lines.row[kept], n)

    h, at = shingles(w, 3)
    _, inverse, count = np.unique(mix(h ^ mix(w.row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    cover = np.zeros(len(w.hash) + 3, np.int64)
    cover[again] += 1
    cover[again + 3] -= 1
    out["n_repeat_words"] = _counts(w.row[np.cumsum(cover)[: len(w.hash)] > 0], n)

    line = folded(w, buf, lines)
    first = np.searchsorted(lines.row, np.arange(n + 1))
    out["content"] = spans(sums(line, P), first[:-1], first[1:], P).view(np.int64)
    order = np.lexsort((line, lines.row))
    l, r, words = line[order], lines.row[order], (lines.last - lines.first)[order]
    new = np.ones(len(l), bool)
    new[1:] = (np.diff(l) != 0) | (np.diff(r) != 0)
    start = np.flatnonzero(new)
    out["line"], out["line_row"] = l[start].view(np.int64), r[start]
    out["words_of_line"] = np.add.reduceat(words, start) if len(start) else words
    return out


def measure(docs: DataFrame) -> DataFrame:
    """Counts and line hashes of every row of ``docs`` (``doc_id``, ``source``, ``text``); ``uid`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            buf, offs = text_buffer(b.column(2))
            for lo, hi in blocks(offs):
                m = measure_block(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                first = pa.array(np.searchsorted(m["line_row"], np.arange(hi - lo + 1)).astype(np.int32))
                columns = [
                    pa.array(uid + np.arange(hi - lo)),
                    b.column(3).slice(lo, hi - lo),
                    b.column(0).slice(lo, hi - lo),
                    b.column(1).slice(lo, hi - lo),
                    *(pa.array(np.asarray(m[k], np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content")),
                    pa.ListArray.from_arrays(first, pa.array(m["line"])),
                    pa.ListArray.from_arrays(first, pa.array(m["words_of_line"].astype(np.int32))),
                ]
                uid += hi - lo
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    doc, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    return docs.select(doc, source, text, F.xxhash64(F.lit(31), doc, source, text).alias("row_key")).mapInArrow(tidy(run), SCHEMA)


def frequent_lines(measured: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Rows ``host`` (hash), ``line``: lines above the limit of their host."""
    host = F.xxhash64(F.col("source"), F.col("source").isNull())
    once = measured.groupBy(host.alias("host"), "content").agg(F.first("lines").alias("lines"))
    once = cut(once, "hosts")
    hosts = once.groupBy("host").agg(F.count("*").alias("docs"))
    counts = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    return counts.join(hosts, "host").where(F.col("n") >= F.greatest(F.lit(float(least_docs)), F.col("docs") * least_share)).select("host", "line")


def verdict(measured: DataFrame, frequent: DataFrame, key: str, least_left: float = LEAST_LEFT) -> tuple[DataFrame, DataFrame]:
    """Verdicts of measured rows, and removed lines (``key``, ``line``)."""
    host = F.xxhash64(F.col("source"), F.col("source").isNull()).alias("host")
    held = measured.select("uid", key, host, F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    held = held.select("uid", key, "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"), F.pmod("uid", F.lit(SALTS)).alias("salt"))
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    removed = cut(held.join(salted, ["host", "line", "salt"]).select("uid", key, "line", "words"), "removed")
    lost = removed.groupBy("uid").agg(F.sum("words").alias("removed_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.drop("lines", "line_words", "content").join(lost, "uid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_words") - F.col("removed_words") >= least_left * F.col("n_words")))
    return out.drop("uid", "source"), removed.select(key, "line")


def judge(docs: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, least_left: float = LEAST_LEFT) -> tuple[DataFrame, DataFrame]:
    """Verdicts of every row (op6's columns, ``removed_words``), and removed lines (``doc_id``, ``line``)."""
    measured = cut(measure(docs), "measured")
    verdicts, removed = verdict(measured, cut(frequent_lines(measured, least_docs, least_share), "frequent"), "doc_id", least_left)
    return verdicts.drop("row_key"), removed


def _strip(raw: bytes, start: np.ndarray) -> bytes:
    """A text without the lines that begin at ``start``."""
    at = set(start.tolist())
    keep, pos = [], 0
    for line in raw.split(b"\n"):
        if pos not in at or not line.strip():
            keep.append(line)
        pos += len(line) + 1
    return b"\n".join(keep)


def clean_rows(docs: DataFrame, frequent: np.ndarray, least_left: float = LEAST_LEFT) -> DataFrame:
    """``docs`` without rejected rows and frequent lines, judged row by row where they lie.

    ``frequent``: sorted hashes of (host, line); their number is checked by the caller.
    """
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    host = F.xxhash64(F.col("source").cast("string"), F.col("source").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = held.value, names.index("text")
        for b in batches:
            buf, offs = text_buffer(b.column(at))
            hosts = b.column(len(names)).to_numpy().view(np.uint64)
            for lo, hi in blocks(offs):
                part, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                m = measure_block(part, o)
                w = Words(part, o)
                lines = Lines(w, part, o)
                key = mix(folded(w, part, lines) ^ hosts[lo:hi][lines.row])
                gone = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
                lost = np.bincount(lines.row[gone], (lines.last - lines.first)[gone], hi - lo)
                n, again = m["n_words"], m["n_repeat_words"]
                kept = ~((n < 50) | (100 * again > 50 * n)) & (n - lost >= least_left * n)
                rows = np.flatnonzero(kept)
                texts = []
                for r in rows.tolist():
                    raw = part[o[r] : o[r + 1]].tobytes()
                    mine = lines.start[gone & (lines.row == r)] - o[r] if lost[r] else None
                    texts.append((raw if mine is None else _strip(raw, mine)).decode())
                columns = [c.take(pa.array(rows + lo)) for c in b.columns[:-1]]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*names, host.alias(unused(names, "_host")[0])).mapInArrow(tidy(run), docs.schema)


def without_lines(docs: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """``docs`` with its removed lines (``key``, ``line``) cut out of ``text``."""
    maybe, clear = split_by_keys(docs, removed, key)
    names = docs.columns
    mark = unused(names, "_mark")[0]
    marks = removed.groupBy(key).agg(F.collect_set("line").alias(mark))  # a document's own lines

    def strip(text: str, lines_gone: list[int]) -> str:
        raw = text.encode()
        buf, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        w = Words(buf, offs)
        lines = Lines(w, buf, offs)
        return _strip(raw, lines.start[np.isin(folded(w, buf, lines).view(np.int64), np.asarray(lines_gone, np.int64))]).decode()

    return clear.unionByName(edit_text(maybe.join(marks, key, "left"), names, mark, strip))


def clean(docs: DataFrame, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """``docs`` without rejected rows, and without the frequent lines of those that stay; ``n_chars`` is set anew.

    Frequent lines are few (each is in a share of its host's documents). Up to
    ``most_frequent`` of them are sent to all tasks, which judge their rows where
    they lie; beyond that rows are joined by a hash of their id, source and text.
    Both ways give the same rows.
    """
    measured = cut(measure(docs), "measured")
    frequent = cut(frequent_lines(measured), "frequent")
    n = frequent.count()
    if n <= most_frequent:
        pairs = frequent.toPandas()
        key = np.sort(mix(pairs["line"].to_numpy(np.int64).view(np.uint64) ^ pairs["host"].to_numpy(np.int64).view(np.uint64)))
        out = clean_rows(docs, key)
    else:
        verdicts, removed = verdict(measured, frequent, "row_key")
        key = unused(docs.columns, "row_key")[0]
        keyed = docs.withColumn(key, F.xxhash64(F.lit(31), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")))
        rejected = cut(verdicts.where("NOT kept").select(F.col("row_key").alias(key)), "verdicts")
        out = without_lines(drop_keys(keyed, rejected, key), removed.withColumnRenamed("row_key", key), key).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all ``documents``."""
    return judge(read_table(spark, sf_dir, "documents"))[0]


OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT uid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d
), win AS (
  SELECT uid, i, count(*) OVER (PARTITION BY uid, a, b, c) AS n
  FROM (SELECT uid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT uid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
), rep AS (
  SELECT uid, count(DISTINCT i + k) AS n FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY uid
), ln AS (
  SELECT uid, coalesce(source, '') AS src, source IS NULL AS no_src, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw
  FROM (SELECT uid, source, unnest(string_split(text, chr(10))) AS line FROM d)
), lines AS (
  SELECT uid, src, no_src, line, len(lw) AS words,
         translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM ln WHERE len(lw) > 0
), dup AS (
  SELECT uid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY uid
), content AS (
  SELECT d.uid, coalesce(d.source, '') AS src, d.source IS NULL AS no_src,
         array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')), lambda x: len(x) > 0),
           lambda x: translate(array_to_string(x, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), chr(10)) AS content
  FROM d
), hosts AS (
  SELECT src, no_src, count(DISTINCT content) AS docs FROM content GROUP BY ALL
), freq AS (
  SELECT src, no_src, norm
  FROM (SELECT l.src, l.no_src, norm, count(DISTINCT content) AS n FROM lines l JOIN content c USING (uid) GROUP BY ALL) JOIN hosts USING (src, no_src)
  WHERE n >= greatest({LEAST_DOCS}, docs * {LEAST_SHARE})
), gone AS (
  SELECT uid, sum(words) AS n FROM lines SEMI JOIN freq USING (src, no_src, norm) GROUP BY uid
), base AS (
  SELECT d.uid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM d JOIN w USING (uid) LEFT JOIN dup USING (uid) LEFT JOIN rep USING (uid) LEFT JOIN gone USING (uid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, removed_words::BIGINT AS removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= {LEAST_LEFT} * n_words AS kept
FROM base
"""
