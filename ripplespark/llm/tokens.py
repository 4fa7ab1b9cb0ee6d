"""Exact token ids of whole texts with a public tokenizer file, a word cache in front.

A tokenizer whose pre-tokenizer drops white space, and whose normaliser never
joins characters across it, gives a text the ids of its space-separated chunks
in order. Such a tokenizer is asked only for chunks not met before: chunks are
numbered, their ids lie one after another in one array, and a text is a row of
numbers, found for a whole block at once. A chunk is told by its bytes, never by a
hash alone: up to ``SHORT`` bytes as two numbers and a length, longer ones in a
dictionary. Any other tokenizer gets whole texts. The numbering is bounded and begun
anew when full, which affects speed only.
"""

from __future__ import annotations

import json
import string
from itertools import compress, filterfalse

import numpy as np

from .words import Words

#: Strings that are numbered before the numbering begins anew, and names of a generation that strings are made of.
ENTRIES = 1_000_000
NAMES = 200_000
#: Ids of a string, on average, beyond which the numbering is full too.
IDS_EACH = 8
#: Bytes of a chunk that is looked up with its whole block.
SHORT = 16


#: Marks after a word that the tokenizer reads apart from it, as one.
MARKS = string.punctuation
SIGMA = "\u03a3"
#: A chunk ends at a space or newline; the tokenizer sees to other white space.
_ENDS = np.zeros(256, bool)
_ENDS[[10, 32]] = True
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    """The file of the default public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, entries: int | None = None, names: int | None = None) -> "Encoder":
    """The process's encoder for a tokenizer file; its numbering begins anew where the bounds differ from those before."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, entries, names)
    found = _encoders[path]
    if (found.entries, found.most_names) != (entries, names):
        found.entries, found.most_names = entries, names
        found.clear()
    return found


def splits_at_spaces(spec: dict) -> bool:
    """Whether chunks between spaces are encoded alone; judged on the tokenizer's own description."""

    def parts(x: dict | None, many: str) -> list[dict]:
        return [] if x is None else x[many] if x["type"] == "Sequence" else [x]

    norms, pres = parts(spec.get("normalizer"), "normalizers"), parts(spec.get("pre_tokenizer"), "pretokenizers")
    calm = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in norms)
    first = pres[0] if pres else {}
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") and "(?" not in first["pattern"]["Regex"]
    return calm and drops and all(not p.get("add_prefix_space") for p in pres)


def gather(flat: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings ``which`` of ``flat`` (string i is ``flat[first[i]:first[i+1]]``) one after another, and where each ends."""
    begin = first[which]
    size = first[which + 1] - begin
    done = np.cumsum(size)
    return flat[np.arange(done[-1] if len(done) else 0) + np.repeat(begin - (done - size), size)], done


class Strings:
    """Strings of ids by number, in growing arrays; number 0 is the empty string."""

    def __init__(self) -> None:
        self._flat, self._first = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)
        self.n, self.size = 1, 0

    def __len__(self) -> int:
        return self.n

    @property
    def flat(self) -> np.ndarray:
        return self._flat[: self.size]

    @property
    def first(self) -> np.ndarray:
        return self._first[: self.n + 1]

    def add(self, ids: np.ndarray, ends: np.ndarray) -> int:
        """Add strings; the number of the first of them."""
        at, size = self.n, self.size
        while size + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        while at + len(ends) + 1 > len(self._first):
            self._first = np.concatenate([self._first, np.empty_like(self._first)])
        self._flat[size : size + len(ids)] = ids
        self._first[at + 1 : at + 1 + len(ends)] = size + ends
        self.n, self.size = at + len(ends), size + len(ids)
        return at


class Table:
    """Numbers by short strings (two numbers of eight bytes, and how many bytes): open addressing, whole arrays at a time."""

    SIZE = 26  # a value's bits below the string's size

    def __init__(self, bits: int = 21):
        self.bits, self.mask, self.n = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.head, self.tail, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def room(self, more: int) -> bool:
        """Whether three quarters at most are used with ``more`` strings."""
        return 4 * (self.n + more) <= 3 * (self.mask + 1)

    def find(self, slot: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each string, -1 where there is none. ``slot``: 64-bit hashes, which only say where to look."""
        out = np.full(len(slot), -1, np.int32)
        at, rest = (slot >> self.bits).astype(np.int64), np.arange(len(slot))
        while len(rest):
            have = self.value[at]
            hit = (self.head[at] == head[rest]) & (self.tail[at] == tail[rest]) & (have >> self.SIZE == size[rest])
            out[rest[hit]] = have[hit] & ((1 << self.SIZE) - 1)
            on = ~hit & (have >= 0)
            rest, at = rest[on], (at[on] + 1) & self.mask
        return out

    def insert(self, slot: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray, value: np.ndarray) -> None:
        """Add strings that aren't there; the caller sees to :meth:`room`."""
        self.n += len(slot)
        at, rest = (slot >> self.bits).astype(np.int64), np.arange(len(slot))
        while len(rest):
            free = np.flatnonzero(self.value[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            k = at[won]
            self.head[k], self.tail[k], self.value[k] = head[rest[won]], tail[rest[won]], value[rest[won]] | (size[rest[won]] << self.SIZE)
            on = np.ones(len(rest), bool)
            on[won] = False
            rest, at = rest[on], (at[on] + 1) & self.mask


def _eight(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as a number, zero beyond its end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(buf) + 1, 8), (1, 1))
    x = np.ascontiguousarray(view[np.minimum(start, len(buf))]).view("<u8").ravel()
    size = np.clip(end - start, 0, 8).astype(np.uint64)
    return np.where(size == 8, x, x & ((np.uint64(1) << (size * np.uint64(8))) - np.uint64(1)))


class Encoder:
    """``entries``, ``names``: bounds of its tables, by default ``ENTRIES`` and ``NAMES``."""

    def __init__(self, path: str, entries: int | None = None, names: int | None = None):
        from tokenizers import Tokenizer

        self.entries, self.most_names = entries, names
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_chunk = splits_at_spaces(spec)
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        mark = spec["model"].get("end_of_word_suffix") if spec["model"]["type"] == "BPE" else None
        lower = any(x["type"] == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", []))
        self.ends = None
        if self.by_chunk and mark and lower:
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1 + len(self.special), bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(mark)]] = True
        self._reset()

    def _reset(self) -> None:
        self.strings, self.table, self.long = Strings(), Table(self._bits(self.entries or ENTRIES)), {}
        self.names: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}

    @staticmethod
    def _bits(n: int) -> int:
        """Bits of a table that ``n`` strings fill to a half at most."""
        return max(4, (2 * n - 1).bit_length())

    def begin(self) -> None:
        """Begin the numbering anew if it is full, by strings or by their ids, or cleared. Numbers given before are void then."""
        most = self.entries or ENTRIES
        if self.table is None or len(self.strings) > most or self.strings.size > IDS_EACH * most or len(self.long) > most // 4:
            self._reset()

    def clear(self) -> None:
        """Give up all tables, as at the end of a task: idle workers then hold the tokenizer alone."""
        self.strings, self.table, self.long, self.names, self.old = Strings(), None, {}, {"": 0}, {}

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text straight from the library."""
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def add(self, ids: np.ndarray) -> int:
        """Number one string of ids."""
        return self.strings.add(ids, np.array([len(ids)]))

    def _name(self, part: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        at = self.strings.add(ids, ends)
        self.names.update(zip(part, range(at, at + len(part))))

    def _learn_any(self, chunks: list[str]) -> None:
        """Ids of chunks by their places in one joined text."""
        for k in range(0, len(chunks), 10_000):
            part = chunks[k : k + 10_000]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids = np.asarray(e.ids, np.uint32)
            at = np.fromiter((a for a, _ in e.offsets), np.int64, len(ids))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            self._name(part, ids, np.searchsorted(at, ends))

    def _learn_plain(self, words: list[str]) -> None:
        """Ids of words of letters alone: each ends with its one id that has the word-end mark."""
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            ids = np.asarray(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                self._name(part, ids, cuts)
            else:  # the normaliser took some word apart
                self._learn_any(part)

    def _unknown(self, names: set[str]) -> list[str]:
        """Names that aren't numbered; those of the old generation are moved."""
        new = names.difference(self.names)
        again = list(filter(self.old.__contains__, new))
        self.names.update(zip(again, map(self.old.__getitem__, again)))
        return list(new.difference(again)) if again else list(new)

    def learn(self, chunks: list[str]) -> np.ndarray:
        """Numbers of new distinct chunks. Letters are encoded in lower case and apart from the marks after them, where the tokenizer reads them so."""
        if len(self.names) > (self.most_names or NAMES):
            self.old, self.names = self.names, {"": 0}
        if self.ends is None:
            self._learn_any(self._unknown(set(chunks)))
            return np.fromiter(map(self.names.__getitem__, chunks), np.int32, len(chunks))
        words = [c.rstrip(MARKS) for c in chunks]
        plain = list(map(str.isalpha, words))
        if SIGMA in "".join(words):  # the only letter whose small form depends on its place
            plain = [p and SIGMA not in w for p, w in zip(plain, words)]
        low = list(map(str.lower, words))
        self._learn_plain(self._unknown(set(compress(low, plain))))
        marks = [c[len(w) :] if p else "" for c, w, p in zip(chunks, words, plain)]
        bases = [x if p else c for c, x, p in zip(chunks, low, plain)]
        self._learn_any(self._unknown({*marks, *filterfalse(self.names.__contains__, bases)}))
        n, get = len(chunks), self.names.__getitem__
        first, second = np.fromiter(map(get, bases), np.int32, n), np.fromiter(map(get, marks), np.int32, n)
        two = np.flatnonzero(second)
        if len(two):
            ids, done = gather(self.strings.flat, self.strings.first, np.stack([first[two], second[two]], 1).ravel())
            at = self.strings.add(ids, done[1::2])
            first[two] = np.arange(at, at + len(two))
        return first

    def numbers(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A block's rows as numbers of ``strings``, one row after another, and where each begins (and one past the last)."""
        raw, rows = buf.tobytes(), len(offsets) - 1
        if not self.by_chunk:
            return np.array([self.add(self.whole(raw[a:b].decode())) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int32), np.arange(rows + 1)
        w = Words(buf, offsets, _ENDS)
        size = w.end - w.start
        head, tail = _eight(buf, w.start, w.end), _eight(buf, w.start + 8, w.end)
        some = np.flatnonzero(size <= SHORT)
        short = [w.hash[some], head[some], tail[some], size[some].astype(np.int32)]
        out = np.zeros(len(size), np.int32)
        out[some] = self.table.find(*short)
        miss = np.flatnonzero(out[some] < 0)
        if len(miss):
            same = np.lexsort([short[k][miss] for k in (3, 2, 1)])
            miss = miss[same]
            fresh = np.ones(len(miss), bool)
            fresh[1:] = np.any([short[k][miss[1:]] != short[k][miss[:-1]] for k in (1, 2, 3)], 0)
            new = miss[fresh]
            at = some[new]
            made = self.learn([raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist())])
            if not self.table.room(len(new)):  # one block may hold more than the table; numbers given before stay good
                self.table = Table(self._bits(max(len(new), self.entries or ENTRIES)))
            self.table.insert(*(x[new] for x in short), made)
            out[some[miss]] = made[np.cumsum(fresh) - 1]
        rare = np.flatnonzero(size > SHORT)
        if len(rare):
            spans = [raw[a:b] for a, b in zip(w.start[rare].tolist(), w.end[rare].tolist())]
            new = list(set(spans).difference(self.long))
            if new:
                self.long.update(zip(new, self.learn([x.decode() for x in new]).tolist()))
            out[rare] = np.fromiter(map(self.long.__getitem__, spans), np.int32, len(spans))
        first = w.first
        if any(s in raw for s in self.special):
            parts = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                odd = any(s in raw[a:b] for s in self.special)
                parts.append(np.array([self.add(self.whole(raw[a:b].decode()))], np.int32) if odd else out[first[i] : first[i + 1]])
            out, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, first

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's rows one after another, each followed by ``end_id`` if given, and where each row ends."""
        self.begin()
        words, first = self.numbers(buf, offsets)
        if end_id is not None:
            words = np.insert(words, first[1:], self.add(np.array([end_id], np.uint32)))
            first = first + np.arange(len(first))
        ids, done = gather(self.strings.flat, self.strings.first, words)
        return ids, np.concatenate([[0], done])[first[1:]].astype(np.int64)
