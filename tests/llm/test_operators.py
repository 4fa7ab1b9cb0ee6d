"""The corpus operators against brute force, exact round trips and planted cases."""

import itertools
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ripplespark.llm import ann, binary, html, langid, mixing, packing, paragraphs, quality, sharding, simhash, tokens, words
from ripplespark.llm.common import drop_keys
from ripplespark.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang=None, source=None, ids=None):
    n = len(texts)
    rows = [(i if ids is None else ids[i], t, lang[i] if lang else "en", source[i] if source else f"s{i % 3}", len(t or "")) for i, t in zip(range(n), texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=4000, prefix="w"):
    return " ".join(f"{prefix}{k}" for k in rng.integers(0, vocabulary, n))


#: Nulls, empty, very long, ties, repeats, odd characters.
ODD = [None, "", "   \n\t ", "a", "the same text here", "the same text here", "x " * 60_000, "é́ ΑΣ İ 🎉 <|endoftext|> don't 12", "\x00\x01   b", "###\n$$$\n", "\n".join(["line one two three"] * 50)]


def odd(spark):
    d = docs(spark, ODD, source=[None, "s"] + ["s"] * (len(ODD) - 2), ids=[None, 1, 2, 3, 4, 4, 6, 7, 8, 9, 10])
    names = ["size", "h", "uid", "line", "lines", "band", "shard", "first", "node", "group_id", "row", "s", "k", "i", "l", "block", "bucket", "part", "nth", "host", "t1", "_x", "_slot", "_word", "_bits", "_doc", "_mark", "_host", "row_key", "mix_shard", "mix_key", "n", "kept", "label"]
    return d.select("*", *(F.lit(n).alias(n) for n in names))


OPERATORS = {
    "langid": lambda d: langid.identify(d, langid.learn(d)),
    "simhash": simhash.near_duplicates,
    "keep_one": simhash.keep_one,
    "repeats": paragraphs.repeats,
    "remove": paragraphs.remove,
    "judge": lambda d: quality.judge(d)[0],
    "clean": quality.clean,
    "mix": mixing.mix,
    "pack": packing.pack,
    "shard": sharding.shard,
}
#: Operators that return each row once.
WHOLE = {"langid", "simhash", "judge", "shard"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    out = OPERATORS[name](odd(spark)).collect()
    if name in WHOLE:
        assert len(out) == len(ODD)
    assert len({tuple(map(str, r)) for r in OPERATORS[name](odd(spark).repartition(3)).collect()} ^ {tuple(map(str, r)) for r in out}) == 0 or name in ("pack", "mix")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](odd(spark).limit(0)).count() == 0


def test_word_hashes():
    rows = ["the cat sat", "", " a\nb  the ", "x" * 300]
    raw = [r.encode() for r in rows]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w = words.Words(buf, offs)
    assert [buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == ["the", "cat sat", "a", "b", "the", "x" * 300]
    assert w.row.tolist() == [0, 0, 2, 2, 2, 3] and w.counts.tolist() == [2, 0, 3, 1]
    assert w.hash[0] == w.hash[4] and len(set(w.hash.tolist())) == 5


def block(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_token_ids_are_the_librarys():
    e = tokens.Encoder(tokens.default_path())
    rng = np.random.default_rng(1)
    alphabet = list("abcdXYZ éÀßΣσİ'.,!#1²́ \t\n") + ["<|endoftext|>", "🎉", "क़", "'s", "ﬁ"]
    texts = [t for t in ODD] + ["".join(rng.choice(alphabet, 80)) for _ in range(200)] + [prose(rng, 300) for _ in range(20)]
    for _ in range(2):  # the second time from the table
        ids, ends = e.encode(*block(texts), 1)
        at = 0
        for t, b in zip(texts, ends):
            assert ids[at:b].tolist() == [*e.tok.encode(t or "", add_special_tokens=False).ids, 1]
            at = b
    import public_tokenizers

    other = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_chunk
    ids, ends = other.encode(*block(texts[:20]))
    assert ids.tolist() == [i for t in texts[:20] for i in other.tok.encode(t or "", add_special_tokens=False).ids]


def test_numbering_begins_anew(monkeypatch):
    monkeypatch.setattr(tokens, "ENTRIES", 50)
    monkeypatch.setattr(tokens, "NAMES", 20)
    e, rng = tokens.Encoder(tokens.default_path()), np.random.default_rng(2)
    for _ in range(12):
        t = [prose(rng, 30, 60), prose(rng, 30, 60).title()]
        assert e.encode(*block(t))[0].tolist() == [i for x in t for i in e.whole(x).tolist()]


def test_one_block_may_hold_more_strings_than_the_table():
    e = tokens.Encoder(tokens.default_path(), 50, 20)
    text = " ".join(f"w{i}" for i in range(600))
    for t in (text, "w1 w2 w599", text + " more"):
        assert e.encode(*block([t]))[0].tolist() == e.whole(t).tolist()


def test_packing_has_small_token_tables():
    e = tokens.encoder(tokens.default_path(), packing.ENTRIES, packing.NAMES)
    rng = np.random.default_rng(5)
    for _ in range(30):
        at = rng.integers(0, 1 << 40, 20_000).tolist()
        e.encode(*block([" ".join(f"{i:x}"[:7] for i in at)]), 1)
    held = [e.table.head, e.table.tail, e.table.value, e.strings._flat, e.strings._first]
    assert sum(x.nbytes for x in held) < 48 << 20 and len(e.names) + len(e.old) < 200_000
    assert tokens.encoder(tokens.default_path()) is e and e.table is None  # the numbering of other bounds is void


def test_hash_table_collisions():
    t = tokens.Table(4)
    slot, head = np.zeros(12, np.uint64), np.arange(12, dtype=np.uint64)  # all in one slot
    size = np.full(12, 3, np.int32)
    t.insert(slot, head, head, size, np.arange(12, dtype=np.int32))
    assert t.find(slot, head, head, size).tolist() == list(range(12)) and (t.find(slot, head, head + np.uint64(20), size) == -1).all() and (t.find(slot, head, head, size + 1) == -1).all()


def test_strings_of_one_hash_get_their_own_ids():
    # of 2**11 letters by the parity of ones in their place's number: equal hashes modulo 2**64 whatever the base
    even = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    odd_ = "".join("ba"[bin(i).count("1") % 2] for i in range(2048))
    w = words.Words(*block([even, odd_]))
    assert w.hash[0] == w.hash[1]
    e = tokens.Encoder(tokens.default_path())
    texts = [even, odd_, "a\0", "a", "a\0\0", "ninebytes", "ninebytes\0", "x" * 16, "x" * 17]
    for _ in range(2):
        ids, ends = e.encode(*block(texts))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [e.whole(t).tolist() for t in texts]


def library_ids(texts):
    e = tokens.Encoder(tokens.default_path())
    return [np.append(e.whole(t or ""), np.uint32(1)) for t in texts]


def test_packing(spark):
    rng = np.random.default_rng(3)
    texts = ODD + [prose(rng, int(n)) for n in rng.integers(1, 3000, 20)]
    out = packing.pack(docs(spark, texts).repartition(3)).toPandas()
    ids = library_ids(texts)
    for d, g in out.groupby("doc_id"):
        g, at = g.sort_values("start"), 0
        for r in g.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes()) and r.doc_tokens == len(ids[d])
            at += r.length
        assert at == len(ids[d])
        rest = g["length"][g["length"] < 2048]
        assert rest.is_unique and all(x & (x - 1) == 0 for x in rest)
    assert sorted(out["sequence_id"]) == list(range(len(out))) and (out["offset"] == 0).all()
    assert (out.sort_values("sequence_id")["length"].diff().dropna() <= 0).all()  # bucket by bucket
    with pytest.raises(ValueError):
        packing.piece_lengths(5, 100)


def test_shard_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = ODD + [prose(rng, int(n), 300) for n in rng.integers(1, 900, 40)]
    d = docs(spark, texts, ids=[100 - i for i in range(len(texts))]).repartition(5)
    listing = binary.write_shards(d, f"file://{tmp_path}/s", shards=4)
    listing.write.parquet(f"{tmp_path}/listing")
    out = binary.read_shards(spark.read.parquet(f"{tmp_path}/listing")).toPandas().sort_values("doc_id")
    ids = library_ids(texts)[::-1]
    assert out["doc_id"].tolist() == sorted(100 - i for i in range(len(texts)))
    assert out["n_tokens"].tolist() == [len(i) for i in ids] and out["start"].tolist() == [0, *np.cumsum([len(i) for i in ids])[:-1]]
    assert out["ids_crc32"].tolist() == [zlib.crc32(i.tobytes()) for i in ids]
    stats = spark.read.parquet(f"{tmp_path}/listing").toPandas()
    assert stats["n_symbols"].sum() < 0.8 * stats["n_ids"].sum()  # it compresses
    first = binary.Shard(open(f"{tmp_path}/s/shard-000000.rpr", "rb").read())
    for i, x in enumerate(first.doc_ids):  # random access
        assert first.doc(i).tolist() == ids[out["doc_id"].tolist().index(x)].tolist()
    assert {len(first.flat[first.first[first.base + i] : first.first[first.base + i + 1]]) == s for i, s in enumerate(first.sizes)} <= {True}
    with pytest.raises(ValueError):
        binary.Shard(b"junk" * 20)


def test_repair_never_crosses_documents():
    seq = np.array([5, 6] * 40 + [7] * 31, np.uint32)
    stop = np.zeros(len(seq), bool)
    stop[[4, 79, -1]] = True
    out, ends, rules = binary.repair(seq, stop, 8)
    flat, first = binary.expansions(rules, 8)
    grown = tokens.gather(flat, first, out.astype(np.int64))[0]
    assert grown.tolist() == seq.tolist() and len(out) < len(seq) / 3
    sizes = np.diff(first)[out]
    assert {4, 79, len(seq) - 1} <= set((np.cumsum(sizes) - 1).tolist())


def plain_repair(docs_, least):
    """Re-Pair one pair after another, by its definition: the symbols left, and the rules."""
    from collections import Counter

    top, rules = 1000, 0
    while True:
        counts = Counter()
        for d in docs_:
            i = 0
            last = None
            for i in range(len(d) - 1):
                pair = (d[i], d[i + 1])
                if pair == last:  # of a run of one symbol every other pair counts
                    last = None
                    continue
                counts[pair] += 1
                last = pair if d[i] == d[i + 1] else None
        if not counts or counts.most_common(1)[0][1] < least:
            return docs_, rules
        pair = counts.most_common(1)[0][0]
        for k, d in enumerate(docs_):
            out, i = [], 0
            while i < len(d):
                if tuple(d[i : i + 2]) == pair:
                    out.append(top)
                    i += 2
                else:
                    out.append(d[i])
                    i += 1
            docs_[k] = out
        top, rules = top + 1, rules + 1


@pytest.mark.parametrize("seed", range(6))
def test_repair_goes_on_until_no_pair_pays(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 40, 300)
    parts = [np.where(rng.random(300) < 0.02, rng.integers(0, 40, 300), base) for _ in range(40)] + [rng.integers(0, 5, 60), np.zeros(37, int)]
    seq = np.concatenate(parts).astype(np.uint32)
    stop = np.zeros(len(seq), bool)
    stop[np.cumsum([len(p) for p in parts]) - 1] = True
    out, ends, rules = binary.repair(seq, stop, 1000)
    flat, first = binary.expansions(rules, 1000)
    assert tokens.gather(flat, first, out.astype(np.int64))[0].tolist() == seq.tolist()
    left, pairs = 0, {}
    for i in range(len(out) - 1):
        if not ends[i] and not (out[i] == out[i + 1] and left == i and i):
            pairs[out[i], out[i + 1]] = pairs.get((out[i], out[i + 1]), 0) + 1
            left = i + 1
    assert max(pairs.values()) < binary.LEAST + 1
    want, n = plain_repair([p.tolist() for p in parts], binary.LEAST)
    assert len(out) + 4 * len(rules) < 1.1 * (sum(map(len, want)) + 4 * n)  # a rule takes as much as four symbols


def test_equal_rows_lie_in_many_shards(spark, tmp_path):
    texts = ["the same text of many rows"] * 400 + [None, ""]
    d = docs(spark, texts, ids=[7] * 400 + [None, None]).repartition(4).withColumn("h", F.lit("x")).withColumn("nth", F.lit("y"))
    listing = binary.write_shards(d, f"file://{tmp_path}/s", shards=5)
    listing.write.parquet(f"{tmp_path}/listing")
    files = spark.read.parquet(f"{tmp_path}/listing")
    assert files.count() == 5 and files.agg(F.max("n_docs")).first()[0] < 200
    out = binary.read_shards(files).toPandas().sort_values("start")
    ids = library_ids(texts)
    assert out["n_tokens"].tolist() == [1, 1] + [len(ids[0])] * 400 and out["start"].tolist() == [0, *np.cumsum(out["n_tokens"])[:-1]]
    assert out["doc_id"].isna().tolist() == [True, True] + [False] * 400 and (out["ids_crc32"][2:] == zlib.crc32(ids[0].tobytes())).all()
    binary.write_shards(d.limit(0), f"file://{tmp_path}/none").write.parquet(f"{tmp_path}/empty")
    assert binary.read_shards(spark.read.parquet(f"{tmp_path}/empty")).count() == 0


def test_sharding(spark):
    rng = np.random.default_rng(5)
    texts = [prose(rng, int(n)) for n in rng.integers(5, 60, 1500)]
    texts += [texts[0]] * 40
    out = sharding.shard(docs(spark, texts), 16).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 16 and loads.max() <= loads.mean() * 1.03 and loads.min() >= loads.mean() * 0.9
    out["text"] = [texts[i] for i in out["doc_id"]]
    assert (out.groupby("text")["shard"].nunique() == 1).all()
    assert [sorted(g) for _, g in out.groupby("shard")["slot"]] == [list(range(n)) for n in out.groupby("shard").size()]
    assert all(r.size == len(r.text.encode()) + 1 and r.text_crc32 == zlib.crc32(r.text.encode()) for r in out.head(50).itertuples())


def test_sharding_splits_only_what_no_shard_can_hold(spark):
    rng = np.random.default_rng(6)
    texts = ["hot text of many copies " * 20] * 500 + [prose(rng, 60) for _ in range(1000)]
    out = sharding.shard(docs(spark, texts), 8).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert loads.max() / loads.mean() < 1.06 and out[out["doc_id"] >= 500].shape[0] == 1000


def test_only_the_giant_of_a_unit_is_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 4)
    monkeypatch.setattr(sharding, "SUBCELLS", 2)
    rng = np.random.default_rng(48)
    small = [prose(rng, 30) for _ in range(60)]
    texts = ["hot text of many copies " * 20] * 400 + [x for x in small for _ in range(5)]
    out = sharding.shard(docs(spark, texts), 4).toPandas()
    out["text"] = [texts[i] for i in out["doc_id"]]
    spread = out.groupby("text")["shard"].nunique()
    assert spread[texts[0]] > 1 and (spread[small] == 1).all()


def test_shards_are_those_of_a_plain_ring(spark):
    rng = np.random.default_rng(49)
    texts = [prose(rng, int(n)) for n in rng.integers(5, 60, 4000)]
    d = docs(spark, texts)
    out = sharding.shard(d, 4).toPandas().set_index("doc_id")["shard"]
    key = F.xxhash64(F.lit(17), F.col("text"), F.octet_length("text"))
    places = d.select("doc_id", F.pmod(key, F.lit(sharding.CELLS)).cast("int").alias("c"), F.pmod(F.shiftright(key, 20), F.lit(sharding.SUBCELLS)).cast("int").alias("s")).collect()
    size = {i: len(t.encode()) + 1 for i, t in enumerate(texts)}
    mean = sum(size.values()) / 4
    most, by_cell, by_unit = mean / sharding.HEAVY, {}, {}
    for r in places:
        by_cell[r["c"]] = by_cell.get(r["c"], 0) + size[r["doc_id"]]
    unit = {r["doc_id"]: (r["c"], r["s"] if by_cell[r["c"]] > most else -1) for r in places}
    for i, u in unit.items():
        by_unit[u] = by_unit.get(u, 0) + size[i]
    nodes = sorted((sharding._hash(1, s, k) % sharding.CELLS, sharding._hash(2, s, k), s) for s in range(4) for k in range(sharding.NODES))
    room, want = dict.fromkeys(range(4), int(np.ceil(mean * (1 + sharding.SLACK)))), {}
    for u in sorted(by_unit, key=lambda u: (-by_unit[u] if by_unit[u] > most else 0, sharding._hash(3, u[0] + 1, u[1] + 1, 0), u)):
        ring = [s for place, _, s in nodes if place >= u[0]] + [s for place, _, s in nodes if place < u[0]]
        want[u] = next(s for s in ring if room[s] >= by_unit[u])
        room[want[u]] -= by_unit[u]
    assert all(out[i] == want[u] for i, u in unit.items())
    loads = pd.Series(size).groupby(out).sum()
    assert loads.max() <= mean * (1 + sharding.SLACK) + 1


def test_ring_moves_little():
    cells = np.random.default_rng(7).permutation(sharding.CELLS)[:4000].tolist()
    a, b = sharding.Ring(16, 4000), sharding.Ring(17, 4000)
    moved = sum(a.place(c, 1) != b.place(c, 1) for c in cells)
    assert moved < 4000 * 0.3


def test_mix_targets():
    sizes, weights = [100, 10, 1000, 50], [5, 2, 1, 5]
    t = mixing.targets(sizes, weights)
    assert sum(t) == pytest.approx(1.5 * 1160) and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes)) and t[0] == 200
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_splitting_tree():
    draws = np.array([40, 0, 7, 133])
    tree = mixing.split(draws, 16, 3)
    assert tree.sum(0).tolist() == draws.tolist() and tree.min() >= 0
    assert tree.sum(1).max() - tree.sum(1).min() <= 1
    assert (tree == mixing.split(draws, 16, 3)).all()


def test_mixing(spark):
    rng = np.random.default_rng(8)
    source = ["big"] * 900 + ["mid"] * 300 + [None] * 200 + ["a"] * 5
    texts = [prose(rng, int(n)) for n in rng.integers(1, 80, len(source))]
    d = docs(spark, texts, source=source)
    out = {}
    for part in (1, 7):
        drawn = mixing.draw(*mixing.plan(d.repartition(part))).toPandas()
        drawn["taken"] = drawn["size"] * drawn["shards"].map(len)
        out[part] = drawn.sort_values("doc_id")[["doc_id", "taken", "shards"]].map(lambda x: tuple(x) if isinstance(x, (list, np.ndarray)) else x).values.tolist()
    assert out[1] == out[7]  # reruns agree, however rows lie
    drawn["source"] = [source[i] or "￿" for i in drawn["doc_id"]]
    sizes = drawn.groupby("source")["size"].sum()
    aim = mixing.targets(sizes.tolist(), [5, 2, 1, 5])
    for (name, g), t in zip(drawn.groupby("source"), aim):
        assert g["target"].iloc[0] == pytest.approx(t) and abs(g["taken"].sum() - t) <= max(0.02 * t, 40), name
    assert (drawn["taken"] <= 2 * drawn["size"]).all() and len(drawn) == len(source)
    mixed = mixing.mix(d).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    want = {i: len(s) for i, s in zip(drawn["doc_id"], drawn["shards"]) if len(s)}
    assert mixed.to_dict() == want
    assert mixing.mix(d).groupBy("mix_shard").count().count() == 16


def test_mixing_of_more_sources_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 10)
    monkeypatch.setattr(mixing, "STRATA", 8)
    rng = np.random.default_rng(45)
    source = [f"s{k:03d}" for k in rng.integers(0, 300, 3000)] + [None]
    texts = [prose(rng, int(n)) for n in rng.integers(1, 60, len(source))]
    rows, sources, blocks, taken = mixing.plan(docs(spark, texts, source=source))
    got = {r["source"]: r["target"] for r in sources.collect()}
    order = sorted(got, key=lambda x: (x is None, x or ""))
    sizes = pd.Series([len(t.split()) for t in texts]).groupby([x or "￿" for x in source]).sum()
    want = mixing.targets([int(sizes[x or "￿"]) for x in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    assert [got[x] for x in order] == pytest.approx(want)
    drawn = mixing.draw(rows, sources, blocks, taken).toPandas()
    drawn["taken"] = drawn["size"] * drawn["shards"].map(len)
    for x, g in drawn.groupby(drawn["source"].fillna("￿")):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) < 60 and g["taken"].sum() <= 2 * g["size"].sum()
    # the tree: block draws of all shards are as equal as they can be
    per = blocks.select(F.explode("shards").alias("x")).groupBy("x").count().toPandas()["count"]
    assert per.max() - per.min() <= 1 and len(per) == 16


def test_the_edge_takes_what_still_fits(spark):
    # one source whose documents are alternately small and larger than the room that is left
    sizes = [1, 400] * 60
    texts = [" ".join(["w"] * (n - 1) + [f"u{i}"]) for i, n in enumerate(sizes)]
    plan = mixing.plan(docs(spark, texts, source=["a"] * 120), share=0.01)
    out = mixing.draw(*plan).toPandas()
    edge = plan[1].first()
    block = np.floor((out["h"].to_numpy().view(np.uint64) >> np.uint64(33)) * edge["blocks"] / 2**31).astype(int)
    fit = (out["size"] == 1) & (block == edge["edge"])
    assert (out["shards"].map(len) == fit).all()
    inside = out[block == edge["edge"]].sort_values("h")["size"].to_numpy()
    assert ((inside[1:] == 1) & (inside[:-1] > 1)).sum() > 10  # in many runs of hashes


def test_quality_rules(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(9)
    body = [prose(rng, 60) for _ in range(80)]
    texts = [b + "\nAll Rights  reserved here\n" + prose(rng, 5) for b in body] + ["all rights reserved HERE\n" * 30 + prose(rng, 20)] + [body[0]] * 30 + [b for b in ODD]
    d = docs(spark, texts, source=["x"] * 100 + ["y"] * (len(texts) - 100))
    out = quality.judge(d)[0].toPandas()
    c = duckdb.connect()
    c.register("documents", d.toPandas())
    want = c.sql(quality.OP6_SQL).df()
    columns = sorted(want.columns)
    assert sorted(map(tuple, out[columns].astype(str).values.tolist())) == sorted(map(tuple, want[columns].astype(str).values.tolist()))
    by = out.set_index("doc_id")
    assert by.loc[range(80), "removed_words"].eq(4).all() and by.loc[range(80), "kept"].all()
    assert not by.loc[80, "kept"]
    assert by.loc[range(81, 111), "kept"].all()  # copies don't condemn their own text
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean(d).collect()}
    assert sorted(map(tuple, quality.clean(d).collect()), key=str) == sorted(map(tuple, quality.clean(d, 0).collect()), key=str)  # both ways
    assert 80 not in cleaned and all("Rights" not in cleaned[i] and body[i] in cleaned[i] for i in range(80))


def near(rng, text, rate):
    w = text.split()
    for i in np.flatnonzero(rng.random(len(w)) < rate):
        w[i] = f"e{rng.integers(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("dense,levels", [(4096, 2), (16, 1), (8, 0)])
def test_near_duplicates(spark, dense, levels):
    rng = np.random.default_rng(10)
    clean = [prose(rng, int(n), 20000) for n in rng.integers(40, 200, 300)]
    texts, group = list(clean), list(range(300))
    for k in range(40):
        texts += [near(rng, clean[k], 0.04), clean[k], clean[k].upper() + "!"]
        group += [k] * 3
    out = simhash.near_duplicates(docs(spark, texts), dense=dense, levels=levels).toPandas().sort_values("doc_id")
    assert out["class_id"].tolist() == group
    assert out["n_copies"].iloc[0] == 2 and out["text_id"].iloc[301] == 0
    assert {r["doc_id"] for r in simhash.keep_one(docs(spark, texts)).select("doc_id").collect()} == set(range(300))


def test_survivors_of_near_duplicates(spark):
    rng = np.random.default_rng(41)
    a, b = prose(rng, 80, 20000), prose(rng, 80, 20000)
    texts = [a, a, a, None, None, b, b, near(rng, a, 0.03), b]
    ids = [5, 5, 3, None, None, None, None, 9, 5]
    left = simhash.keep_one(docs(spark, texts, ids=ids)).collect()
    # of a's group id 3 stays; of b's the row with an id, though another text has that id too; null texts stay
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(3, a), (None, None), (None, None), (5, b)], key=str)
    assert simhash.keep_one(docs(spark, [a, a], ids=[1, 1])).count() == 1


def test_recall_of_the_forest_at_the_limit(spark):
    rng = np.random.default_rng(42)
    rows = []
    for k in range(400):  # pairs that differ in exactly as many bits as a link may
        x = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        y = np.unpackbits(x.view(np.uint8))
        y[rng.permutation(256)[: simhash.LIMIT]] ^= 1
        rows += [x, np.packbits(y).view(np.uint64)]
    f = np.stack(rows)
    nodes = spark.createDataFrame(pd.DataFrame({"node": range(len(f)), **{f"f{k}": f[:, k].view(np.int64) for k in range(4)}}))
    for dense in (4096, 40):  # in buckets of the first forest, and of forests within them
        links = simhash.forest_links(nodes, dense=dense)
        assert len({(min(r), max(r)) for r in links.collect()}) >= 0.9 * 400


def test_forest_finds_what_all_pairs_find(spark):
    rng = np.random.default_rng(11)
    f = rng.integers(0, 1 << 63, (60, 4), dtype=np.uint64)
    rows = []
    for x in f:
        for _ in range(5):
            y = np.unpackbits(x.view(np.uint8))
            y[rng.permutation(256)[:20]] ^= 1
            rows.append(np.packbits(y).view(np.uint64))
    f = np.stack(rows)
    nodes = spark.createDataFrame(pd.DataFrame({"node": range(len(f)), **{f"f{k}": f[:, k].view(np.int64) for k in range(4)}}))
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(-1)
    pairs = spark.createDataFrame([(i, j) for i, j in zip(*np.where(d <= simhash.LIMIT)) if i < j] and [(int(i), int(j)) for i, j in zip(*np.where(d <= simhash.LIMIT)) if i < j], "u long, v long")
    want = {(r["node"], r["root"]) for r in components(pairs).collect()}
    for dense, levels in ((4096, 2), (10, 2), (4, 0)):
        links = simhash.forest_links(nodes, dense=dense, levels=levels)
        got = links.collect()
        assert all(d[r["u"], r["v"]] <= simhash.LIMIT for r in got)
        assert {(r["node"], r["root"]) for r in components(links).collect()} == want


def test_tries():
    for depth in (1, 8, 20):
        t = simhash.tries_for(depth)
        assert 1 - (1 - (1 - simhash.REACH) ** depth) ** t >= simhash.RECALL
    assert simhash.shape(10**12)[1] <= simhash.MOST_TRIES


def test_components(spark):
    rng = np.random.default_rng(12)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for p in e for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {(x, root(x)) for x in parent if any(x in p and p[0] != p[1] for p in e)}
    assert {(r["node"], r["root"]) for r in components(spark.createDataFrame(e, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_drop_keys(spark):
    d = docs(spark, [f"t{i}" for i in range(200)])
    keys = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id long")
    assert {r["doc_id"] for r in drop_keys(d, keys).collect()} == {i for i in range(200) if i % 3}


def ppm_length(texts, text, order, size_of):
    """Code length of a text by the definition, one byte after another."""
    from collections import Counter, defaultdict

    ctx = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        for i in range(3, len(t)):
            for k in range(order + 1):
                ctx[k][t[i - k : i]][t[i]] += 1
    total = 0.0
    for i in range(3, len(text)):
        for k in range(order, -1, -1):
            c = ctx[k].get(text[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if text[i] in c:
                total -= np.log2(c[text[i]] / (n + d))
                break
            total -= np.log2(d / (n + d))
        else:
            total += np.log2(size_of)
    return total


def normal(texts):
    x, at = langid.normalise(*block(texts))
    return [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


def test_normal_form():
    assert normal(["Été,  A1b", "", "..x!"]) == ["   été a b".encode(), b"   ", b"   x "]


def test_ppm_code_lengths():
    en, fr = ["the cat and the dog ran", "then that other thing"], ["le chat et le chien", "après été là"]
    model = langid.Model(langid.Counts(["en", "fr"], [langid.count_grams(x) for x in (en, fr)]))
    probes = ["the thing", "le chat après", "zzz qqq", "a", "", "Là THEN été", "Ωmega 語 the"]
    got = model.lengths(*block(probes)) / langid.UNIT
    for j, train in enumerate((en, fr)):
        known = normal(train)
        for i, t in enumerate(normal(probes)):
            want = ppm_length(known, t, langid.ORDER, 256)
            assert got[i, j] == pytest.approx(want, abs=0.002 * max(1, len(t)))


def test_language_id(spark):
    rng = np.random.default_rng(13)
    parts = {"en": ["the", "ing", "th", "er", "and", "on", "of"], "de": ["der", "sch", "ung", "ein", "ch", "ü", "ß"], "fr": ["que", "eau", "ou", "é", "è", "ment", "les"]}
    lang = [list(parts)[i % 3] for i in range(400)]
    texts = [" ".join("".join(rng.choice(parts[x], rng.integers(1, 4))) for _ in range(int(rng.integers(3, 40)))) for x in lang]
    d = docs(spark, [*texts, None, "123 --"], lang=[*lang, None, "en"])
    counts = langid.learn(d.where(~langid.held_out()))
    out = langid.identify(d, counts).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score").toPandas().set_index("doc_id")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert out.index[out["held_out"]].tolist() == [i for i in out.index if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([out.loc[i, "lang_pred"] == lang[i] for i in held]) > 0.95
    assert out.loc[400, "lang_pred"] == out.loc[401, "lang_pred"] == "und" and out["score"].between(0, 1).all()
    assert langid.identify(d, None).where("lang_pred <> 'und'").count() == 0


def test_any_number_of_languages(spark):
    rng = np.random.default_rng(44)
    texts, lang = [], []
    for k in range(140):  # two labels of each kind share nothing with the others but some letters
        words = ["".join(map(chr, rng.integers(97 + 400 * (k // 20), 97 + 400 * (k // 20) + 26, 4))) for _ in range(30)]
        for _ in range(6):
            texts.append(" ".join(rng.choice(words, 25)))
            lang.append(f"l{k:03d}")
    d = docs(spark, texts, lang=lang)
    out = langid.identify(d, langid.learn(d)).toPandas().sort_values("doc_id")
    assert np.mean(out["lang_pred"].to_numpy() == np.array(lang)) > 0.97


def test_two_models_in_one_worker(spark):
    a, b = docs(spark, ["aaa bbb"] * 3, lang=["x"] * 3), docs(spark, ["aaa bbb"] * 3, lang=["y"] * 3)
    for _ in range(3):
        for d, name in ((a, "x"), (b, "y")):
            assert {r["lang_pred"] for r in langid.identify(d, langid.learn(d)).collect()} == {name}


def test_the_sample_counts_equal_rows_once(spark):
    d = docs(spark, ["aaa"] * 50 + ["bbb"], lang=["x"] * 51, ids=[1] * 50 + [2])
    c = langid.read_counts(langid.learn(d, 2))
    assert dict(zip(*(v.tolist() for v in c.grams[0][0])))[ord("a")] == 3  # once, whole


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><a>Menu</a></nav><div id="cookie-notice">cookies</div>%s<footer>f</footer></body></html>"""
ARTICLE = """<article><header class="post-header"><h1>Ti&amp;tle</h1><span>by me</span></header><p>One <b>two</b>&nbsp;three<br>four
<ul><li>a<li>b &lt;c&gt;</ul><div class="share">S</div><table><tr><td>1<td>2<tr><td>3</table><!-- no --><form>x<input></form>
<aside>side</aside><p>tail a < b &eacute;&#8364</article><section class="comments"><p>bad</p></section>"""


def shown(page):
    return [x for x in html.extract(page)[0] if x is not None]


def test_main_text():
    assert shown(PAGE % ARTICLE) == ["Ti&tle", "One two three four", "a", "b <c>", "1 2", "3", "tail a < b é€"]
    assert shown(PAGE % f"<main>{ARTICLE}</main>") == shown(PAGE % ARTICLE)
    assert shown(PAGE % "<div><p>x</p><div class='ad-box'>ad</div>y</div>") == ["x", "y"]
    assert shown("just text") == ["just text"] and html.extract(None) == ([], []) and shown("<p") == []
    assert shown("<p>" + "<b>" * 5000 + "deep") == ["deep"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><header><h1>Title</h1><h2>Subtitle heading</h2></header><p>x</p></article>", ["Title", "Subtitle heading", "x"]),
        ("<article><header><div><h1>Title</h1><p>by me</p><h2>Sub</h2></div></header><p>x</p></article>", ["Title", "Sub", "x"]),
        ("<article><p class='related-work'>kept</p><div class='market-share'>kept too</div></article>", ["kept", "kept too"]),
        ("<article><p>x</p><div class='related-posts'>no</div><ul id='share_buttons'><li>no</ul><div class='commentList'>no</div></article>", ["x"]),
        ("<body class='sidebar'><div class='content-sidebar-wrap'><main><p>x</p></main></div></body>", ["x"]),
        ("<main><p>a <button>no</button>b</p><span class='ad'>no</span>c</main>", ["a b", "c"]),
        ("<article><header><nav>no</nav><h1>T</h1></header></article><header><h1>Site</h1></header>", ["T"]),
    ],
)
def test_rules(page, want):
    assert shown(page) == want


def test_deep_and_broken_pages_take_linear_time():
    import time

    def seconds(page):
        began = time.perf_counter()
        html.extract(page)
        return time.perf_counter() - began

    for make in (lambda n: "<div>x" * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<div class='menu'>y" * n, lambda n: "<article>z" * n, lambda n: "<span>" * n + "<p>a" * n):
        seconds(make(500))
        assert seconds(make(8000)) < 12 * max(seconds(make(2000)), 0.01)


def test_templates_go_by_frequency(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=top>Welcome to us</div><div><p>body {i} of the page</p></div><div>About &amp; imprint</div>") for i in range(30)]
    rows += [(100 + i, f"http://other.example/{i}", f"<p>Welcome to us</p><p>x{i}</p>") for i in range(3)]
    rows += [(200 + i, "http://copy.example/a", "<p>the same article</p>") for i in range(30)]
    rows += [(300, None, None), (301, "nonsense", "")]
    # inside marked content: a box that recurs is the site's, a paragraph that recurs the author's
    rows += [(400 + i, f"http://box.example/{i}", f"<nav>Menu</nav><article><p>own {i}</p><p>as ever</p><section><p>read on</p><p>and on</p></section></article>") for i in range(30)]
    t = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("uid", F.lit(1)).withColumn("_slot", F.lit(2)).withColumn("drop", F.lit(3))
    out = {r["page_id"]: r for r in html.main_text(t).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["text"] == f"body {i} of the page" and out[i]["n_template"] == 2 for i in range(30))
    assert out[100]["text"] == "Welcome to us\nx0" and out[200]["text"] == "the same article"  # copies of a page count once
    assert out[300]["text"] == out[301]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert all(out[400 + i]["text"] == f"own {i}\nas ever" and (out[400 + i]["n_template"], out[400 + i]["n_rule"]) == (3, 0) for i in range(30))
    assert html.main_text(t.limit(0)).count() == 0
    assert sorted(map(str, html.main_text(t, most_templates=0).collect())) == sorted(map(str, out.values()))  # both ways


def test_templates_are_those_of_a_recount(spark):
    rng = np.random.default_rng(43)
    parts = [f"<div class=c{k}><p>part {k}</p></div>" for k in range(12)]
    rows = []
    for i in range(200):
        some = [parts[k] for k in np.flatnonzero(rng.random(12) < np.linspace(0.01, 0.9, 12))]
        rows.append((i, f"http://h{i % 2}.example/{i}", "<body>" + "".join(some) + f"<p>own {i % 150}</p></body>"))
    t = spark.createDataFrame(rows, "page_id long, url string, html string")
    limit = 0.3
    pages, counts = {}, {}
    for _, url, page in rows:  # distinct pages of each host, subtrees of each page once
        blocks, spans = html.extract(page)
        pages.setdefault(url.split("/")[2], {})["\n".join(blocks)] = {h for h, _, _ in spans}
    for host, of in pages.items():
        counts[host] = {h for h in set().union(*of.values()) if sum(h in x for x in of.values()) > max(html.LEAST_PAGES, limit * len(of))}
    out = {r["page_id"]: r for r in html.main_text(t, least_share=limit).collect()}
    for i, url, page in rows:
        blocks, spans = html.extract(page)
        gone = {k for h, lo, hi in spans if h in counts[url.split("/")[2]] for k in range(lo, hi)}
        assert out[i]["text"] == "\n".join(b for k, b in enumerate(blocks) if k not in gone) and out[i]["n_template"] == len(gone)
    assert any(r["n_template"] for r in out.values())


def vectors(spark, v, ids=None):
    return spark.createDataFrame([(int(i), None if x is None else [None if c is None else float(c) for c in x]) for i, x in zip(ids if ids is not None else range(len(v)), v)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("part", [40_000, 200])
def test_nearest_neighbours(spark, part):
    rng = np.random.default_rng(14)
    v = rng.normal(size=(1500, 24)) * rng.uniform(0.2, 3, (1500, 1))
    d = vectors(spark, v)
    out = ann.search(d, d.where("vec_id % 20 = 0"), 10, part=part).toPandas()
    s = v[::20] @ v.T
    s[np.arange(75), np.arange(0, 1500, 20)] = -np.inf
    best = np.argsort(-s, axis=1, kind="stable")[:, :10]
    recall = np.mean([len(set(out[out["query_id"] == 20 * i]["vec_id"]) & set(b)) / 10 for i, b in enumerate(best)])
    assert recall >= 0.9
    assert np.allclose(out["score"], [v[a] @ v[b] for a, b in zip(out["query_id"], out["vec_id"])], rtol=0, atol=1e-12)
    for _, g in out.groupby("query_id"):
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 11)) and (g.sort_values("rank")["score"].diff().dropna() <= 0).all()


def test_neighbours_of_odd_vectors(spark):
    v = [[1, 0], [1, 0], [1, 0], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 2, 3], [2, 0]]
    d = vectors(spark, v)
    out = ann.search(d, d.where("vec_id IN (0, 4, 5)"), 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == [(0, 1, 9, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0)]
    assert ann.search(d.limit(0), d, 5).count() == 0 and ann.search(d, d.limit(0), 5).count() == 0


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(46)
    v = rng.normal(size=(400, 8))
    v[[5, 7, 11]] *= 1e60
    v[[40, 80]] *= 1e-200
    d = vectors(spark, v).withColumn("id", F.lit("x")).withColumn("v", F.lit("y")).withColumn("part", F.lit(1))
    out = ann.search(d, d.where("vec_id % 20 = 0")).toPandas().sort_values(["query_id", "rank"])
    for q in range(0, 400, 20):
        s = (v * v[q]).sum(1)
        s[q] = -np.inf
        assert out[out["query_id"] == q]["vec_id"].tolist() == np.lexsort((np.arange(400), -s))[:20].tolist()


def test_close_neighbours_leave_most_candidates_unscored():
    rng = np.random.default_rng(47)
    centres = rng.normal(size=(100, 32))
    s = centres[rng.integers(0, 100, 4000)] + 0.25 * rng.normal(size=(4000, 32))
    s /= np.linalg.norm(s, axis=1, keepdims=True)
    family, share, scored = ann.choose(s, s[:64], 1.0, 0.9, 0.98)
    assert scored < 0.35 and family.hashes > 4
    _, _, blind = ann.choose(rng.normal(size=(2000, 32)), rng.normal(size=(64, 32)), 12.0, 0.2, 0.98)
    assert 0.5 < blind <= 1  # nothing to tell neighbours by: one table, most of which is visited


def test_neighbours_tie_to_smaller_ids(spark):
    v = np.tile([[0.6, 0.8]], (300, 1))
    out = ann.search(vectors(spark, v), vectors(spark, v[:1], [1000]), 20, part=50).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == list(range(20))


def test_repeated_paragraphs(spark):
    rng = np.random.default_rng(15)
    clean = ["\n".join(prose(rng, 40, 30000) for _ in range(4)) for _ in range(60)]
    para = prose(rng, 60, 30000)
    inner = prose(rng, 70, 30000)
    texts = list(clean)
    for i in range(0, 10):
        texts[i] += "\n" + (near(rng, para, 0.03) if i else para)
    for i in range(20, 30):  # inside other lines, at any word
        lines = texts[i].split("\n")
        w = lines[1].split()
        lines[1] = " ".join([*w[: 5 + i % 7], inner, *w[5 + i % 7 :]])
        texts[i] = "\n".join(lines)
    d = docs(spark, texts)
    out = paragraphs.repeats(d).toPandas()
    assert set(out["doc_id"]) == set(range(1, 10)) | set(range(21, 30))
    assert (out[out["doc_id"] < 10]["kept_doc_id"] == 0).all() and (out[out["doc_id"] > 10]["kept_doc_id"] == 20).all()
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove(d).collect()}
    assert all(left[i] == texts[i] for i in [0, 20, *range(10, 20), *range(30, 60)])
    assert all(left[i] == clean[i] for i in range(1, 10))
    middle = " ".join(inner.split()[20:50])
    assert all(middle not in left[i] and len(left[i]) < len(texts[i]) - len(inner) // 2 for i in range(21, 30))


def test_paragraph_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(16)
    base = [prose(rng, 50, 20000) for _ in range(25)]
    texts = base + [near(rng, b, r) for b, r in itertools.product(base, (0.02, 0.05))]
    out = paragraphs.repeats(docs(spark, texts)).toPandas()

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    s = [shingles(t) for t in texts]
    want = {j for j in range(25, 75) if any(len(s[i] & s[j]) / len(s[i] | s[j]) >= paragraphs.JACCARD for i in range(25))}
    got = set(out[out["kind"] == "paragraph"]["doc_id"])
    assert got == want


def test_recall_of_bands_at_the_limit(spark):
    texts = []
    for k in range(150):
        a = [f"a{k}x{i}" for i in range(62)]
        b = a[:43] + [f"b{k}x{i}" for i in range(17)]
        texts += [" ".join(a), " ".join(b)]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    s = [shingles(t) for t in texts]
    j = [len(s[i] & s[i + 1]) / len(s[i] | s[i + 1]) for i in range(0, 300, 2)]
    assert all(0.5 <= x < 0.56 for x in j)
    out = paragraphs.repeats(docs(spark, texts)).where("kind = 'paragraph'").collect()
    assert {r["doc_id"] for r in out} <= set(range(1, 300, 2)) and len(out) >= 0.9 * 150


@pytest.mark.parametrize("block", [1 << 17, 60])
def test_no_pair_of_a_band_is_left_out(spark, block):
    # A ~ B ~ D, B and D unlike the ends of the band: every pair is compared, in one block or many
    line = [" ".join(f"w{i}" for i in range(k, k + 30)) for k in (0, 6, 12, 18)] + [" ".join(f"v{i}" for i in range(30))]
    d = docs(spark, line)
    names = [1, 4, 2, 3, 9]
    classes = d.select("doc_id", paragraphs._key().alias("doc"), F.octet_length("text").alias("end"))
    first = F.struct("doc_id", "doc", F.lit(0).alias("start"), "end").alias("first")
    classes = classes.select(F.element_at(F.array(*map(F.lit, names)), F.col("doc_id").cast("int") + 1).cast("long").alias("h"), first, F.array(F.lit(7).cast("long")).alias("bands"))
    links = paragraphs.paragraph_links(d, classes, block=block)
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(k, 1) for k in (1, 2, 3, 4)}


def test_of_each_passage_a_copy_survives(spark):
    rng = np.random.default_rng(19)
    inner = prose(rng, 60, 30000)
    around = [prose(rng, 70, 30000) for _ in range(2)]
    # document 1's paragraph goes for document 0's, which lacks the passage; so document 2 must keep it
    texts = [" ".join([*around]), " ".join([around[0], inner, around[1]]), prose(rng, 80, 30000) + " " + inner + " " + prose(rng, 80, 30000)]
    texts += [prose(rng, 80, 30000) + " " + inner]
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove(docs(spark, texts)).collect()}
    assert 1 not in left and inner in left[2] and inner not in left[3]


def test_a_document_wholly_repeated_goes(spark):
    rng = np.random.default_rng(17)
    t = "\n".join(prose(rng, 30, 9000) for _ in range(3))
    left = paragraphs.remove(docs(spark, [t, t, "short own text"])).collect()
    assert [r["doc_id"] for r in sorted(left)] == [0, 2]


def test_band_members_that_differ_from_both_ends_are_linked(spark):
    line = [" ".join(f"w{i}" for i in range(k, k + 30)) for k in (0, 6, 12)] + [" ".join(f"v{i}" for i in range(30))]
    d = docs(spark, line)
    names = [1, 2, 3, 9]  # 1 ~ 2 ~ 3, not 1 ~ 3; 1 and 9 are the band's ends
    classes = d.select("doc_id", paragraphs._key().alias("doc"), F.octet_length("text").alias("end"))
    first = F.struct("doc_id", "doc", F.lit(0).alias("start"), "end").alias("first")
    classes = classes.select(F.element_at(F.array(*map(F.lit, names)), F.col("doc_id").cast("int") + 1).cast("long").alias("h"), first, F.array(F.lit(7).cast("long")).alias("bands"))
    assert {tuple(r) for r in paragraphs.paragraph_links(d, classes).collect()} == {(1, 2), (2, 3)}


def passages(rng):
    """Documents of one line each, and where (doc, first word, words, earlier docs that hold it) passages of others stand."""
    body = [[f"d{k}x{i}" for i in range(300)] for k in range(60)]
    planted = []
    for k in range(0, 40, 2):
        at, size, to = int(rng.integers(0, 200)), int(rng.integers(50, 62)), int(rng.integers(0, 240))
        body[k + 1][to : to + size] = body[k][at : at + size]
        planted.append((k + 1, to, size))
    # the middle of what document 41 repeats from 40 stands in 39 too, so runs have different earlier documents
    body[39] += body[40][100:130]
    body[41][60:130] = body[40][80:150]
    planted.append((41, 60, 70))
    # phrases of five words, each from another document
    body[50] = [w for k in range(42, 50) for w in body[k][10:15]] + body[50]
    return body, planted


def test_passages_go_to_their_last_word(spark):
    body, planted = passages(np.random.default_rng(30))
    out = paragraphs.repeats(docs(spark, [" ".join(b) for b in body])).where("kind = 'passage'").collect()
    gone = {}
    for r in out:
        raw = " ".join(body[r["doc_id"]]).encode()
        gone.setdefault(r["doc_id"], set()).update(range(raw[: r["start"]].count(b" "), raw[: r["end"]].count(b" ") + 1))
    want = {k: set(range(at, at + n)) for k, at, n in planted}
    gone.pop(40, None)  # 30 words that 39 has too: shorter than what surely holds a seed
    assert gone == want


def test_each_passage_stands_in_the_document_named(spark):
    body, _ = passages(np.random.default_rng(31))
    texts = [" ".join(b) for b in body]
    out = paragraphs.repeats(docs(spark, texts)).where("kind = 'passage'").collect()
    assert out and not any(r["doc_id"] == 50 for r in out)
    for r in out:
        span = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert r["kept_doc_id"] < r["doc_id"] and f" {span} " in f" {texts[r['kept_doc_id']]} " and r["n_words"] == len(span.split())


def test_every_link_counts(spark):
    rng = np.random.default_rng(40)
    base = prose(rng, 400, 20000).split()
    texts = [" ".join(base), " ".join(base[::-1])]  # equal fingerprints, different texts
    for k in range(10):
        w = list(base)
        w[k] = f"new{k}"
        texts.append(" ".join(w))
    for dense in (4096, 4):
        out = simhash.near_duplicates(docs(spark, texts + [texts[3], prose(rng, 400, 20000, "q")]), dense=dense, levels=0).toPandas().sort_values("doc_id")
        assert out["n_links"].tolist() == [11] * 13 + [0]
