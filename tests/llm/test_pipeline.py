"""The pipeline's stages on planted documents."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from ripplespark.llm import tokens
from test_operators import docs, near, prose


@pytest.fixture()
def folder(spark, tmp_path):
    rng = np.random.default_rng(20)
    texts = ["\n".join(prose(rng, 60, 30000) for _ in range(3)) for _ in range(120)]
    shared = prose(rng, 80, 30000)
    texts[10] += "\n" + shared
    texts[11] += "\n" + shared
    texts += [texts[0], near(rng, texts[1], 0.03), "too short", None, "word word word " * 40]
    d = docs(spark, texts, source=[f"s{i % 4}" for i in range(len(texts))])
    d.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), texts, shared


def test_stages(spark, folder):
    path, texts, shared = folder
    d = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicate removal", "substring dedup", "mixing to target weights", "packing"]
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, path)
        if i < 4:
            assert out.columns == d.columns
            out.write.parquet(f"{path}/{i}")
            d = spark.read.parquet(f"{path}/{i}")
            kept[i] = {r["doc_id"]: r["text"] for r in d.collect()}
    assert set(kept[0]) == set(range(122)) and set(kept[1]) == set(range(120)) and set(kept[2]) == set(range(120))
    assert kept[2][10] == texts[10] and shared not in kept[2][11] and kept[2][11] == texts[11][: -len(shared) - 1]
    assert set(kept[3]) <= set(range(120))
    e = tokens.Encoder(tokens.default_path())
    rows = out.toPandas()
    for r in rows.head(200).itertuples():
        ids = np.append(e.whole(kept[2][r.doc_id]), np.uint32(1))
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    counts = {k: v for k, v in d.groupBy("doc_id").count().collect()}
    assert rows[rows["start"] == 0].groupby("doc_id").size().to_dict() == counts


def test_rows_go_to_python_in_small_batches(spark, folder):
    import pyarrow as pa

    from ripplespark.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    wide = spark.range(0, 6000, 1, 1).selectExpr("repeat('x', 4000) AS text")
    d = spark.read.parquet(f"{folder[0]}/documents.parquet")
    before = spark.conf.get(common._BATCH, None)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(common._BATCH)
            stage(spark, d, folder[0])
            assert max(r["n"] for r in wide.mapInArrow(sizes, "n long").collect()) < 6 << 20
        spark.conf.set(common._BATCH, str(1 << 20))  # a session's own limit holds
        corpus_pipeline.STAGES[0][1](spark, d, folder[0])
        assert spark.conf.get(common._BATCH).rstrip("b") == str(1 << 20)
    finally:
        spark.conf.unset(common._BATCH) if before is None else spark.conf.set(common._BATCH, before)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 100
