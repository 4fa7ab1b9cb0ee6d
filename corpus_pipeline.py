"""A training corpus from raw documents: five stages, each over all that the one before kept.

Quality rules, near-duplicate removal, substring dedup, mixing to target weights
and packing. Every stage but the last returns the columns of ``documents``; the
mix may hold a document more than once, and packing packs each time it does. All
stages keep other columns, whatever their names.

A stage's rows are lazy, so each stage leaves the session's limit for batches to
Python at 4 MB where the session names none (``common.small_batches``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ripplespark.llm import mixing, packing, paragraphs, quality, simhash
from ripplespark.llm.common import new_path, read_table, scratch, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(run: Stage) -> Stage:
    @wraps(run)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return run(spark, docs, sf_dir)

    return wrapped


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, frequent lines of their host.

    Null and empty texts are rejected (they have no words); a null source is a host
    like any other; repeated rows are judged each; an empty table stays empty.
    """
    return quality.clean(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the least doc_id, null ids last.

    Null texts are in no group and stay; of repeated rows one stays; long texts
    count whole; an empty table stays empty.
    """
    return simhash.keep_one(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs and passages that an earlier document has are cut out.

    Null texts stay; a document of which no word is left goes; rows equal in
    doc_id and text are one document; an empty table stays empty.
    """
    return paragraphs.remove(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them.

    Null texts have size 0 and may be drawn like any other; a null source is a
    source of its own; repeated rows are drawn together; an empty table stays empty.
    """
    return mixing.mix(docs, order=False)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 ids.

    A null or empty text is its end id alone; a repeated row is packed each time; an
    empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express SimHash forests and token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what a stage wrote for itself goes when its rows are written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            path = new_path(spark, name.split()[0])
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
