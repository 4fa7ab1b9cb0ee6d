"""The shared work folder: tables that cut a plan's lineage survive a lost executor there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in local tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):  # machines of a cluster don't share a temporary folder
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ripplespark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, what: str = "step") -> DataFrame:
    """``df`` written to the work folder and read back."""
    path = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of stored tables that a part of a shuffle may come from.
PART = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` parted by ``keys``, into more parts for larger tables, so that a task's rows don't grow with them.

    Coalescing goes by compressed bytes and by cores, which lets a task hold any
    number of rows. Tables of a part's size, and those of unknown size, are left as they are.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if read <= PART or read >= 1 << 60:
        return df
    return df.repartition(max(-(-read // PART), df.sparkSession.sparkContext.defaultParallelism), *keys)
