"""A stream of diffs: each micro-batch's impact, appended to Parquet once a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import ImpactOptions
from ..plans.impact import Engine
from ..sources.diff import parse_diffs


def impact_stream(engine: Engine, diffs: DataFrame, out: str, checkpoint: str, options: ImpactOptions = ImpactOptions()) -> StreamingQuery:
    """Run over a streaming table of ``diff_id``, ``text``; impacted symbols of batch n are written (whole, again on a retry) to ``out/batch=n``."""

    def one(batch: DataFrame, n: int) -> None:
        report = engine.impact_of(parse_diffs(batch), options)
        report.impacted.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return diffs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_counts(events: DataFrame, at: str = "ts", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Changes by window and kind under a watermark; for batch tables the same counts."""
    from pyspark.sql import functions as F

    return events.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
