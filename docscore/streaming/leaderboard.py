"""Leaderboards that follow an append-only log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rounding import pct, round_half


def read_log(spark: SparkSession, path: str, schema: str, glob: str = "*", fmt: str = "parquet") -> DataFrame:
    """New files of a directory, as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).format(fmt).load(path)


def running_rates(runs: DataFrame) -> DataFrame:
    """Runs, successes and rate of each model so far; its state is a row a model."""
    g = runs.groupBy("model_key").agg(F.count("*").alias("runs"), F.count_if("success").alias("successes"), F.sum("cost_micro").alias("cost_micro"))
    return g.withColumn("success_rate_pct", round_half(pct(F.col("successes"), F.col("runs")), 2))


def windowed_rates(runs: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Rates by window of event time; rows later than the watermark are left out, and its state goes."""
    return runs.withWatermark(time, late).groupBy(F.window(time, window), "model_key").agg(F.count("*").alias("runs"), F.count_if("success").alias("successes"))


def on_batch(df: DataFrame, checkpoint: str, callback: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call ``callback`` with each batch of completed tasks."""
    return df.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
