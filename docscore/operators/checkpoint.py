"""The run log: latest records, status, task grid, resume and retry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "task_key", order: str = "ordinal") -> DataFrame:
    """The last record of each task; records without a key go. The record with the greatest
    order is found by a pre-aggregated maximum, so only one record a task and partition is moved."""
    whole = F.struct(order, *(c for c in log.columns if c != order))
    return log.filter((F.col(key).isNotNull()) & (F.col(key) != "")).groupBy(key).agg(F.max_by(whole, order).alias("r")).select("r.*")


def status_by_model(log: DataFrame) -> DataFrame:
    """Latest records with and without an error, and the share of those with one, by model."""
    bad = F.count_if(F.col("error").isNotNull() & (F.col("error") != ""))
    return latest(log).groupBy("model_key").agg((F.count("*") - bad).alias("ok"), bad.alias("failed"), (bad / F.count("*")).alias("failure_rate"))


def top_errors(log: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent error texts of latest records; ties by where a text was first seen: the place of its
    first task's first record."""
    first = log.filter("coalesce(task_key, '') <> ''").groupBy("task_key").agg(F.min("ordinal").alias("at"))
    seen = latest(log).filter("error <> ''").select("task_key", "error").join(first, "task_key")
    return seen.groupBy("error").agg(F.count("*").alias("n"), F.min("at").alias("at")).orderBy(F.desc("n"), "at").limit(n).select("error", "n")


def task_grid(models: DataFrame, documents: DataFrame, runs: int) -> DataFrame:
    """Every model on every document, ``runs`` times. The grid is the product that is asked for;
    both sides are small dimension tables."""
    grid = models.crossJoin(documents).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    return grid.withColumn("task_key", F.concat_ws("::", "model_key", "domain", "document_id", F.col("run").cast("string")))


def to_resume(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Tasks that were never logged, not even as failed."""
    return grid.join(log.select("task_key").distinct(), "task_key", "left_anti")


def to_retry(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Tasks whose last record has an error."""
    return grid.join(latest(log).filter("error <> ''").select("task_key"), "task_key", "left_semi")


def requested(grid: DataFrame) -> DataFrame:
    """Scheduled tasks by domain and model, and by model (domain 'overall')."""
    both = grid.withColumn("bucket", F.explode(F.array(F.lit("overall"), F.col("domain"))))
    return both.groupBy("bucket", "model_key").agg(F.count("*").alias("requested"))


def first_nonempty(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The first value of each key, or the first that isn't empty if the first is."""
    some = F.expr(f"min_by({value}, {order}) FILTER (WHERE {value} <> '')")
    return rows.groupBy(*key).agg(F.coalesce(some, F.min_by(value, order)).alias(value))
