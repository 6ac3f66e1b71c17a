"""The engine's tables made from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs table from events. Success is the online rule: all critical fields, or all fields without critical ones."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    u, k, v = F.col("user_id"), F.col("k"), F.col("value")
    r = e.select(
        F.col("event_id").alias("ordinal"), F.concat(F.lit("p"), u % 4, F.lit(":m"), u % 12).alias("model_key"), F.concat(F.lit("d"), k % 3).alias("domain"),
        F.concat(F.lit("doc-"), k % 30).alias("document_id"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), k % 7)).alias("error"),
        (8 + k % 5).alias("field_total"), F.least(8 + k % 5, F.floor(v / 4)).alias("field_correct"),
        F.when(k % 11 == 0, 0).otherwise(3 + k % 2).cast("long").alias("critical_total"),
        F.least(F.when(k % 11 == 0, 0).otherwise(3 + k % 2), F.floor(v / 8)).cast("long").alias("critical_correct"),
        F.floor(v * 100 + 0.5).alias("latency_ms"), F.floor(v * 100 + 0.5).alias("cost_micro"), (k % 3 == 0).alias("cache_hit"), (k * 2).alias("cached_tokens"),
        (k * 10 + 5).alias("input_tokens"), F.floor(v).alias("output_tokens"), (8 + k % 5 - k % 2).alias("found_keys"), (8 + k % 5).alias("requested_keys"),
    )
    right = F.when(F.col("critical_total") > 0, F.col("critical_correct") == F.col("critical_total")).otherwise((F.col("field_total") > 0) & (F.col("field_correct") == F.col("field_total")))
    return r.withColumn("success", F.col("error").isNull() & right)


RUNS = """runs0 AS (
  SELECT event_id AS ordinal, 'p' || user_id % 4 || ':m' || user_id % 12 AS model_key, 'd' || k % 3 AS domain, 'doc-' || k % 30 AS document_id,
         CASE WHEN event_type = 'error' THEN 'E' || k % 7 END AS error, 8 + k % 5 AS field_total, least(8 + k % 5, CAST(floor(value / 4) AS BIGINT)) AS field_correct,
         CASE WHEN k % 11 = 0 THEN 0 ELSE 3 + k % 2 END AS critical_total, least(CASE WHEN k % 11 = 0 THEN 0 ELSE 3 + k % 2 END, CAST(floor(value / 8) AS BIGINT)) AS critical_correct,
         CAST(floor(value * 100 + 0.5) AS BIGINT) AS latency_ms, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cost_micro, k % 3 = 0 AS cache_hit, k * 2 AS cached_tokens,
         k * 10 + 5 AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens, 8 + k % 5 - k % 2 AS found_keys, 8 + k % 5 AS requested_keys
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), runs AS (
  SELECT *, error IS NULL AND CASE WHEN critical_total > 0 THEN critical_correct = critical_total ELSE field_total > 0 AND field_correct = field_total END AS success FROM runs0
)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs with a task key each, and every seventh logged again as a success."""
    r = runs(spark, sf_dir).withColumn("task_key", F.concat_ws("::", "model_key", "domain", "document_id", (F.col("ordinal") % 40).cast("string")))
    again = r.filter("ordinal % 7 = 0").withColumn("ordinal", F.col("ordinal") + 10_000_000_000).withColumn("success", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
    return r.unionByName(again)


LOG = (
    RUNS
    + """, log0 AS (SELECT *, concat_ws('::', model_key, domain, document_id, CAST(ordinal % 40 AS VARCHAR)) AS task_key FROM runs),
log AS (SELECT * FROM log0 UNION ALL BY NAME SELECT * REPLACE (ordinal + 10000000000 AS ordinal, true AS success, NULL AS error) FROM log0 WHERE ordinal % 7 = 0),
latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY task_key ORDER BY ordinal DESC) = 1)"""
)
