"""A run's progress and its boards, as a log grows.

Each batch is counted by blocks on top of the counters that the batch before left, and its
events and counters are written under the batch's number. A batch that runs again, after a
failure between its writes and the stream's own commit, writes the same rows to the same
place, so nothing is told twice and nothing is lost. No state is held by one task, and none on
the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import running
from ..operators.leaderboard import ok, report_line


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the batches below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    done = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
    return sorted(n for n in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={n}/_SUCCESS")))


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


COUNTERS = "document_id string, done long, bad long"


def counted(batch: DataFrame, before: DataFrame, total: int, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``batch``: ordinal, document_id, model_label, run_number, error; ``before``: the counters of earlier
    batches by document. Events (ordinal, completed, line) and the counters after this batch."""
    rows = batch.select("ordinal", "document_id", "model_label", "run_number", "error", (~ok()).cast("long").alias("bad"))
    all_ = running(rows, [], ["ordinal"], {"c": F.lit(1), "f": F.col("bad")}).drop("c_total", "f_total")
    each = running(all_, ["document_id"], ["ordinal"], {"k": F.lit(1)}).drop("k_total")
    start = before.agg(F.coalesce(F.sum("done"), F.lit(0)).alias("c0"), F.coalesce(F.sum("bad"), F.lit(0)).alias("f0"))
    j = each.join(expected.select("document_id", F.col("runs").alias("wanted")), "document_id", "left")
    j = j.join(before.select("document_id", F.col("done").alias("k0")), "document_id", "left").withColumn("c0", start.select("c0").scalar()).withColumn("f0", start.select("f0").scalar())
    completed, failed, k = F.col("c") + F.col("c0"), F.col("f") + F.col("f0"), F.col("k") + F.coalesce("k0", F.lit(0))
    line = report_line(completed, failed, total, k, F.col("wanted"), F.col("document_id"), F.col("model_label"), F.col("run_number"), F.col("bad") == 1, F.col("error"))
    events = j.select("ordinal", completed.alias("completed"), line.alias("line")).filter("line is not null")
    now = rows.select("document_id", F.lit(1).cast("long").alias("done"), "bad").unionByName(before)
    return events, now.groupBy("document_id").agg(F.sum("done").alias("done"), F.sum("bad").alias("bad"))


def follow(runs: DataFrame, total: int, expected: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start reporting a stream of runs below ``folder``; read it with events()."""
    spark = runs.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        earlier = [n for n in _numbers(spark, f"{folder}/counters") if n < number]
        before = spark.read.schema(COUNTERS).parquet(f"{folder}/counters/batch={earlier[-1]}") if earlier else spark.createDataFrame([], COUNTERS)
        events, now = counted(batch, before, total, expected)
        events.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        now.write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")
        for n in earlier[:-1]:  # the last one is what this batch would start from again
            _drop(spark, f"{folder}/counters/batch={n}")

    return runs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def events(spark: SparkSession, folder: str) -> DataFrame:
    """What was reported: ordinal, completed, line."""
    return spark.read.schema("ordinal long, completed long, line string").parquet(f"{folder}/events").select("ordinal", "completed", "line")


def keep_newest(board: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the newest state of a streaming aggregate below ``folder``, a whole table a batch, of which only the
    newest stays; read it with newest()."""
    spark = board.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        for n in _numbers(spark, folder):
            if n < number - 1:
                _drop(spark, f"{folder}/batch={n}")
        if then:
            then(batch, number)

    return board.writeStream.outputMode("complete").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest whole state."""
    return spark.read.parquet(f"{folder}/batch={_numbers(spark, folder)[-1]}")
