"""What pages show: lists to choose from, classes and orders of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import fixed


def domains(documents: DataFrame) -> DataFrame:
    """The domains there are, in order."""
    return documents.select("domain").distinct().orderBy("domain")


def documents_of(documents: DataFrame, domain: str) -> DataFrame:
    """A domain's documents, by id."""
    return documents.filter(F.col("domain") == domain).orderBy("document_id")


def runs_of(runs: DataFrame, domain: str, document: str, model: str = "all", number: int | None = None) -> DataFrame:
    """Runs on a document, of one model or of all, and of one number or all, by the model's label, then number."""
    some = runs.filter((F.col("domain") == domain) & (F.col("document_id") == document))
    if model != "all":
        some = some.filter(F.col("model_key") == model)
    if number is not None:
        some = some.filter(F.col("run_number") == number)
    return some.orderBy("model_label", "run_number")


def choices(runs: DataFrame) -> DataFrame:
    """What can be chosen below each document, in one pass: domain, document_id, models and run numbers, in order."""
    g = runs.groupBy("domain", "document_id").agg(F.collect_set(F.struct("model_label", "model_key")).alias("m"), F.collect_set("run_number").alias("n"))
    return g.select("domain", "document_id", F.transform(F.array_sort("m"), lambda x: x["model_key"]).alias("models"), F.array_sort("n").alias("numbers"))


def row_class(scored: Column, matched: Column) -> Column:
    """gray where a key does not count, else pass or fail."""
    return F.when(~F.coalesce(scored, F.lit(False)), "gray").when(F.coalesce(matched, F.lit(False)), "pass").otherwise("fail")


def shown(board: DataFrame) -> DataFrame:
    """A board as it is shown: success, then critical accuracy, both descending."""
    return board.orderBy(F.desc("success_rate_pct"), F.desc("avg_critical_accuracy_pct"))


def percent(v: Column) -> Column:
    return F.coalesce(F.concat(fixed(v, 1), F.lit("%")), F.lit(""))


def dollars(v: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), fixed(v, 4)), F.lit("n/a"))


def seconds(ms: Column) -> Column:
    return F.coalesce(F.concat(fixed(ms / 1000, 1), F.lit("s")), F.lit("n/a"))
