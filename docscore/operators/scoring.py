"""Scores of runs: extracted answers against ground-truth keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import first_json, indexed, json_pairs, text_pairs
from ..functions.text import key_name
from .matching import empty_expectation, hints, matches_any, prepared, scorable


def requested(keys: DataFrame) -> DataFrame:
    """``keys``: document_id, name, critical, expected, data_type, match (and ordinal). One row a document:
    asked, the array of its keys, with what scoring needs of each."""
    order = F.col("ordinal").cast("long") if "ordinal" in keys.columns else F.lit(0).cast("long")
    k = keys.withColumn("o", order).withColumn("h", hints(F.col("name"), F.col("data_type"))).withColumn("counts", scorable(F.col("expected"), F.col("critical")))
    each = k.select("document_id", "name", "o", "critical", "counts", "match", "h", F.posexplode_outer("expected").alias("n", "v")).withColumn("e", F.when(F.trim("v") != "", prepared(F.col("v"), F.col("h"))))
    one = each.groupBy("document_id", "name", "o").agg(*(F.first(c).alias(c) for c in ("critical", "counts", "match", "h")), F.collect_list("e").alias("e"))
    one = one.withColumn("k", key_name(F.col("name")))
    return one.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("o", "name", "k", "critical", "counts", "match", "h", "e"))).alias("asked"))


def _found(runs: DataFrame, keys: Column | None) -> DataFrame:
    """``runs`` with m: key name to (value, found), as answers() gives them; in steps, so that each is a small expression."""
    steps = runs.withColumn("_node", first_json(F.col("raw_output"))).withColumn("_json", json_pairs(F.col("_node"), keys))
    text = text_pairs(F.coalesce("raw_output", F.lit("")), keys)
    steps = steps.withColumn("_pairs", F.when(F.size("_json") > 0, F.col("_json")).otherwise(text))
    return steps.withColumn("m", indexed(F.col("_pairs"))).drop("_node", "_json", "_pairs")


def extracted(runs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``runs``: task_key, document_id, raw_output. One row per key named in an answer: k, value (trimmed), found:
    those of its first pair, or of the first that isn't empty if that is. With ``keys`` (document_id, name)
    bare members and lines count only if their key was asked for, and an answer whose JSON then names
    nothing is read as text."""
    if keys is None:
        found = _found(runs, None)
    else:
        names = keys.groupBy("document_id").agg(F.collect_list("name").alias("asked"))
        found = _found(runs.join(names, "document_id"), F.col("asked"))
    return found.select("task_key", F.explode("m").alias("k", "a")).select("task_key", "k", "a.value", "a.found")


def key_scores(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys``: document_id, name, critical, expected, data_type, match. One row per run and key: value, scored,
    matched, and whether it is the first key of its normalised name.

    Keys are gathered once a document and meet the runs in one join; an answer is read beside the keys that
    were asked for and looked up there, so nothing else is shuffled."""
    asked = runs.join(requested(keys), "document_id")
    found = _found(asked.withColumn("names", F.transform("asked", lambda k: k["name"])), F.col("names"))
    first = lambda k, i: F.array_position(F.transform("asked", lambda x: x["k"]), k["k"]) == i + 1
    rows = found.select("task_key", F.explode(F.transform("asked", lambda k, i: F.struct(k.alias("k"), first(k, i).alias("first"), F.try_element_at("m", k["k"]).alias("a")))).alias("x"))
    j = rows.select("task_key", "x.k", "x.first", "x.a.value", "x.a.found").withColumn("p", prepared(F.coalesce("value", F.lit("")), F.col("k.h")))
    hit = F.when(F.size("k.e") == 0, empty_expectation(F.col("value"), F.col("found"))).otherwise(matches_any(F.col("p"), F.col("k.e"), F.col("k.match"), F.col("k.h")))
    return j.select("task_key", "k.name", "k.critical", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("found", F.lit(False)).alias("found"), F.col("k.counts").alias("scored"), (F.col("k.counts") & hit).alias("matched"), "first")


def score_runs(scores: DataFrame) -> DataFrame:
    """Totals of each run, and success: all critical fields, or all fields if none is critical."""
    s = F.col("scored")
    g = scores.groupBy("task_key").agg(
        F.count_if(s).alias("field_total"), F.count_if("matched").alias("field_correct"), F.count_if(s & F.col("critical")).alias("critical_total"), F.count_if(F.col("matched") & F.col("critical")).alias("critical_correct"),
        F.count_if(F.col("found") & (F.col("value") != "") & F.col("first")).alias("found_keys"), F.count("*").alias("requested_keys"),
    )
    win = F.when(F.col("critical_total") > 0, F.col("critical_correct") == F.col("critical_total")).otherwise((F.col("field_total") > 0) & (F.col("field_correct") == F.col("field_total")))
    return g.withColumn("success", win)
