"""Leaderboards and other aggregates over runs.

A runs table has: ordinal (order of the log), task_key, model_key, domain, document_id, error,
success, field_total, field_correct, critical_total, critical_correct, found_keys,
requested_keys, latency_ms, cost_micro (millionths of a USD), cache_hit, cached_tokens,
input_tokens, output_tokens. Money is summed in whole millionths, so that sums do not depend
on the order of rows. All aggregates are hash aggregates with partial sums; percentiles and
running counters go by blocks (see blocks), so no task holds a model's or a document's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import combinations, fixed, mean0, pct, round_half, stddev0, variation
from .blocks import running, with_ranks

PASS_AT = (2, 3, 5, 10)


def ok() -> Column:
    """No error: an empty text is none."""
    return F.col("error").isNull() | (F.col("error") == "")


def no_error() -> Column:
    """No error: only null is none."""
    return F.col("error").isNull()


def _when(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def usd(micro: Column) -> Column:
    return micro / F.lit(1e6)


def ranked(rows: DataFrame, *, by: str | None = None) -> DataFrame:
    """Rank without ties: success, field accuracy, cost of a success (none: last), latency, first seen."""
    order = [F.desc("success_rate_pct"), F.desc("avg_field_accuracy_pct"), F.asc_nulls_last("cost_per_success_usd"), F.asc("avg_latency_ms"), F.asc("first_seen")]
    window = Window.partitionBy(*([by] if by else [])).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window).cast("long")).drop("first_seen")


def online(runs: DataFrame, *keys: str) -> DataFrame:
    """One row per model (and further keys): an empty error text is no error, accuracies are of
    runs with fields, pass@N is a power of the success rate."""
    acc, crit = F.col("field_correct") / F.col("field_total") * 100, F.col("critical_correct") / F.col("critical_total") * 100
    fields = _when(ok() & (F.col("field_total") > 0), acc)
    rows = runs.withColumn("_acc", fields).withColumn("_lat", _when(ok(), F.col("latency_ms"))).withColumn("_cost", _when(ok(), F.col("cost_micro")))
    done, wins = F.count("*"), F.count_if("success")
    totals = rows.groupBy("model_key", *keys).agg(
        F.min("ordinal").alias("first_seen"), done.alias("runs_completed"), wins.alias("successful_runs"), F.count_if(~ok()).alias("failed_runs"),
        mean0(F.col("_acc")).alias("fa"), stddev0(F.col("_acc")).alias("fs"), mean0(_when(ok() & (F.col("critical_total") > 0), crit)).alias("ca"),
        mean0(F.col("_lat")).alias("la"), F.coalesce(F.sum("_cost"), F.lit(0)).alias("cost"), F.count("_cost").alias("n_cost"),
    )
    rows = with_ranks(totals, rows, ["model_key", *keys], {"_lat": (95,), "_cost": (95,), "_acc": (5,)})
    rate = pct(F.col("successful_runs"), F.col("runs_completed"))
    mean_cost = F.when(F.col("n_cost") > 0, F.col("cost") / F.col("n_cost")).otherwise(0.0)
    out = rows.select(
        "model_key", *keys, "first_seen", "runs_completed", "successful_runs", "failed_runs", round_half(rate, 2).alias("success_rate_pct"),
        *(round_half(F.when(F.col("runs_completed") >= n, F.pow(rate / 100, F.lit(n)) * 100), 2).alias(f"pass_at_{n}_pct") for n in PASS_AT),
        round_half(F.col("fa"), 2).alias("avg_field_accuracy_pct"), round_half(F.col("ca"), 2).alias("avg_critical_accuracy_pct"),
        round_half(variation(F.col("fa"), F.col("fs")), 2).alias("field_accuracy_variance_pct"),
        round_half(F.col("la"), 1).alias("avg_latency_ms"), round_half(_zero("_lat_p95"), 1).alias("p95_latency_ms"),
        round_half(usd(F.col("cost")), 6).alias("total_cost_usd"), round_half(usd(mean_cost), 6).alias("avg_cost_per_run_usd"),
        F.when(F.col("n_cost") > 0, round_half(usd(mean_cost), 6)).alias("avg_cost_per_doc_usd"),
        F.when(F.col("successful_runs") > 0, round_half(usd(F.col("cost") / F.col("successful_runs")), 6)).alias("cost_per_success_usd"),
        round_half(usd(_zero("_cost_p95")), 6).alias("p95_cost_usd"), round_half(_zero("_acc_p5"), 2).alias("p05_field_accuracy_pct"),
    )
    return out


def leaderboard_online(runs: DataFrame) -> DataFrame:
    return ranked(online(runs))


def leaderboard_by_domain(runs: DataFrame) -> DataFrame:
    """Rows of each domain and of all domains together ('overall'), each ranked by itself.

    Each run feeds two buckets; the aggregate runs once over both."""
    both = runs.withColumn("bucket", F.explode(F.array(F.lit("overall"), F.lower("domain"))))
    return ranked(online(both, "bucket"), by="bucket")


def macro_average(by_domain: DataFrame) -> DataFrame:
    """Mean of a model's rows over domains, unweighted, ranked again."""
    rows = by_domain.filter("bucket <> 'overall'").groupBy("model_key").agg(
        *(round_half(F.avg(c), 4).alias(c) for c in ("success_rate_pct", "avg_field_accuracy_pct", "cost_per_success_usd", "avg_latency_ms")), F.count("*").alias("domains")
    )
    return ranked(rows.withColumn("first_seen", F.col("model_key")))


def trials(runs: DataFrame, *keys: str) -> DataFrame:
    """Trials and successes of each model (and further keys) on each document; a run with an error is a trial."""
    return runs.groupBy("model_key", *keys, "document_id").agg(F.count("*").alias("t"), F.count_if("success").alias("s"))


def pass_threshold(docs: DataFrame, *keys: str) -> DataFrame:
    """Share of documents with n successes; null if any document has fewer than n trials."""
    return docs.groupBy("model_key", *keys).agg(*(round_half(F.when(F.min("t") >= n, F.avg((F.col("s") >= n).cast("double")) * 100), 2).alias(f"pass_at_{n}_pct") for n in PASS_AT))


def pass_strict(docs: DataFrame, *keys: str) -> DataFrame:
    """Mean share of all n-subsets of trials that succeed throughout."""
    one = lambda n: F.avg(F.when(F.col("t") >= n, combinations(F.col("s"), n) / combinations(F.col("t"), n)))
    return docs.groupBy("model_key", *keys).agg(*(round_half(F.when(F.min("t") >= n, one(n) * 100), 2).alias(f"pass_at_{n}_strict_pct") for n in PASS_AT))


def pass_geometric(runs: DataFrame) -> DataFrame:
    rows = runs.groupBy("model_key").agg(F.count("*").alias("n"), F.count_if("success").alias("w"))
    rate = F.col("w") / F.col("n")
    return rows.select("model_key", *(round_half(F.when(F.col("n") >= n, F.pow(rate, F.lit(n)) * 100), 2).alias(f"pass_at_{n}_pct") for n in PASS_AT))


def leaderboard_offline(runs: DataFrame) -> DataFrame:
    return ranked(offline(runs))


def leaderboard_offline_by_domain(runs: DataFrame) -> DataFrame:
    """The offline rows of each domain and of all domains together ('overall'), each ranked by itself."""
    both = runs.withColumn("bucket", F.explode(F.array(F.lit("overall"), F.lower("domain"))))
    return ranked(offline(both, "bucket"), by="bucket")


def offline(runs: DataFrame, *keys: str) -> DataFrame:
    """One row per model (and further keys) from rescored runs: only a null error is no error, success needs critical
    fields, accuracies are means of rounded percentages of runs without an error."""
    runs = runs.withColumn("success", no_error() & (F.col("critical_total") > 0) & (F.col("critical_correct") == F.col("critical_total")))
    field = round_half(pct(F.col("field_correct"), F.col("field_total")), 2)
    crit = round_half(pct(F.col("critical_correct"), F.col("critical_total")), 2)
    found = round_half(pct(F.col("found_keys"), F.col("requested_keys")), 2)
    rows = runs.withColumn("_f", _when(no_error(), field)).withColumn("_lat", _when(no_error(), F.col("latency_ms"))).withColumn("_cost", _when(no_error(), F.col("cost_micro")))
    totals = rows.groupBy("model_key", *keys).agg(
        F.min("ordinal").alias("first_seen"), F.count("*").alias("runs_completed"), F.count_if("success").alias("successful_runs"), F.count_if(~no_error()).alias("failed_runs"),
        mean0(F.col("_f")).alias("fa"), stddev0(F.col("_f")).alias("fs"), mean0(_when(no_error(), crit)).alias("ca"), mean0(_when(no_error(), found)).alias("ka"),
        mean0(F.col("_lat")).alias("la"), stddev0(F.col("_lat")).alias("ls"), F.coalesce(F.sum("_cost"), F.lit(0)).alias("cost"), F.count("_cost").alias("n_cost"),
    )
    rows = with_ranks(totals, rows, ["model_key", *keys], {"_lat": (95,), "_cost": (95,)})
    per = trials(runs, *keys)
    on = ["model_key", *keys]
    mean_cost = F.when(F.col("n_cost") > 0, F.col("cost") / F.col("n_cost")).otherwise(0.0)
    return rows.join(pass_threshold(per, *keys), on).join(pass_strict(per, *keys), on).select(
        *on, "first_seen", "runs_completed", "successful_runs", "failed_runs", round_half(pct(F.col("successful_runs"), F.col("runs_completed")), 2).alias("success_rate_pct"),
        *(f"pass_at_{n}_pct" for n in PASS_AT), *(f"pass_at_{n}_strict_pct" for n in PASS_AT),
        round_half(F.col("fa"), 2).alias("avg_field_accuracy_pct"), round_half(F.col("ca"), 2).alias("avg_critical_accuracy_pct"), round_half(F.col("ka"), 2).alias("avg_keys_found_pct"),
        round_half(F.col("fs"), 2).alias("field_pass_stddev_pct"), round_half(variation(F.col("fa"), F.col("fs")), 2).alias("field_accuracy_variance_pct"),
        round_half(F.col("la"), 1).alias("avg_latency_ms"), round_half(_zero("_lat_p95"), 1).alias("p95_latency_ms"), round_half(F.col("ls"), 2).alias("latency_stddev_ms"),
        round_half(variation(F.col("la"), F.col("ls")), 2).alias("latency_cv_pct"), round_half(usd(F.col("cost")), 6).alias("total_cost_usd"),
        round_half(usd(mean_cost), 6).alias("avg_cost_per_run_usd"), F.when(F.col("n_cost") > 0, round_half(usd(mean_cost), 6)).alias("avg_cost_per_doc_usd"),
        F.when(F.col("successful_runs") > 0, round_half(usd(F.col("cost") / F.col("successful_runs")), 6)).alias("cost_per_success_usd"), round_half(usd(_zero("_cost_p95")), 6).alias("p95_cost_usd"),
    )


def leaderboard_rebuilt(runs: DataFrame) -> DataFrame:
    """The leaderboard as it is rebuilt from a log: like the online one, but with threshold and strict
    pass@N over documents, and the share of keys found."""
    base = online(runs).drop(*(f"pass_at_{n}_pct" for n in PASS_AT))
    found = runs.groupBy("model_key").agg(mean0(_when(ok() & (F.col("requested_keys") > 0), F.col("found_keys") / F.col("requested_keys") * 100)).alias("ka"))
    found = found.select("model_key", round_half(F.col("ka"), 2).alias("avg_keys_found_pct"))
    per = trials(runs)
    return ranked(base.join(found, "model_key").join(pass_threshold(per), "model_key").join(pass_strict(per), "model_key"))


def with_requested(rows: DataFrame, requested: DataFrame, *keys: str) -> DataFrame:
    """Rows with runs_requested: what was scheduled, else what was completed."""
    on = [*keys, "model_key"]
    return rows.join(requested.select(*on, F.col("requested").alias("_asked")), on, "left").withColumn("runs_requested", F.coalesce("_asked", "runs_completed")).drop("_asked")


def with_ranges(rows: DataFrame, ranges: DataFrame, *keys: str) -> DataFrame:
    """Rows with a map of measure to its range; empty where a model has none. Ranges are one row per measure."""
    on = [*keys, "model_key"]
    values = [c for c in ranges.columns if c not in (*on, "measure")]
    packed = ranges.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct(F.col("measure"), F.struct(*values)))).alias("ranges"))
    kind = packed.schema["ranges"].dataType
    return rows.join(packed, on, "left").withColumn("ranges", F.coalesce("ranges", F.create_map().cast(kind)))


def range_stats(rows: DataFrame, measures: dict[str, int], *keys: str) -> DataFrame:
    """A row per keys and measure (name to decimals): count, extremes, nearest-rank percentiles, mean (of decimals,
    so that ties round alike in any order) and deviation; null (count 0) for no values. All measures are
    taken in one pass."""
    each = rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(d).alias("digits"), F.col(m).cast("double").alias("value")) for m, d in measures.items()))))
    v, by = F.col("value"), [*keys, "measure"]
    totals = each.groupBy(*by, "digits").agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v.cast("decimal(26,12)")).cast("double") / F.nullif(F.count(v), F.lit(0))).alias("mean"), F.stddev_pop(v).alias("stddev"))
    full = with_ranks(totals, each, by, {"value": (5, 50, 95)})
    r = lambda c: _rounded(F.col(c), F.col("digits"), sorted(set(measures.values())))
    return full.select(*by, "count", *(r(c).alias(n) for c, n in (("min", "min"), ("value_p5", "p05"), ("value_p50", "p50"), ("value_p95", "p95"), ("max", "max"), ("mean", "mean"), ("stddev", "stddev"))))


def _rounded(x: Column, digits: Column, among: list[int]) -> Column:
    return F.coalesce(*(F.when(digits == d, round_half(x, d)) for d in among))


def _buckets(runs: DataFrame) -> DataFrame:
    return runs.filter(no_error()).withColumn("bucket", F.explode(F.array(F.lit("overall"), F.lower("domain"))))


def representatives(runs: DataFrame, *names: str) -> DataFrame:
    """Of each model the names (label, provider, tier) of its first run."""
    first = F.min_by(F.struct(*names), "ordinal").alias("r")
    return runs.groupBy("model_key").agg(first).select("model_key", "r.*")


def rescored(runs: DataFrame) -> DataFrame:
    """Runs with success and percentages of the comparison, where there is one (``compared``), else those that were logged
    (legacy_success, legacy_critical_pct, legacy_field_pct)."""
    either = lambda now, before: F.when(F.col("compared"), now).otherwise(F.col(before))
    return runs.withColumns({
        "success": either(F.col("success"), "legacy_success"), "critical_pct": either(pct(F.col("critical_correct"), F.col("critical_total")), "legacy_critical_pct"),
        "field_pct": either(pct(F.col("field_correct"), F.col("field_total")), "legacy_field_pct"),
    })


def metric_ranges_run(runs: DataFrame) -> DataFrame:
    """Ranges over runs without an error, by domain and model and over all domains. Percentages are those of
    rescored(), if the runs have them."""
    share = lambda name, part, whole: F.col(name) if name in runs.columns else pct(F.col(part), F.col(whole))
    b = _buckets(runs).select(
        "bucket", "model_key", F.when(F.col("success"), 100.0).otherwise(0.0).alias("success_pct_runs"), share("critical_pct", "critical_correct", "critical_total").alias("critical_fields_pct"),
        share("field_pct", "field_correct", "field_total").alias("all_fields_pct"), F.col("latency_ms").cast("double").alias("latency_ms"),
    )
    return range_stats(b, dict.fromkeys(("success_pct_runs", "critical_fields_pct", "all_fields_pct", "latency_ms"), 3), "bucket", "model_key")


def metric_ranges_doc(runs: DataFrame) -> DataFrame:
    """Ranges over documents; documents with too few runs have no pass@N."""
    d = _buckets(runs).groupBy("bucket", "model_key", F.concat_ws("::", F.lower("domain"), "document_id").alias("doc")).agg(
        F.sum("cost_micro").alias("cost"), F.count("*").alias("t"), F.count_if("success").alias("s")
    )
    strict = lambda n: F.when(F.col("t") >= n, combinations(F.col("s"), n) / combinations(F.col("t"), n) * 100)
    d = d.select(
        "bucket", "model_key", usd(F.col("cost") / F.col("t")).alias("cost_per_doc_usd"), F.when(F.col("s") > 0, usd(F.col("cost") / F.col("s"))).alias("cost_per_success_usd"),
        (F.col("s") / F.col("t") * 100).alias("success_pct_docs"), strict(3).alias("pass_at_3_strict_pct_docs"), strict(5).alias("pass_at_5_strict_pct_docs"),
    )
    return range_stats(d, {"cost_per_doc_usd": 6, "cost_per_success_usd": 6, "success_pct_docs": 3, "pass_at_3_strict_pct_docs": 3, "pass_at_5_strict_pct_docs": 3}, "bucket", "model_key")


def cache_summary(runs: DataFrame) -> DataFrame:
    """Cache hits and tokens of runs without an error; hit rate descending, then label."""
    rows = runs.filter(ok()).groupBy("model_key").agg(
        F.count("*").alias("runs"), F.count_if("cache_hit").alias("cache_hits"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    rows = rows.select(
        "*", round_half(pct(F.col("cache_hits"), F.col("runs")), 2).alias("cache_hit_rate_pct"), *(round_half(F.col(c) / F.col("runs"), 2).alias(f"avg_{c}") for c in ("cached_tokens", "input_tokens", "output_tokens"))
    )
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc("cache_hit_rate_pct"), "model_key")).cast("long"))


def inferred_runs(runs: DataFrame) -> DataFrame:
    """Most runs of one model on one document; 0 without runs."""
    return runs.groupBy("model_key", "document_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("runs_per_model"))


def progress(runs: DataFrame) -> DataFrame:
    """Counters after each task of a document: completed, failed, and whether it was the document's last."""
    r = running(runs.select("ordinal", "document_id", (~ok()).cast("long").alias("bad")), ["document_id"], ["ordinal"], {"completed": F.lit(1), "failed": F.col("bad")})
    return r.select("ordinal", "document_id", "completed", "failed", (F.col("completed") == F.col("completed_total")).alias("document_complete"))


def progress_lines(runs: DataFrame, total: int, expected: DataFrame) -> DataFrame:
    """``runs``: ordinal, document_id, model_label, run_number, error; ``expected``: document_id, runs. What a run
    reports of its tasks in their order: the first, the last, every twentieth part, failures and
    documents that are done: ordinal, completed, line (without the time)."""
    rows = runs.select("ordinal", "document_id", "model_label", "run_number", "error", (~ok()).cast("long").alias("bad"))
    all_ = running(rows, [], ["ordinal"], {"completed": F.lit(1), "failed": F.col("bad")}).drop("completed_total", "failed_total")
    each = running(all_, ["document_id"], ["ordinal"], {"of_document": F.lit(1)}).drop("of_document_total")
    j = each.join(expected.select("document_id", F.col("runs").alias("wanted")), "document_id", "left")
    return j.select("ordinal", "completed", report_line(F.col("completed"), F.col("failed"), total, F.col("of_document"), F.col("wanted"), F.col("document_id"), F.col("model_label"), F.col("run_number"), F.col("bad") == 1, F.col("error")).alias("line")).filter("line is not null")


def report_line(completed: Column, failed: Column, total: int, of_document: Column, wanted: Column, document: Column, label: Column, number: Column, bad: Column, error: Column) -> Column:
    """The line of one task's report; null where there is none."""
    every = max(1, total // 20)
    done = F.coalesce((wanted > 0) & (of_document == wanted), F.lit(False))
    percent = fixed(completed / total * 100, 1) if total > 0 else F.lit("100.0")
    head = F.format_string(f"%d/{total} (%s%%) | ok:%d fail:%d | model:%s run:%d", completed, percent, completed - failed, failed, label, number)
    text = F.concat(head, F.when(done, F.format_string(" | document complete: %s (%d/%d)", document, of_document, wanted)).otherwise(""), F.when(bad, F.concat(F.lit(" | last error: "), F.coalesce(F.nullif(error, F.lit("")), F.lit("unknown error")))).otherwise(""))
    return F.when((completed == 1) | (completed == total) | (completed % every == 0) | done | bad, text)


def cost_projection(runs: DataFrame, target: int) -> DataFrame:
    """Cost so far (of positive costs), mean cost of a run, and what ``target`` runs would cost."""
    agg = runs.agg(F.count("*").alias("completed"), F.count_if(~ok()).alias("failed"), F.coalesce(F.sum(F.when(F.col("cost_micro") > 0, F.col("cost_micro"))), F.lit(0)).alias("micro"))
    mean = F.when(F.col("completed") > 0, F.col("micro") / F.col("completed")).otherwise(0.0)
    return agg.select(
        "completed", "failed", round_half(usd(F.col("micro")), 6).alias("cost_usd"), round_half(usd(mean), 6).alias("avg_cost_usd"),
        F.greatest(F.lit(target) - F.col("completed"), F.lit(0)).cast("long").alias("remaining"), round_half(usd(mean * target), 6).alias("projected_cost_usd"),
    )
