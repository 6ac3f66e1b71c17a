"""Queries over runs and the run log, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import pct, round_half, stddev0, variation
from ..operators import checkpoint as C
from ..operators import leaderboard as L
from ..operators.blocks import nearest_ranks
from .adapters import LOG, RUNS, log, runs, table


def r(x: str, d: int) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN -floor(-({x}) * 1e{d} + 0.5) / 1e{d} ELSE floor(({x}) * 1e{d} + 0.5) / 1e{d} END)"


def comb(n: str, k: int) -> str:
    """n over k in SQL."""
    return "(CASE WHEN {n} >= {k} THEN {p} ELSE 0e0 END)".format(n=n, k=k, p=" * ".join(f"(({n} - {k - i}) / {i}e0)" for i in range(1, k + 1)))


_ACC, _CRIT = "field_correct * 100e0 / field_total", "critical_correct * 100e0 / critical_total"


def _online(key: str, source: str) -> str:
    keys = f"model_key{', ' + key if key else ''}"
    return f"""g AS (SELECT {keys}, min(ordinal) AS first_seen, count(*) AS n, count(*) FILTER (success) AS w, count(*) FILTER (error <> '') AS bad,
  coalesce(avg({_ACC}) FILTER (coalesce(error, '') = '' AND field_total > 0), 0) AS fa, coalesce(stddev_pop({_ACC}) FILTER (coalesce(error, '') = '' AND field_total > 0), 0) AS fs,
  coalesce(avg({_CRIT}) FILTER (coalesce(error, '') = '' AND critical_total > 0), 0) AS ca,
  coalesce(quantile_disc({_ACC}, 0.05) FILTER (coalesce(error, '') = '' AND field_total > 0), 0) AS f05,
  coalesce(avg(latency_ms) FILTER (coalesce(error, '') = ''), 0) AS la, coalesce(quantile_disc(latency_ms, 0.95) FILTER (coalesce(error, '') = ''), 0) AS l95,
  coalesce(sum(cost_micro) FILTER (coalesce(error, '') = ''), 0) AS cost, count(*) FILTER (coalesce(error, '') = '') AS nc, coalesce(quantile_disc(cost_micro, 0.95) FILTER (coalesce(error, '') = ''), 0) AS c95
  FROM {source} GROUP BY {keys}),
o AS (SELECT {keys}, first_seen, n AS runs_completed, w AS successful_runs, bad AS failed_runs, {r('w * 100e0 / n', 2)} AS success_rate_pct,
  {', '.join(f"CASE WHEN n >= {k} THEN {r(f'pow(w / (n * 1e0), {k}) * 100', 2)} END AS pass_at_{k}_pct" for k in L.PASS_AT)},
  {r('fa', 2)} AS avg_field_accuracy_pct, {r('ca', 2)} AS avg_critical_accuracy_pct, {r('CASE WHEN fa > 0 THEN fs / fa * 100 ELSE 100e0 END', 2)} AS field_accuracy_variance_pct,
  {r('la', 1)} AS avg_latency_ms, {r('l95 * 1e0', 1)} AS p95_latency_ms, {r('cost / 1e6', 6)} AS total_cost_usd,
  {r('CASE WHEN nc > 0 THEN cost / (nc * 1e0) ELSE 0e0 END / 1e6', 6)} AS avg_cost_per_run_usd, CASE WHEN nc > 0 THEN {r('cost / (nc * 1e0) / 1e6', 6)} END AS avg_cost_per_doc_usd,
  CASE WHEN w > 0 THEN {r('cost / (w * 1e0) / 1e6', 6)} END AS cost_per_success_usd, {r('c95 / 1e6', 6)} AS p95_cost_usd, {r('f05', 2)} AS p05_field_accuracy_pct FROM g)"""


_RANK = "row_number() OVER ({p}ORDER BY success_rate_pct DESC, avg_field_accuracy_pct DESC, cost_per_success_usd ASC NULLS LAST, avg_latency_ms, first_seen) AS rank"
_BOTH = "both_ AS (SELECT *, unnest(['overall', lower(domain)]) AS bucket FROM runs)"
ONLINE = f"WITH {RUNS}, {_online('', 'runs')} SELECT * EXCLUDE first_seen, {_RANK.format(p='')} FROM o"
BY_DOMAIN = f"WITH {RUNS}, {_BOTH}, {_online('bucket', 'both_')}, d AS (SELECT *, {_RANK.format(p='PARTITION BY bucket ')} FROM o)"
_TRIALS = "per AS (SELECT model_key, document_id, count(*) AS t, count(*) FILTER ({s}) AS s FROM runs GROUP BY ALL)"
_THRESHOLD = ", ".join(f"CASE WHEN min(t) >= {n} THEN {r(f'avg(CASE WHEN s >= {n} THEN 1e0 ELSE 0e0 END) * 100', 2)} END AS pass_at_{n}_pct" for n in L.PASS_AT)
_STRICT = ", ".join(f"CASE WHEN min(t) >= {n} THEN {r(f'avg({comb('s', n)} / {comb('t', n)}) FILTER (t >= {n}) * 100', 2)} END AS pass_at_{n}_strict_pct" for n in L.PASS_AT)
_OFF_WIN = "error IS NULL AND critical_total > 0 AND critical_correct = critical_total"
_F = r("CASE WHEN field_total > 0 THEN field_correct * 100e0 / field_total ELSE 0e0 END", 2)
_C = r("CASE WHEN critical_total > 0 THEN critical_correct * 100e0 / critical_total ELSE 0e0 END", 2)
_K = r("CASE WHEN requested_keys > 0 THEN found_keys * 100e0 / requested_keys ELSE 0e0 END", 2)
def _offline(key: str, source: str) -> str:
    k = f", {key}" if key else ""
    return f"""per AS (SELECT model_key{k}, document_id, count(*) AS t, count(*) FILTER ({_OFF_WIN}) AS s FROM {source} GROUP BY ALL), th AS (SELECT model_key{k}, {_THRESHOLD}, {_STRICT} FROM per GROUP BY model_key{k}),
g AS (SELECT model_key{k}, min(ordinal) AS first_seen, count(*) AS n, count(*) FILTER ({_OFF_WIN}) AS w, count(*) FILTER (error IS NOT NULL) AS bad,
  coalesce(avg({_F}) FILTER (error IS NULL), 0) AS fa, coalesce(stddev_pop({_F}) FILTER (error IS NULL), 0) AS fs, coalesce(avg({_C}) FILTER (error IS NULL), 0) AS ca, coalesce(avg({_K}) FILTER (error IS NULL), 0) AS ka,
  coalesce(avg(latency_ms) FILTER (error IS NULL), 0) AS la, coalesce(stddev_pop(latency_ms) FILTER (error IS NULL), 0) AS ls, coalesce(quantile_disc(latency_ms, 0.95) FILTER (error IS NULL), 0) AS l95,
  coalesce(sum(cost_micro) FILTER (error IS NULL), 0) AS cost, count(*) FILTER (error IS NULL) AS nc, coalesce(quantile_disc(cost_micro, 0.95) FILTER (error IS NULL), 0) AS c95 FROM {source} GROUP BY model_key{k}),
o AS (SELECT model_key{k}, first_seen, n AS runs_completed, w AS successful_runs, bad AS failed_runs, {r('w * 100e0 / n', 2)} AS success_rate_pct, th.* EXCLUDE (model_key{k}),
  {r('fa', 2)} AS avg_field_accuracy_pct, {r('ca', 2)} AS avg_critical_accuracy_pct, {r('ka', 2)} AS avg_keys_found_pct, {r('fs', 2)} AS field_pass_stddev_pct,
  {r('CASE WHEN fa > 0 THEN fs / fa * 100 ELSE 100e0 END', 2)} AS field_accuracy_variance_pct, {r('la', 1)} AS avg_latency_ms, {r('l95 * 1e0', 1)} AS p95_latency_ms, {r('ls', 2)} AS latency_stddev_ms,
  {r('CASE WHEN la > 0 THEN ls / la * 100 ELSE 100e0 END', 2)} AS latency_cv_pct, {r('cost / 1e6', 6)} AS total_cost_usd,
  {r('CASE WHEN nc > 0 THEN cost / (nc * 1e0) ELSE 0e0 END / 1e6', 6)} AS avg_cost_per_run_usd, CASE WHEN nc > 0 THEN {r('cost / (nc * 1e0) / 1e6', 6)} END AS avg_cost_per_doc_usd,
  CASE WHEN w > 0 THEN {r('cost / (w * 1e0) / 1e6', 6)} END AS cost_per_success_usd, {r('c95 / 1e6', 6)} AS p95_cost_usd FROM g JOIN th USING (model_key{k}))"""


OFFLINE = f"WITH {RUNS}, {_offline('', 'runs')} SELECT * EXCLUDE first_seen, {_RANK.format(p='')} FROM o"
OFFLINE_BY_DOMAIN = f"WITH {RUNS}, {_BOTH}, {_offline('bucket', 'both_')} SELECT * EXCLUDE first_seen, {_RANK.format(p='PARTITION BY bucket ')} FROM o"
REBUILT = f"""WITH {RUNS}, {_online('', 'runs')}, {_TRIALS.format(s='success')}, th AS (SELECT model_key, {_THRESHOLD}, {_STRICT} FROM per GROUP BY model_key),
k AS (SELECT model_key, {r("coalesce(avg(found_keys * 100e0 / requested_keys) FILTER (coalesce(error, '') = '' AND requested_keys > 0), 0)", 2)} AS avg_keys_found_pct FROM runs GROUP BY model_key),
b AS (SELECT o.* EXCLUDE ({', '.join(f'pass_at_{n}_pct' for n in L.PASS_AT)}), k.avg_keys_found_pct, th.* EXCLUDE model_key FROM o JOIN k USING (model_key) JOIN th USING (model_key))
SELECT * EXCLUDE first_seen, {_RANK.format(p='')} FROM b"""
MACRO = f"""{BY_DOMAIN}, m AS (SELECT model_key, {', '.join(f"{r(f'avg({c})', 4)} AS {c}" for c in ('success_rate_pct', 'avg_field_accuracy_pct', 'cost_per_success_usd', 'avg_latency_ms'))}, count(*) AS domains, model_key AS first_seen
  FROM d WHERE bucket <> 'overall' GROUP BY model_key) SELECT * EXCLUDE first_seen, {_RANK.format(p='')} FROM m"""


def _stats(measures: dict[str, int], source: str) -> str:
    def one(m: str, d: int) -> str:
        q = ", ".join(f"{r(f'quantile_disc({m}, {p / 100})', d)} AS p{p:02d}" for p in (5, 50, 95))
        return f"SELECT bucket, model_key, '{m}' AS measure, count({m}) AS count, {r(f'min({m})', d)} AS min, {q}, {r(f'max({m})', d)} AS max, {r(f'CAST(sum(CAST({m} AS DECIMAL(26,12))) AS DOUBLE) / count({m})', d)} AS mean, {r(f'stddev_pop({m})', d)} AS stddev FROM {source} GROUP BY bucket, model_key"

    return " UNION ALL ".join(one(m, d) for m, d in measures.items())


RANGES_RUN = f"""WITH {RUNS}, {_BOTH}, x AS (SELECT bucket, model_key, CASE WHEN success THEN 100e0 ELSE 0e0 END AS success_pct_runs,
  CASE WHEN critical_total > 0 THEN {_CRIT} ELSE 0e0 END AS critical_fields_pct, CASE WHEN field_total > 0 THEN {_ACC} ELSE 0e0 END AS all_fields_pct, CAST(latency_ms AS DOUBLE) AS latency_ms FROM both_ WHERE error IS NULL)
{_stats(dict.fromkeys(('success_pct_runs', 'critical_fields_pct', 'all_fields_pct', 'latency_ms'), 3), 'x')}"""
RANGES_DOC = f"""WITH {RUNS}, {_BOTH}, d AS (SELECT bucket, model_key, lower(domain) || '::' || document_id AS doc, sum(cost_micro) AS cost, count(*) AS t, count(*) FILTER (success) AS s FROM both_ WHERE error IS NULL GROUP BY ALL),
x AS (SELECT bucket, model_key, cost / (t * 1e0) / 1e6 AS cost_per_doc_usd, CASE WHEN s > 0 THEN cost / (s * 1e0) / 1e6 END AS cost_per_success_usd, s * 100e0 / t AS success_pct_docs,
  CASE WHEN t >= 3 THEN {comb('s', 3)} / {comb('t', 3)} * 100 END AS pass_at_3_strict_pct_docs, CASE WHEN t >= 5 THEN {comb('s', 5)} / {comb('t', 5)} * 100 END AS pass_at_5_strict_pct_docs FROM d)
{_stats({'cost_per_doc_usd': 6, 'cost_per_success_usd': 6, 'success_pct_docs': 3, 'pass_at_3_strict_pct_docs': 3, 'pass_at_5_strict_pct_docs': 3}, 'x')}"""
CACHE = f"""WITH {RUNS}, g AS (SELECT model_key, count(*) AS runs, count(*) FILTER (cache_hit) AS cache_hits, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
  FROM runs WHERE coalesce(error, '') = '' GROUP BY model_key), h AS (SELECT *, {r('cache_hits * 100e0 / runs', 2)} AS cache_hit_rate_pct,
  {', '.join(f"{r(f'{c} * 1e0 / runs', 2)} AS avg_{c}" for c in ('cached_tokens', 'input_tokens', 'output_tokens'))} FROM g)
SELECT *, row_number() OVER (ORDER BY cache_hit_rate_pct DESC, model_key) AS position FROM h"""
PROJECTION = f"""WITH {RUNS}, a AS (SELECT count(*) AS completed, count(*) FILTER (error <> '') AS failed, coalesce(sum(cost_micro) FILTER (cost_micro > 0), 0) AS micro FROM runs)
SELECT completed, failed, {r('micro / 1e6', 6)} AS cost_usd, {r('micro / (completed * 1e0) / 1e6', 6)} AS avg_cost_usd, greatest(100000 - completed, 0) AS remaining, {r('micro / (completed * 1e0) * 100000 / 1e6', 6)} AS projected_cost_usd FROM a"""

_GRID = """grid AS (SELECT *, concat_ws('::', model_key, domain, document_id, CAST(run AS VARCHAR)) AS task_key FROM
  (SELECT 'p' || n_nationkey % 4 || ':m' || n_nationkey AS model_key FROM nation WHERE n_nationkey < 12),
  (SELECT DISTINCT 'd' || p_partkey % 30 % 3 AS domain, 'doc-' || p_partkey % 30 AS document_id FROM part),
  (SELECT unnest(generate_series(1, 45)) AS run))"""


def _grid(spark, d):
    n = F.col("n_nationkey")
    models = table(spark, d, "nation").filter("n_nationkey < 12").select(F.concat(F.lit("p"), n % 4, F.lit(":m"), n).alias("model_key"))
    k = F.col("p_partkey") % 30
    docs = table(spark, d, "part").select(F.concat(F.lit("d"), k % 3).alias("domain"), F.concat(F.lit("doc-"), k).alias("document_id")).distinct()
    return C.task_grid(models, docs, 45)


_FULL = ("task_key", "ordinal", "model_key", "success", "error", "cost_micro")


def round_rules(spark, d):
    x = (F.col("l_extendedprice") - 20000) / 7
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", round_half(x, 2).alias("r2"), round_half(x, 0).alias("r0"), round_half(F.col("l_discount") * 1.005, 2).alias("small"))


def percentile_rules(spark, d):
    r = nearest_ranks(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"l_extendedprice": (5, 50, 95)})
    return r.select("l_returnflag", "l_linestatus", *(F.col(f"l_extendedprice_p{p}").alias(f"p{p:02d}") for p in (5, 50, 95)))


def progress_report(spark, d):
    """What the run reports of all its tasks; a document is done after as many runs as one model had on it."""
    x = runs(spark, d).withColumn("model_label", F.upper("model_key")).withColumn("run_number", (F.col("ordinal") % 40).cast("int"))
    expected = x.groupBy("document_id").agg(F.countDistinct("model_key").alias("runs"))
    return L.progress_lines(x, x.count(), expected)


PROGRESS = f"""WITH {RUNS}, w AS (SELECT document_id, count(DISTINCT model_key) AS wanted FROM runs GROUP BY ALL), n AS (SELECT count(*) AS total FROM runs),
r AS (SELECT *, count(*) OVER (ORDER BY ordinal) AS completed, count(*) FILTER (error <> '') OVER (ORDER BY ordinal) AS failed, count(*) OVER (PARTITION BY document_id ORDER BY ordinal) AS k FROM runs JOIN w USING (document_id), n)
SELECT ordinal, completed, printf('%d/%d (%.1f%%) | ok:%d fail:%d | model:%s run:%d', completed, total, completed / (total * 1e0) * 100, completed - failed, failed, upper(model_key), ordinal % 40)
  || CASE WHEN k = wanted THEN printf(' | document complete: %s (%d/%d)', document_id, k, wanted) ELSE '' END || CASE WHEN error <> '' THEN ' | last error: ' || error ELSE '' END AS line
FROM r WHERE completed = 1 OR completed = total OR completed % greatest(1, total // 20) = 0 OR k = wanted OR error <> ''"""


def cv_rules(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_linenumber", (F.col("l_suppkey") % 5).alias("s")).agg(F.avg(F.col("l_discount") * 100 - 5).alias("m"), stddev0(F.col("l_discount") * 100 - 5).alias("sd"))
    return g.select("l_linenumber", "s", round_half(variation(F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("m") + 6), F.col("sd")), 4).alias("cv"), round_half(pct(F.col("s"), F.col("l_linenumber") - 1), 4).alias("pct"))


def cost_estimate(spark, d):
    """Cost of each run from its tokens and a price list by exact model; no price, no cost."""
    from ..functions.rounding import token_cost
    from .prices import prices

    t = runs(spark, d).withColumn("model_id", F.get(F.array(*(F.lit(x) for x in ("gpt-5", "o3", "claude-haiku-3", "gemini-3.1-flash-lite-preview", "mistral-large-latest", "unlisted"))), F.col("ordinal") % 6))
    j = t.join(F.broadcast(prices(spark)), "model_id", "left")
    cost = token_cost(F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out"), F.col("price_cached"))
    return j.select("ordinal", "model_id", round_half(F.coalesce(cost, F.lit(0.0)), 9).alias("usd"))


def compare_branches(spark, d):
    """Runs against ground truth by domain and document: no ground truth, runtime error or scored, and success by the offline rule."""
    x = runs(spark, d)
    truth = table(spark, d, "labels").filter("quality = 1").select(F.concat(F.lit("d"), F.col("doc_id") % 3).alias("domain"), F.concat(F.lit("doc-"), F.col("doc_id") % 30).alias("document_id")).filter("document_id <> 'doc-4'").distinct()
    key = F.concat_ws("::", F.lower("domain"), "document_id")
    j = x.withColumn("doc", key).join(truth.select(key.alias("doc"), F.lit(True).alias("known")), "doc", "left")
    branch = F.when(F.col("known").isNull(), "no_ground_truth").when(F.col("error").isNotNull(), "runtime_error").otherwise("scored")
    win = (F.col("critical_total") > 0) & (F.col("critical_correct") == F.col("critical_total"))
    return j.select("ordinal", "doc", branch.alias("branch"), F.when(branch == "scored", win).alias("offline_success"), F.when(branch == "scored", win != F.col("success")).alias("success_changed"))


_COMPARE = f"""WITH {RUNS}, t AS (SELECT DISTINCT 'd' || doc_id % 3 || '::doc-' || doc_id % 30 AS doc FROM labels WHERE quality = 1 AND doc_id % 30 <> 4),
j AS (SELECT r.*, lower(domain) || '::' || document_id AS doc, t.doc IS NOT NULL AS known FROM runs r LEFT JOIN t ON t.doc = lower(domain) || '::' || document_id),
b AS (SELECT ordinal, doc, CASE WHEN NOT known THEN 'no_ground_truth' WHEN error IS NOT NULL THEN 'runtime_error' ELSE 'scored' END AS branch, critical_total > 0 AND critical_correct = critical_total AS win, success FROM j)"""
COMPARE = f"{_COMPARE} SELECT ordinal, doc, branch, CASE WHEN branch = 'scored' THEN win END AS offline_success, CASE WHEN branch = 'scored' THEN win <> success END AS success_changed FROM b"


def success_flips(spark, d):
    return compare_branches(spark, d).groupBy("branch").agg(F.count("*").alias("runs"), F.count_if("offline_success").alias("successes"), F.count_if("success_changed").alias("changed"))


FLIPS = f"{_COMPARE} SELECT branch, count(*) AS runs, count(*) FILTER (branch = 'scored' AND win) AS successes, count(*) FILTER (branch = 'scored' AND win <> success) AS changed FROM b GROUP BY branch"

_PRICE_CASE = "VALUES ('gpt-5', 1.25e0, 10e0, NULL), ('o3', 2e0, 8e0, NULL), ('claude-haiku-3', 0.25e0, 1.25e0, NULL), ('gemini-3.1-flash-lite-preview', 0.25e0, 1.5e0, 0.025e0), ('mistral-large-latest', 0.5e0, 1.5e0, NULL)"

QUERIES = {
    "leaderboard_online": (lambda s, d: L.leaderboard_online(runs(s, d)), ONLINE),
    "leaderboard_offline": (lambda s, d: L.leaderboard_offline(runs(s, d)), OFFLINE),
    "leaderboard_offline_domains": (lambda s, d: L.leaderboard_offline_by_domain(runs(s, d)), OFFLINE_BY_DOMAIN),
    "leaderboard_by_domain": (lambda s, d: L.leaderboard_by_domain(runs(s, d)), f"{BY_DOMAIN} SELECT * EXCLUDE first_seen FROM d"),
    "leaderboard_macro_avg": (lambda s, d: L.macro_average(L.leaderboard_by_domain(runs(s, d))), MACRO),
    "pass_threshold": (lambda s, d: L.pass_threshold(L.trials(runs(s, d))), f"WITH {RUNS}, {_TRIALS.format(s='success')} SELECT model_key, {_THRESHOLD} FROM per GROUP BY model_key"),
    "pass_strict": (lambda s, d: L.pass_strict(L.trials(runs(s, d))), f"WITH {RUNS}, {_TRIALS.format(s='success')} SELECT model_key, {_STRICT} FROM per GROUP BY model_key"),
    "pass_geometric": (
        lambda s, d: L.pass_geometric(runs(s, d)),
        f"WITH {RUNS}, g AS (SELECT model_key, count(*) AS n, count(*) FILTER (success) AS w FROM runs GROUP BY model_key) SELECT model_key, "
        + ", ".join(f"CASE WHEN n >= {k} THEN {r(f'pow(w / (n * 1e0), {k}) * 100', 2)} END AS pass_at_{k}_pct" for k in L.PASS_AT) + " FROM g",
    ),
    "metric_ranges_run": (lambda s, d: L.metric_ranges_run(runs(s, d)), RANGES_RUN),
    "metric_ranges_doc": (lambda s, d: L.metric_ranges_doc(runs(s, d)), RANGES_DOC),
    "leaderboard_rebuilt": (lambda s, d: L.leaderboard_rebuilt(runs(s, d)), REBUILT),
    "leaderboard_requested": (lambda s, d: L.with_requested(L.online(runs(s, d)).select("model_key", "runs_completed"), C.requested(_grid(s, d)).filter("bucket = 'overall'")), f"WITH {RUNS}, {_GRID}, q AS (SELECT model_key, count(*) AS n FROM grid GROUP BY ALL), c AS (SELECT model_key, count(*) AS runs_completed FROM runs GROUP BY ALL) SELECT model_key, runs_completed, coalesce(n, runs_completed) AS runs_requested FROM c LEFT JOIN q USING (model_key)"),
    "leaderboard_ranges": (
        lambda s, d: L.with_ranges(L.leaderboard_by_domain(runs(s, d)).select("bucket", "model_key"), L.metric_ranges_run(runs(s, d).filter("domain <> 'd2'")), "bucket").select("bucket", "model_key", F.size("ranges").alias("measures"), F.element_at("ranges", "latency_ms")["max"].alias("latency_max")),
        f"WITH {RUNS}, {_BOTH}, x AS (SELECT bucket, model_key, max(latency_ms) AS m FROM both_ WHERE error IS NULL AND domain <> 'd2' GROUP BY ALL), k AS (SELECT DISTINCT bucket, model_key FROM both_) SELECT bucket, model_key, CASE WHEN m IS NULL THEN 0 ELSE 4 END AS measures, CAST(m AS DOUBLE) AS latency_max FROM k LEFT JOIN x USING (bucket, model_key)",
    ),
    "cache_summary": (lambda s, d: L.cache_summary(runs(s, d)), CACHE),
    "checkpoint_latest": (lambda s, d: C.latest(log(s, d)).select(*_FULL), f"WITH {LOG} SELECT {', '.join(_FULL)} FROM latest"),
    "checkpoint_status_models": (lambda s, d: C.status_by_model(log(s, d)), f"WITH {LOG} SELECT model_key, count(*) FILTER (coalesce(error, '') = '') AS ok, count(*) FILTER (error <> '') AS failed, count(*) FILTER (error <> '') / (count(*) * 1e0) AS failure_rate FROM latest GROUP BY model_key"),
    "top_errors": (lambda s, d: C.top_errors(log(s, d)), f"WITH {LOG}, f AS (SELECT task_key, min(ordinal) AS seen FROM log GROUP BY ALL) SELECT error, count(*) AS n FROM latest JOIN f USING (task_key) WHERE error <> '' GROUP BY error ORDER BY n DESC, min(seen) LIMIT 10"),
    "cost_projection": (lambda s, d: L.cost_projection(runs(s, d), 100_000), PROJECTION),
    "task_grid": (lambda s, d: _grid(s, d), f"WITH {_GRID} SELECT * FROM grid"),
    "resume_anti": (lambda s, d: C.to_resume(_grid(s, d), log(s, d)).select("task_key"), f"WITH {LOG}, {_GRID} SELECT task_key FROM grid WHERE task_key NOT IN (SELECT task_key FROM log)"),
    "retry_semi": (lambda s, d: C.to_retry(_grid(s, d), log(s, d)).select("task_key"), f"WITH {LOG}, {_GRID} SELECT task_key FROM grid WHERE task_key IN (SELECT task_key FROM latest WHERE error <> '')"),
    "requested_counts": (lambda s, d: C.requested(_grid(s, d)), f"WITH {_GRID} SELECT bucket, model_key, count(*) AS requested FROM (SELECT *, unnest(['overall', domain]) AS bucket FROM grid) GROUP BY ALL"),
    "infer_runs": (lambda s, d: L.inferred_runs(runs(s, d)), f"WITH {RUNS} SELECT coalesce(max(c), 0) AS runs_per_model FROM (SELECT count(*) AS c FROM runs GROUP BY model_key, document_id)"),
    "running_progress": (
        lambda s, d: L.progress(runs(s, d)),
        f"WITH {RUNS} SELECT ordinal, document_id, count(*) OVER w AS completed, CAST(coalesce(sum(CASE WHEN error <> '' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS failed, count(*) OVER w = count(*) OVER (PARTITION BY document_id) AS document_complete FROM runs WINDOW w AS (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)",
    ),
    "progress_report": (progress_report, PROGRESS),
    "cost_estimate": (
        cost_estimate,
        f"WITH {RUNS}, p(model_id, pi, po, pc) AS ({_PRICE_CASE}), t AS (SELECT *, ['gpt-5', 'o3', 'claude-haiku-3', 'gemini-3.1-flash-lite-preview', 'mistral-large-latest', 'unlisted'][ordinal % 6 + 1] AS model_id FROM runs) SELECT ordinal, model_id, {r('coalesce((greatest(input_tokens - cached_tokens, 0) * pi + greatest(cached_tokens, 0) * coalesce(pc, pi) + greatest(output_tokens, 0) * po) / 1e6, 0e0)', 9)} AS usd FROM t LEFT JOIN p USING (model_id)",
    ),
    "compare_branches": (compare_branches, COMPARE),
    "success_flips": (success_flips, FLIPS),
    "round_rules": (round_rules, f"SELECT l_orderkey, l_linenumber, {r('(l_extendedprice - 20000) / 7', 2)} AS r2, {r('(l_extendedprice - 20000) / 7', 0)} AS r0, {r('l_discount * 1.005e0', 2)} AS small FROM lineitem"),
    "percentile_rules": (percentile_rules, "SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.05) AS p05, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY ALL"),
    "cv_rules": (
        cv_rules,
        f"WITH g AS (SELECT l_linenumber, l_suppkey % 5 AS s, avg(l_discount * 100 - 5) AS m, stddev_pop(l_discount * 100 - 5) AS sd FROM lineitem GROUP BY ALL), h AS (SELECT l_linenumber, s, CASE WHEN l_linenumber = 1 THEN 0e0 ELSE m + 6 END AS m, sd FROM g) SELECT l_linenumber, s, {r('CASE WHEN m > 0 THEN sd / m * 100 ELSE 100e0 END', 4)} AS cv, {r('CASE WHEN l_linenumber > 1 THEN s * 100e0 / (l_linenumber - 1) ELSE 0e0 END', 4)} AS pct FROM h",
    ),
}
