"""Queries over settings, requests, usage, tables of boards and views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.responses import used_tokens
from ..functions.text import provider
from ..operators import artifacts as A
from ..operators import checkpoint as C
from ..operators import config, render, views
from ..operators import leaderboard as L
from ..operators import requests as Q
from ..operators.runner import SHAPE_OF, replay
from .adapters import LOG, RUNS, log, runs, table
from .aggregates import OFFLINE, ONLINE, REBUILT, r
from .scalars import sql_strip

_MODELS = ("gpt-5.4-mini", "gemini-2.5-flash", "o3", "claude-haiku-3", "mistral-ocr-latest", "gpt-4.1", "gemini-2.0-pro")
_SYSTEM, _USER = "Read the \"keys\".", "Answer in JSON\nonly."


def _pick(words, k):
    return F.get(F.array(*(F.lit(w) for w in words)), (k % len(words)).cast("int"))


def request_bodies(spark, d):
    """The request of every document to every kind of service."""
    k = F.col("doc_id")
    base64 = F.replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), F.lit("\r\n"), F.lit(""))
    x = table(spark, d, "documents").select("doc_id", _pick(_MODELS, k).alias("m"), base64.alias("b"))
    s, u, m, b, n = F.lit(_SYSTEM), F.lit(_USER), F.col("m"), F.col("b"), F.lit(4000)
    bodies = {
        "blocks": Q.blocks_body(m, s, u, b, n, temperature=False), "generate": Q.generate_body(m, s, u, b, n, F.when(k % 3 == 0, F.concat(F.lit("cached/"), k))),
        "responses": Q.responses_body(m, s, u, b, n, F.when(k % 2 == 0, F.concat(F.lit("f"), k, F.lit(".pdf")))), "pages": Q.pages_body(m, s, u, b, '{"type":"object"}'),
    }
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("service"), body.alias("body")) for name, body in bodies.items())))
    return x.select("doc_id", "m", each.alias("x")).select("doc_id", "x.service", F.sha2("x.body", 256).alias("digest"), Q.reasoning_effort(F.col("m")).alias("effort"), Q.is_page_model(F.col("m")).alias("pages"))


def _request_sql() -> str:
    q = lambda t: "'" + t.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("'", "''") + "'"
    s, u = f"""'"' || {q(_SYSTEM)} || '"'""", f"""'"' || {q(_USER)} || '"'"""
    raw = lambda t: "'" + t.replace("'", "''") + "'"
    key = f"sha256(m || chr(10) || {raw(_SYSTEM)} || chr(10) || {raw(_USER)} || chr(10) || b)"
    mark = "',\"cache_control\":{\"type\":\"ephemeral\"}}'"
    blocks = f"""'{{"model":"' || m || '","max_tokens":4000,"system":[{{"type":"text","text":' || {s} || {mark} || '],"messages":[{{"role":"user","content":[{{"type":"document","source":{{"type":"base64","media_type":"application/pdf","data":"' || b || '"}}' || {mark} || ',{{"type":"text","text":' || {u} || {mark} || ']}}],"metadata":{{"user_id":"ocr-' || left({key}, 24) || '"}}}}'"""
    settings = """'"generationConfig":{"maxOutputTokens":4000,"temperature":0' || CASE WHEN contains(m, 'flash') THEN ',"thinkingConfig":{"thinkingBudget":0}' ELSE '' END || '}}'"""
    generate = f"""CASE WHEN m = 'gemini-2.5-flash' AND doc_id % 3 = 0 THEN '{{"cachedContent":"cached/' || doc_id || '","contents":[{{"role":"user","parts":[{{"text":' || {u} || '}}]}}],' || {settings}
      ELSE '{{"systemInstruction":{{"parts":[{{"text":' || {s} || '}}]}},"contents":[{{"role":"user","parts":[{{"inlineData":{{"mimeType":"application/pdf","data":"' || b || '"}}}},{{"text":' || {u} || '}}]}}],' || {settings} END"""
    effort = "CASE WHEN m = 'gpt-5.4-mini' THEN 'low' WHEN m = 'o3' THEN 'minimal' END"
    responses = f"""'{{"model":"' || m || '","max_output_tokens":4000,"input":[{{"role":"system","content":[{{"type":"input_text","text":' || {s} || '}}]}},{{"role":"user","content":[{{"type":"input_file","filename":"' || CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id || '.pdf' ELSE 'document.pdf' END
      || '","file_data":"data:application/pdf;base64,' || b || '"}},{{"type":"input_text","text":' || {u} || '}}]}}],"prompt_cache_key":"' || {key} || '"' || coalesce(',"reasoning":{{"effort":"' || {effort} || '"}}', '') || '}}'"""
    pages = f"""'{{"model":"' || m || '","document":{{"type":"document_url","document_url":"data:application/pdf;base64,' || b || '"}},"document_annotation_format":{{"type":"json_schema","json_schema":{{"name":"ocr_key_extraction","schema":{{"type":"object"}}}}}},"document_annotation_prompt":"' || {q(_SYSTEM)} || '\\n\\n' || {q(_USER)} || '"}}'"""
    models = "[" + ", ".join(f"'{m}'" for m in _MODELS) + "]"
    return f"""WITH x AS (SELECT doc_id, {models}[doc_id % {len(_MODELS)} + 1] AS m, base64(encode(coalesce(text, ''))) AS b FROM documents),
y AS (SELECT doc_id, m, unnest(['blocks', 'generate', 'responses', 'pages']) AS service, unnest([{blocks}, {generate}, {responses}, {pages}]) AS body FROM x)
SELECT doc_id, service, sha256(body) AS digest, {effort} AS effort, starts_with(m, 'mistral-ocr') AS pages FROM y"""


_USE_SHAPES = ("blocks", "output", "candidates", "chat")


def usage_tokens(spark, d):
    """Tokens that the responses of every run name, in four shapes; some name none, or no numbers."""
    x, n = runs(spark, d), F.col("ordinal")
    i, o, c = (F.col(v).cast("string") for v in ("input_tokens", "output_tokens", "cached_tokens"))
    odd = lambda v: F.when(n % 10 == 1, F.lit('"7"')).when(n % 10 == 2, F.lit("null")).otherwise(v)
    forms = (
        F.format_string('{"usage":{"input_tokens":%s,"output_tokens":%s.9,"cache_read_input_tokens":%s,"cache_creation_input_tokens":3}}', odd(i), o, c), F.format_string('{"usage":{"input_tokens":%s,"output_tokens":%s,"prompt_tokens_details":{"cached_tokens":%s}}}', odd(i), o, c),
        F.format_string('{"usageMetadata":{"promptTokenCount":%s,"candidatesTokenCount":%s,"cachedContentTokenCount":%s}}', odd(i), o, c), F.format_string('{"usage":{"prompt_tokens":%s,"completion_tokens":%s,"cached":%s}}', odd(i), o, c),
    )
    broken = lambda f: F.when(n % 13 == 5, F.lit('{"usage":[1]}')).when(n % 13 == 6, F.lit("down")).otherwise(f)
    got = F.lit(None)
    for j, (shape, form) in enumerate(zip(_USE_SHAPES, forms, strict=True)):
        got = F.when(n % 4 == j, used_tokens(broken(form), shape)).otherwise(got)
    return x.select("ordinal", got.alias("u")).select("ordinal", "u.*")


_USAGE = f"""WITH {RUNS}, x AS (SELECT ordinal, ordinal % 4 AS s, ordinal % 13 IN (5, 6) AS bad, CASE WHEN ordinal % 10 IN (1, 2) THEN 0 ELSE input_tokens END AS i, output_tokens AS o, cached_tokens AS c FROM runs)
SELECT ordinal, CASE WHEN bad THEN 0 ELSE i END AS input_tokens, CASE WHEN bad THEN 0 ELSE o END AS output_tokens, CASE WHEN bad OR s = 3 THEN 0 ELSE c END AS cached_tokens, CASE WHEN bad OR s <> 0 THEN 0 ELSE 3 END AS written_tokens FROM x"""


def checkpoint_state(spark, d):
    """What the state file says of the whole log, before its end and at it, when a hundred of a thousand tasks were done for 2.5 USD."""
    x = log(spark, d)
    return config.state_document(x, 100, 2_500_000, 1000).unionByName(config.state_document(x, 0, 0, None, final=True))


_STATE = f"""WITH {LOG}, a AS (SELECT count(*) AS records_total, count(*) FILTER (error <> '') AS records_failed, count(*) FILTER (coalesce(error, '') = '') AS records_successful, round_even(coalesce(sum(cost_micro) FILTER (cost_micro > 0), 0) / 1e6 * 1e6, 0) / 1e6 AS records_total_cost_usd FROM latest)
SELECT *, 100 AS current_run_new_records, 1000 AS current_run_target_tasks, 900 AS current_run_remaining_tasks, 2.5e0 AS current_run_cost_usd, 0.025e0 AS current_run_avg_cost_usd, 25e0 AS current_run_estimated_final_cost_usd, false AS final FROM a
UNION ALL SELECT *, 0, NULL, NULL, 0e0, 0e0, NULL, true FROM a"""

_NAMES = ("model_label", "provider", "tier")


def _named(x):
    """Runs with names that differ from run to run; a board shows those of a model's first one."""
    return x.withColumn("model_label", F.concat(F.upper("model_key"), F.lit(" "), F.col("ordinal") % 3)).withColumn("provider", F.split("model_key", ":")[0]).withColumn("tier", _pick(("budget", "balanced", "sota"), F.col("ordinal")))


def representatives(spark, d):
    return L.representatives(_named(runs(spark, d)), *_NAMES)


_FIRST = "f AS (SELECT model_key, upper(model_key) || ' ' || min(ordinal) % 3 AS model_label, split_part(model_key, ':', 1) AS provider, ['budget', 'balanced', 'sota'][min(ordinal) % 3 + 1] AS tier FROM runs GROUP BY model_key)"


def _table(board, columns):
    def query(spark, d):
        x = runs(spark, d)
        return render.board_table(board(x).join(L.representatives(_named(x), *_NAMES), "model_key"), columns)

    return query


def _table_sql(board: str, columns) -> str:
    def cell(c: str, f: str) -> str:
        if f in ("", "n/a"):
            return f"coalesce(printf('{'%.2f' if not f else '%.4f'}', {c}), '{f}')"
        return f"printf('{f}', {c})"

    line = " || ' | ' || ".join(cell(c, f) for _, c, f in columns)
    rule = " | ".join("---" if f == "%s" or c == "rank" else "---:" for _, c, f in columns)
    head = " | ".join(h for h, _, _ in columns)
    return f"WITH {RUNS}, {_FIRST}, b AS ({board}) SELECT '| {head} |' || chr(10) || '| {rule} |' || chr(10) || string_agg('| ' || {line} || ' |', chr(10) ORDER BY rank) AS markdown FROM b JOIN f USING (model_key)"


def view_choices(spark, d):
    """What can be chosen below every document, and how many runs are shown for each."""
    x = _named(runs(spark, d)).withColumn("model_label", F.upper("model_key")).withColumn("run_number", (F.col("ordinal") % 5).cast("int"))
    c = views.choices(x).select("domain", "document_id", F.array_join("models", ",").alias("models"), F.array_join(F.transform("numbers", lambda v: v.cast("string")), ",").alias("numbers"))
    return c.join(x.groupBy("domain", "document_id").agg(F.count("*").alias("n")), ["domain", "document_id"])


_CHOICES = f"WITH {RUNS} SELECT domain, document_id, string_agg(DISTINCT model_key, ',' ORDER BY model_key) AS models, string_agg(DISTINCT CAST(ordinal % 5 AS VARCHAR), ',' ORDER BY CAST(ordinal % 5 AS VARCHAR)) AS numbers, count(*) AS n FROM runs GROUP BY ALL"


def view_rows(spark, d):
    """Classes and forms of every line as a page shows them."""
    k = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", views.row_class(F.when(k % 4 != 0, k % 3 != 0), F.col("l_returnflag") == "A").alias("class"), views.percent(F.when(k != 2, F.col("l_discount") * 1000)).alias("pct"), views.dollars(F.when(k != 3, F.col("l_quantity"))).alias("usd"), views.seconds(F.when(k != 4, F.col("l_quantity") * 100)).alias("s"))


_ROWS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 OR l_linenumber % 3 = 0 THEN 'gray' WHEN l_returnflag = 'A' THEN 'pass' ELSE 'fail' END AS class, CASE WHEN l_linenumber = 2 THEN '' ELSE printf('%.1f%%', l_discount * 1000) END AS pct,
  CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE printf('$%.4f', l_quantity) END AS usd, CASE WHEN l_linenumber = 4 THEN 'n/a' ELSE printf('%.1fs', l_quantity * 100 / 1000) END AS s FROM lineitem"""


def ranges_legacy(spark, d):
    """Ranges of runs of which every third was never compared, so that what was logged counts."""
    x = runs(spark, d).withColumn("compared", F.col("ordinal") % 3 != 0).withColumn("legacy_success", F.col("ordinal") % 2 == 0).withColumn("legacy_critical_pct", (F.col("ordinal") % 4 * 25).cast("double")).withColumn("legacy_field_pct", (F.col("ordinal") % 5 * 20).cast("double"))
    return L.metric_ranges_run(L.rescored(x)).filter("measure <> 'latency_ms'").select("bucket", "model_key", "measure", "count", "p05", "p50", "p95", "mean")


def _legacy_sql() -> str:
    rows = f"""WITH {RUNS}, b AS (SELECT *, unnest(['overall', lower(domain)]) AS bucket FROM runs WHERE error IS NULL), x AS (SELECT bucket, model_key, CASE WHEN CASE WHEN ordinal % 3 <> 0 THEN success ELSE ordinal % 2 = 0 END THEN 100e0 ELSE 0e0 END AS success_pct_runs,
  CASE WHEN ordinal % 3 = 0 THEN ordinal % 4 * 25e0 WHEN critical_total > 0 THEN critical_correct * 100e0 / critical_total ELSE 0e0 END AS critical_fields_pct, CASE WHEN ordinal % 3 = 0 THEN ordinal % 5 * 20e0 WHEN field_total > 0 THEN field_correct * 100e0 / field_total ELSE 0e0 END AS all_fields_pct FROM b)"""
    one = lambda m: f"SELECT bucket, model_key, '{m}' AS measure, count({m}) AS count, {', '.join(f'{r(f'quantile_disc({m}, {p / 100})', 3)} AS p{p:02d}' for p in (5, 50, 95))}, {r(f'CAST(sum(CAST({m} AS DECIMAL(26,12))) AS DOUBLE) / count({m})', 3)} AS mean FROM x GROUP BY bucket, model_key"
    return rows + " " + " UNION ALL ".join(map(one, ("success_pct_runs", "critical_fields_pct", "all_fields_pct")))


def new_manifest(spark, d):
    """A manifest of a file for every part, with the ground truth of those that a supplier has."""
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(F.concat(F.lit("D"), k % 3).alias("domain"), F.concat(F.lit("files/D"), k % 3).alias("folder"), F.concat(F.lit("Part (No. "), k, F.lit(").PDF")).alias("file"))
    matched = table(spark, d, "supplier").select(F.concat(F.lit("D"), F.col("s_suppkey") % 3).alias("domain"), F.concat(F.lit("Part (No. "), "s_suppkey", F.lit(").PDF")).alias("file"), F.concat(F.lit("p"), "s_suppkey", F.lit(".json")).alias("truth"))
    return config.manifest(files, matched)


_MANIFEST = """WITH f AS (SELECT p_partkey AS k, 'D' || p_partkey % 3 AS domain, 'Part (No. ' || p_partkey || ').PDF' AS file FROM part)
SELECT domain, file, row_number() OVER (PARTITION BY domain ORDER BY file) AS position, domain || '-part-no-' || k AS document_id, 'files/' || domain || '/' || file AS source, 'files/' || domain || '/ground_truth/' || CASE WHEN s_suppkey IS NULL THEN 'part_no_' || k || '.json' ELSE 'p' || k || '.json' END AS truth, s_suppkey IS NOT NULL AS there FROM f LEFT JOIN supplier ON s_suppkey = k"""


def latest_errors(spark, d):
    """Errors of the latest records, all of them, with the place of each one's first task."""
    return C.top_errors(log(spark, d), 1_000_000)


def replayed_runs(spark, d):
    """Every document sent to a provider, answered from recorded responses: some were never recorded, some are errors, some empty."""
    k, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    x = table(spark, d, "documents").select("doc_id", _pick(tuple(SHAPE_OF), k).alias("provider"), t.alias("t"))
    key = Q.prompt_cache_key(F.col("provider"), F.lit(_SYSTEM), F.lit(_USER), F.concat(k.cast("string"), F.lit(":"), F.col("t")))
    x = x.withColumn("key", key).withColumn("q", Q.quoted(F.concat(F.lit("n="), k.cast("string"), F.lit(" "), F.col("t"))))
    shapes = {
        "anthropic": F.format_string('{"content":[{"type":"text","text":%s}],"usage":{"input_tokens":%d,"output_tokens":2}}', "q", k), "openai": F.format_string('{"output":[{"content":[{"type":"output_text","text":%s}]}],"usage":{"input_tokens":%d,"output_tokens":2}}', "q", k),
        "google": F.format_string('{"candidates":[{"content":{"parts":[{"text":%s}]}}],"usageMetadata":{"promptTokenCount":%d,"candidatesTokenCount":2}}', "q", k), "mistral": F.format_string('{"choices":[{"message":{"content":%s}}],"usage":{"prompt_tokens":%d,"completion_tokens":2}}', "q", k),
    }
    response = F.coalesce(*(F.when(F.col("provider") == p, r_) for p, r_ in shapes.items()))
    response = F.when(k % 10 == 8, '{"error":{"message":"too busy"}}').when(k % 10 == 9, "{}").otherwise(response)
    recorded = x.filter("doc_id % 10 <> 7").select("key", response.alias("response"))
    out = replay(x.select(k.cast("string").alias("task_key"), "provider", "key"), recorded)
    return out.select("task_key", "provider", F.sha2("raw_output", 256).alias("digest"), "input_tokens", "output_tokens", "error")


_REPLAY = f"""WITH x AS (SELECT doc_id, doc_id % 10 AS k, ['anthropic', 'openai', 'google', 'mistral'][doc_id % 4 + 1] AS provider, {sql_strip("'n=' || doc_id || ' ' || coalesce(text, '')")} AS v FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS task_key, provider, sha256(CASE WHEN k < 7 THEN v ELSE '' END) AS digest, CASE WHEN k < 7 THEN doc_id ELSE 0 END AS input_tokens, CASE WHEN k < 7 THEN 2 ELSE 0 END AS output_tokens, CASE k WHEN 7 THEN 'no recorded response' WHEN 8 THEN 'too busy' WHEN 9 THEN 'empty response' END AS error FROM x"""

_VENDOR_NAMES = ("Claude-x", "gemini-3", "Ministral-8b", "pixtral-large", "o3", "gpt-5", "voxtral", "unknown")


def model_providers(spark, d):
    """The vendor of a model's name, for every document's."""
    return table(spark, d, "documents").select("doc_id", provider(_pick(_VENDOR_NAMES, F.col("doc_id"))).alias("provider"))


def carried_log(spark, d):
    """The latest records of a log of which a third was carried over from an earlier run."""
    x = log(spark, d)
    return C.latest(A.carried_over(x.filter("ordinal % 3 = 0"), x.filter("ordinal % 3 <> 0"))).select("task_key", "ordinal", "error")


def merged_runs(spark, d):
    """Metrics of the latest records with the debug members of the same tasks, where there are any."""
    x = C.latest(log(spark, d))
    return A.merged_run(x.select("task_key", "latency_ms"), x.filter("ordinal % 5 <> 0").select("task_key", "document_id"))


QUERIES = {
    "model_providers": (model_providers, "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'anthropic' WHEN doc_id % 8 = 1 THEN 'google' WHEN doc_id % 8 IN (2, 3, 6) THEN 'mistral' ELSE 'openai' END AS provider FROM documents"),
    "replayed_runs": (replayed_runs, _REPLAY),
    "carried_log": (carried_log, f"WITH {LOG} SELECT task_key, ordinal, error FROM latest"),
    "merged_runs": (merged_runs, f"WITH {LOG} SELECT task_key, latency_ms, document_id FROM latest WHERE ordinal % 5 <> 0"),
    "request_bodies": (request_bodies, _request_sql()),
    "usage_tokens": (usage_tokens, _USAGE),
    "checkpoint_state": (checkpoint_state, _STATE),
    "representatives": (representatives, f"WITH {RUNS}, {_FIRST} SELECT * FROM f"),
    "markdown_online": (_table(L.leaderboard_online, render.ONLINE), _table_sql(ONLINE, render.ONLINE)),
    "markdown_offline": (_table(L.leaderboard_offline, render.OFFLINE), _table_sql(OFFLINE, render.OFFLINE)),
    "markdown_rebuilt": (_table(L.leaderboard_rebuilt, render.REBUILT), _table_sql(REBUILT, render.REBUILT)),
    "view_choices": (view_choices, _CHOICES),
    "view_rows": (view_rows, _ROWS),
    "ranges_legacy": (ranges_legacy, _legacy_sql()),
    "new_manifest": (new_manifest, f"SELECT * EXCLUDE file FROM ({_MANIFEST})"),
    "latest_errors": (latest_errors, f"WITH {LOG} SELECT error, count(*) AS n FROM latest WHERE error <> '' GROUP BY error"),
}
