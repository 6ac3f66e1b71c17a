"""Artifacts of benchmark runs: checkpoint logs, debug snapshots and canonical raw records.

Records come as JSON lines with the order in which they were written (``ordinal``: a number, or a
struct that sorts like the log); of a task the last one counts. Lines that are no objects, or lack
a member that must be there, are left out; so are records with a member of a wrong type, or they
fail the job with ``strict``, as an export of a log that must be whole wants it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontree as T
from ..functions import records as R
from ..functions.text import once

#: Who answers, how models are graded, how values are compared.
PROVIDERS, TIERS = ("anthropic", "openai", "google", "mistral"), ("budget", "balanced", "sota")
MATCH_MODES = ("exact", "normalized_text", "contains", "numeric")
_must = lambda kind, *names: [(n, kind, "must") for n in names]
#: The members of records.
MODEL = [("model_key", "text", "must"), ("provider", PROVIDERS, "must"), ("model_id", "text", "must"), ("model_label", "text", "must"), ("tier", TIERS, "must")]
DOCUMENT = [*_must("text", "domain", "document_id"), ("run_number", "int", "must")]
RUNTIME = [
    ("latency_ms", "int", "must"), ("input_tokens", "int", "must"), ("output_tokens", "int", "must"), ("total_cost_usd", "float", "must"), ("cache_hit", "bool", "must"),
    ("cached_input_tokens", "int", "must"), ("cache_write_tokens", "int", "must"), ("error", "text", "there"),
]
SCORES = [
    ("success", "bool", "must"), *_must("int", "field_total", "field_correct", "critical_total", "critical_correct"), *_must("float", "field_accuracy_pct", "critical_accuracy_pct"),
    *_must("int", "found_key_count", "requested_key_count"),
]
PAIR = [("key", "text", "must"), ("value", "text", "must"), ("found", "bool", "must")]
COMPARISON = [
    ("key", "text", "must"), ("critical", "bool", "must"), ("scored", "bool", "must"), ("expected_values", "texts", "must"), ("extracted_value", "text", "must"),
    ("matched", "bool", "must"), ("match_mode", MATCH_MODES, "must"),
]
PAYLOAD = [
    ("system_prompt_used", "text", "may"), ("user_prompt_used", "text", "may"), ("raw_output", "text", "must"), ("parsed_output", "any", "there"), ("extracted_pairs", PAIR, "may"),
    ("key_comparisons", COMPARISON, "may"),
]
METRICS = [("task_key", "text", "may"), *MODEL, *DOCUMENT, *SCORES, *RUNTIME]
DEBUG = [("task_key", "text", "may"), *MODEL, *DOCUMENT, *SCORES, *[(n, k, "may" if n in ("input_tokens", "output_tokens") else need) for n, k, need in RUNTIME], *PAYLOAD]
CANONICAL = {"model": MODEL, "document": DOCUMENT, "runtime": RUNTIME, "payload": [*_must("text", "system_prompt_used", "user_prompt_used", "raw_output"), ("parsed_output", "any", "there"), ("extracted_pairs", PAIR, "must")], "legacy_metrics": SCORES}
_names = lambda fields: [n for n, _, _ in fields]


def _last(rows: DataFrame, key: Column) -> DataFrame:
    whole = F.struct(*rows.columns)
    return rows.groupBy(key.alias("_key")).agg(F.max_by(whole, "ordinal").alias("r")).select("r.*")


def _checked(rows: DataFrame, valid: Column, strict: bool) -> DataFrame:
    if not strict:
        return rows.filter(valid)
    return rows.filter(F.when(valid, True).otherwise(F.raise_error(F.lit("a record is not valid")).cast("boolean")))


def checkpoint_records(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``lines``: ordinal, value. The last valid record of each task that has metrics and debug: ordinal, task_key, completed_at, metrics, debug."""
    rows = R.objects(lines, "value", ["task_key", "completed_at", "metrics", "debug"])
    rows = rows.filter(R.truthy_text(F.col("_o.stask_key")) & R.truthy_text(F.col("_o.smetrics")) & R.truthy_text(F.col("_o.sdebug")))
    text = lambda n: R._value(F.col(f"_o.s{n}"), "text")
    made = F.struct(text("task_key").alias("task_key"), text("completed_at").alias("completed_at"), R.record(F.col("_o.smetrics"), METRICS).alias("metrics"), R.record(F.col("_o.sdebug"), DEBUG).alias("debug"))
    rows = once(rows.select("ordinal", "_o"), "_r", made)
    valid = F.col("_r.task_key").isNotNull() & (F.col("_o.scompleted_at").isNull() | F.col("_r.completed_at").isNotNull()) & F.col("_r.metrics").isNotNull() & F.col("_r.debug").isNotNull()
    return _last(_checked(rows, valid, strict).select("ordinal", "_r.*"), F.col("task_key"))


def debug_key(run: Callable[[str], Column]) -> Column:
    """A debug run's own task key, else model::domain::document::run and its number."""
    own = run("task_key")
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.concat(run("model_key"), F.lit("::"), run("domain"), F.lit("::"), run("document_id"), F.lit("::run"), run("run_number").cast("string")))


def debug_runs(documents: DataFrame, strict: bool = True) -> DataFrame:
    """``documents``: json, and ordinal if there are several. The last run of each task in their lists
    ``runs``: ordinal, task_key and the run's members. A run that is not valid fails the job, or goes
    without ``strict``; a document without a list of runs has none."""
    order = F.col("ordinal") if "ordinal" in documents.columns else F.lit(0)
    listed = R.get_array(F.col("_node"), "runs")
    each = once(documents, "_node", T.parsed(F.col("json"))).select(order.alias("_file"), F.posexplode_outer(listed).alias("_at", "n")).filter("_at is not null")
    each = once(each.select(F.struct("_file", "_at").alias("ordinal"), "n"), "r", R.record(F.when(F.col("n.kind") == "object", F.col("n.text")), DEBUG)).drop("n")
    each = _checked(each, F.col("r").isNotNull(), strict)
    rows = each.select("ordinal", debug_key(lambda c: F.col(f"r.{c}")).alias("task_key"), *(F.col(f"r.{c}").alias(c) for c in _names(DEBUG)[1:]))
    return _last(rows, F.col("task_key"))


def canonical_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``lines``: ordinal, value. The last canonical record of each task, as its line: task_key, value. Of
    records that have all members one that is not valid fails the job, or goes without ``strict``."""
    rows = R.objects(lines, "value", ["schema_version", "task_key", "completed_at", *CANONICAL])
    for m in ("task_key", *CANONICAL):
        rows = rows.filter(R.truthy_text(F.col(f"_o.s{m}")))
    valid = (F.col("_o.sschema_version") == "s1.0") & F.col("_o.stask_key").startswith("s") & (F.col("_o.scompleted_at").isNull() | F.col("_o.scompleted_at").startswith("s"))
    for m, fields in CANONICAL.items():
        valid = valid & R.record(F.col(f"_o.s{m}"), fields).isNotNull()
    rows = once(rows, "_valid", F.coalesce(valid, F.lit(False)))
    rows = _checked(rows, F.col("_valid"), strict)
    return _last(rows.select("ordinal", F.substring("_o.stask_key", F.lit(2), F.length("_o.stask_key")).alias("task_key"), "value"), F.col("task_key")).select("task_key", "value")


def _canonical(key: Column, completed: Column, of: Callable[[str], Column], text: Callable[[str], Column], tokens: Callable[[str], Column]) -> list[Column]:
    pick = lambda names: F.struct(*(of(n).alias(n) for n in names))
    blank = lambda n: F.coalesce(text(n), F.lit("")).alias(n)
    none = F.array().cast("array<struct<key: string, value: string, found: boolean>>")
    return [
        F.lit("1.0").alias("schema_version"), key.alias("task_key"), completed.alias("completed_at"), pick(_names(MODEL)).alias("model"), pick(_names(DOCUMENT)).alias("document"),
        F.struct(*((tokens(n) if n in ("input_tokens", "output_tokens") else of(n)).alias(n) for n in _names(RUNTIME))).alias("runtime"),
        F.struct(*(blank(n) for n in ("system_prompt_used", "user_prompt_used", "raw_output")), text("parsed_output").alias("parsed_output"), F.coalesce(text("extracted_pairs"), none).alias("extracted_pairs")).alias("payload"),
        pick(_names(SCORES)).alias("legacy_metrics"),
    ]


def from_checkpoint(records: DataFrame) -> DataFrame:
    """Canonical raw records of checkpoint records; null texts are empty, null lists empty lists."""
    of = lambda n: F.col(f"metrics.{n}")
    return records.select(*_canonical(F.col("task_key"), F.col("completed_at"), of, lambda n: F.col(f"debug.{n}"), of))


def from_debug(runs: DataFrame) -> DataFrame:
    """Canonical raw records of debug runs; token counts that are null are 0."""
    return runs.select(*_canonical(F.col("task_key"), F.lit(None).cast("string"), F.col, F.col, lambda n: F.coalesce(F.col(n), F.lit(0))))


def export_summary(records: DataFrame) -> DataFrame:
    """Records by model label and by domain, all, and those with an error: kind, name, n; by kind and name."""
    one = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.alias("n"))
    each = records.select(F.explode(F.array(
        one("model", F.col("model.model_label"), F.lit(1)), one("domain", F.col("document.domain"), F.lit(1)), one("records", F.lit(""), F.lit(1)), one("errored", F.lit(""), F.col("runtime.error").isNotNull().cast("int"))
    )).alias("x"))
    return each.groupBy("x.kind", "x.name").agg(F.sum("x.n").alias("n")).orderBy("kind", "name")


def checkpoint_line(metrics: Column, debug: Column, task_key: Column, completed_at: Column) -> Column:
    """A record as one compact JSON line, null members included."""
    return F.to_json(F.struct(task_key.alias("task_key"), completed_at.alias("completed_at"), metrics.alias("metrics"), debug.alias("debug")), {"ignoreNullFields": "false"})


def merged_run(metrics: DataFrame, debug: DataFrame) -> DataFrame:
    """Debug runs: metrics with the debug members of the same task beside them."""
    return metrics.join(debug, "task_key")


def source_of(exists: Callable[[str], bool], checkpoint: str, input_jsonl: str | None = None, debug_file: str | None = None) -> tuple[str, str]:
    """(kind, path) of what is exported: canonical lines that were named, else a debug snapshot, else the
    checkpoint's canonical lines, else its log."""
    if input_jsonl:
        return "canonical", input_jsonl
    if debug_file:
        return "debug", debug_file
    raw = f"{checkpoint}/raw.jsonl"
    return ("canonical", raw) if exists(raw) else ("log", f"{checkpoint}/runs.jsonl")


def raw_file(exists: Callable[[str], bool], folder: str) -> str:
    """A folder's canonical lines, under their old name where there are none under the new one."""
    new, old = f"{folder}/raw.jsonl", f"{folder}/raw.normalized.jsonl"
    return old if not exists(new) and exists(old) else new


def relative_path(path: str, root: str) -> str:
    """A path below ``root`` without it, with forward slashes; others as they are."""
    p, r = PurePosixPath(path.replace("\\", "/")), PurePosixPath(root.replace("\\", "/"))
    return str(p.relative_to(r)) if p.is_relative_to(r) else path


def option_list(text: str | None) -> list[str] | None:
    """Parts between commas, trimmed, without empty ones; None if none is left."""
    return [p for x in (text or "").split(",") if (p := x.strip())] or None


def comparable_options(options: dict) -> dict:
    """Run options as they are compared: in a fixed order, lists sorted, without what is not set."""
    #: The options and their order.
    order = ("runs_per_model", "max_parallel_requests", "max_documents_per_domain", "provider_parallel", "domains", "models")
    known = {k: options.get(k) for k in order}
    known |= {k: sorted(known[k]) if known[k] else None for k in ("domains", "models")}
    return {k: v for k, v in known.items() if v is not None}


def fingerprint(options: dict, files: Iterable[tuple[str, str]]) -> str:
    """SHA-256 of the options and of files (name, content), each framed by its name. A log is resumed only under the same one."""
    #: Fixed value: the frame of a file.
    h = hashlib.sha256(json.dumps(comparable_options(options), separators=(",", ":"), ensure_ascii=False).encode())
    for name, content in files:
        h.update(f"\n@@{name}@@\n{content}".encode())
    return h.hexdigest()


def catalog_models(catalogs: DataFrame) -> DataFrame:
    """``catalogs``: models, a map of provider to a list of models. One row per provider and model, in order."""
    each = catalogs.select(F.explode("models").alias("provider", "m"))
    return each.select("provider", F.posexplode("m").alias("position", "model"))


def default_model(models: Column) -> Column:
    """The first of a list, or an empty text."""
    return F.coalesce(F.get(models, F.lit(0)), F.lit(""))


def carried_over(before: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an earlier run together with new ones."""
    return before.unionByName(new)


def key_sets(a: DataFrame, b: DataFrame, key: str = "task_key") -> DataFrame:
    """Keys of both sides and where they are: both, left or right; by key, in code point order."""
    sides = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s"))).groupBy(key).agg(F.bit_or("s").alias("s"))
    return sides.select(key, F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "left").otherwise("right").alias("side")).orderBy(key)
