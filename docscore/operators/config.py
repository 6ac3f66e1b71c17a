"""Settings, folders, state and manifests of a benchmark."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontree as T
from ..functions import records as R
from ..functions.rounding import round6
from ..functions.text import slug
from .artifacts import MODEL
from .checkpoint import latest

ROOT = "DOCSCORE_ROOT"


@dataclass(frozen=True)
class Layout:
    """Where files lie below a root, which the environment may name (DOCSCORE_ROOT)."""

    root: str

    @classmethod
    def of(cls, root: str | None = None) -> Layout:
        return cls((root or os.environ.get(ROOT) or ".").rstrip("/") or "/")

    def _at(self, path: str) -> str:
        return f"{self.root}/{path}" if self.root != "/" else f"/{path}"

    models = property(lambda self: self._at("config/models.public.json"))
    manifest = property(lambda self: self._at("dataset/manifest.json"))
    system_prompt = property(lambda self: self._at("prompts/system.txt"))
    user_prompt = property(lambda self: self._at("prompts/user.txt"))
    artifacts = property(lambda self: self._at("artifacts"))
    checkpoint = property(lambda self: self._at("artifacts/checkpoints"))
    postprocess = property(lambda self: self._at("artifacts/postprocess"))
    runs = property(lambda self: f"{self.checkpoint}/runs.jsonl")
    raw_runs = property(lambda self: f"{self.checkpoint}/raw.runs.jsonl")
    raw = property(lambda self: f"{self.checkpoint}/raw.jsonl")
    state = property(lambda self: f"{self.checkpoint}/state.json")
    comparison = property(lambda self: f"{self.postprocess}/comparison.jsonl")


def prompt_text(spark, path: str) -> str:
    """A prompt template, as it is."""
    return spark.read.text(path, wholetext=True).first()[0]


def models(configs: DataFrame) -> DataFrame:
    """``configs``: json. The models of a benchmark in order: position, provider, model_id, model_label, tier, and
    the defaults beside each: runs_per_model (10) and max_parallel_requests (1). A model whose members are
    missing or wrong fails the job, as does a config without a list of models."""
    fields = [f for f in MODEL if f[0] != "model_key"]
    c = configs.select(T.parsed(F.col("json")).alias("c"))
    listed = F.coalesce(R.get_array(F.col("c"), "models"), F.raise_error(F.lit("the config has no list of models")).cast(f"array<{T.NODE}>"))
    number = lambda name, default: F.coalesce(R.get_number(F.col("c"), name).cast("int"), F.lit(default)).alias(name)
    each = c.select(number("default_runs_per_model", 10), number("max_parallel_requests", 1), F.posexplode(listed).alias("position", "n"))
    m = R.record(F.when(F.col("n.kind") == "object", F.col("n.text")), fields)
    each = each.withColumn("m", F.coalesce(m, F.raise_error(F.lit("a model of the config is not valid")).cast(_kind(fields))))
    return each.select("position", "m.*", F.col("default_runs_per_model").alias("runs_per_model"), "max_parallel_requests")


def _kind(fields: list) -> str:
    return "struct<" + ",".join(f"{n}:string" for n, _, _ in fields) + ">"


def read_state(states: DataFrame) -> DataFrame:
    """``states``: json. One row each: state, the object's compact JSON; null for what is empty, no JSON or no object."""
    node = T.parsed(F.col("json"))
    return states.select(T.let(node, lambda n: F.when(n["kind"] == "object", T.compact(n))).alias("state"))


def state_document(log: DataFrame, new: int, new_cost_micro: int, target: int | None, final: bool = False) -> DataFrame:
    """What a checkpoint's state file says: one row with the counts and costs of the latest records (costs of 0
    or less do not count), and of this run: done, target, remaining, cost, mean cost and what the target
    will cost."""
    bad = F.col("error") != ""
    cost = F.coalesce(F.sum(F.when(F.col("cost_micro") > 0, F.col("cost_micro"))), F.lit(0)) / 1e6
    all_ = latest(log).agg(F.count("*").alias("records_total"), F.count_if(bad).alias("records_failed"), F.count_if(~F.coalesce(bad, F.lit(False))).alias("records_successful"), round6(cost).alias("records_total_cost_usd"))
    mean = new_cost_micro / 1e6 / new if new else 0.0
    left = None if target is None else max(0, target - new)
    whole = mean * target if target and new else None
    one = lambda v, kind: F.lit(v).cast(kind)
    return all_.select(
        "*", one(new, "long").alias("current_run_new_records"), one(target, "long").alias("current_run_target_tasks"), one(left, "long").alias("current_run_remaining_tasks"),
        round6(one(new_cost_micro / 1e6, "double")).alias("current_run_cost_usd"), round6(one(mean, "double")).alias("current_run_avg_cost_usd"), round6(one(whole, "double")).alias("current_run_estimated_final_cost_usd"), F.lit(final).alias("final"),
    )


def file_names(files: DataFrame, path: str, extension: str) -> DataFrame:
    """Names of the files right below a folder with an extension in any case, by name: name."""
    p = F.col(path)
    return files.filter(F.lower(p).endswith(extension.lower())).select(F.regexp_extract(p, "([^/]*)$", 1).alias("name")).orderBy("name")


def safe_name(name: Column) -> Column:
    """A file's base name in lower case and safe letters, 120 at most."""
    return slug(name, "_", 120)


def manifest(files: DataFrame, matched: DataFrame) -> DataFrame:
    """``files``: domain, folder, file (documents); ``matched``: domain, file, truth. Documents of a new manifest,
    in order: domain, position, document_id, source, truth, and whether the truth is there (else its name
    is the one that it should have)."""
    from pyspark.sql import Window

    j = files.join(matched.select("domain", "file", F.col("truth").alias("_t")), ["domain", "file"], "left")
    truth = F.concat(F.col("folder"), F.lit("/ground_truth/"), F.coalesce("_t", F.concat(safe_name(F.col("file")), F.lit(".json"))))
    at = F.row_number().over(Window.partitionBy("domain").orderBy("file"))
    return j.select("domain", at.cast("long").alias("position"), F.concat_ws("-", "domain", slug(F.col("file"))).alias("document_id"), F.concat_ws("/", "folder", "file").alias("source"), truth.alias("truth"), F.col("_t").isNotNull().alias("there"))
