"""Differences between two artifacts, by key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import drift, within_tolerance
from ..functions.text import slug


def artifact_diff(a: DataFrame, b: DataFrame, key: str, numbers: list[str], texts: list[str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """One row per difference: key, field, kind (missing_left, missing_right, text, number), drift.

    Numbers differ when they are out of tolerance; ignored fields are left out."""
    fields = [c for c in numbers + texts if c not in ignored]
    ren = lambda df, s: df.select(F.col(key).alias(f"{s}_key"), *(F.col(c).alias(f"{s}_{c}") for c in fields))
    j = ren(a, "a").join(ren(b, "b"), F.col("a_key") == F.col("b_key"), "full_outer")
    k = F.coalesce("a_key", "b_key").alias("key")
    rows = []
    for c in fields:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        off = ~within_tolerance(x, y) if c in numbers else ~x.eqNullSafe(y)
        rows.append(F.when(off, F.struct(F.lit(c).alias("field"), F.lit("number" if c in numbers else "text").alias("kind"), (drift(x, y) if c in numbers else F.lit(None).cast("double")).alias("drift"))))
    whole = lambda kind: F.array(F.struct(F.lit("").alias("field"), F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("drift")))
    found = F.when(F.col("a_key").isNull(), whole("missing_left")).when(F.col("b_key").isNull(), whole("missing_right")).otherwise(F.array_compact(F.array(*rows)))
    return j.select(k, F.explode(found).alias("d")).select("key", "d.field", "d.kind", "d.drift")


def name_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left``: file; ``right``: truth. Each file with the truth of its exact base name, else the only one of its
    normalised name, else of several such that with the file's safe name."""
    base = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    norm = lambda c: F.regexp_replace(F.lower(base(c)), "[^a-z0-9]+", "")
    exact = right.select(F.col("truth").alias("exact"), base(F.col("truth")).alias("b")).groupBy("b").agg(F.min("exact").alias("exact"))
    loose = right.select(F.col("truth"), norm(F.col("truth")).alias("n")).groupBy("n").agg(F.min("truth").alias("loose"), F.count("*").alias("c"))
    safe = right.select(F.col("truth").alias("safe"), F.col("truth").alias("s"), norm(F.col("truth")).alias("sn")).distinct()
    j = left.withColumn("b", base(F.col("file"))).join(exact, "b", "left").withColumn("n", norm(F.col("file"))).join(loose, "n", "left")
    j = j.join(safe, (F.concat(slug(F.col("file"), "_", 120), F.lit(".json")) == F.col("s")) & (F.col("n") == F.col("sn")) & (F.col("c") > 1), "left")
    only = F.when(F.col("c") == 1, F.col("loose"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(only.isNotNull(), "normalised").when(F.col("safe").isNotNull(), "preferred").otherwise("none")
    return j.select("file", F.coalesce("exact", only, "safe").alias("truth"), how.alias("how"))


#: Members that may always differ.
VOLATILE = frozenset({
    "completed_at", "generated_at", "updated_at", "benchmark_id", "benchmark_fingerprint", "input_raw_jsonl", "output_comparison_jsonl", "source", "markdown_table",
    "system_prompt_used", "user_prompt_used", "raw_output", "parsed_payload", "latency_ms", "input_tokens", "output_tokens", "cached_input_tokens", "cache_write_tokens", "total_cost_usd",
})
#: Containers of model output, and the members that may differ in these.
CONTAINERS = frozenset({"extracted_pairs", "parsed_output", "key_comparisons"})
INSIDE = frozenset({"value", "found", "extracted_value", "matched", "notes", "missing_keys"})


def _differences(a: object, b: object, path: str, name: str | None, within: bool, names: tuple) -> Iterator[tuple[str, str, bool]]:
    volatile, containers, inside = names
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    free = lambda k: k in volatile or within and k in inside
    if free(name):
        yield path, "", True
    elif number(a) and number(b):
        off, top = abs(a - b), max(abs(a), abs(b))
        if off > 1.0 and off / top > 0.25:
            yield path, "number", False
    elif type(a) is not type(b):
        yield path, "type", False
    elif isinstance(a, dict):
        for k in a.keys() | b.keys():
            if k in a and k in b:
                yield from _differences(a[k], b[k], f"{path}.{k}", k, within or k in containers, names)
            else:
                yield f"{path}.{k}", "key_a" if k in a else "key_b", free(k)
    elif isinstance(a, list) and len(a) != len(b):
        yield path, "length", False
    elif isinstance(a, list):
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            yield from _differences(x, y, f"{path}[{i}]", None, within, names)
    elif a != b:
        yield path, "text" if isinstance(a, str) else "value", isinstance(a, str) and (" " in a + b or len(a) >= 40 or len(b) >= 40)


def _compared(a: str | None, b: str | None, names: tuple) -> Iterator[tuple[str, str, bool]]:
    trees, broken = [], []
    for side, text in (("a", a), ("b", b)):
        try:
            trees.append(json.loads(text) if text is not None else broken.append(("$", f"missing_{side}", False)))
        except ValueError:
            broken.append(("$", f"invalid_{side}", False))
    return iter(broken) if broken else _differences(*trees, "$", None, False, names)


def tree_diff(pairs: DataFrame, volatile: frozenset[str] = VOLATILE, containers: frozenset[str] = CONTAINERS, inside: frozenset[str] = INSIDE) -> DataFrame:
    """``pairs``: key, a, b (JSON). One row per difference of the trees: key, path, kind, ignored.

    Kinds: missing_a and missing_b (a null side), invalid_a and invalid_b (no JSON; the trees are then not
    compared), type, key_a and key_b (a member of one side only), length, number (out of tolerance), text
    (short ones without a space; longer texts may differ and are ignored), value. Volatile members are
    ignored, and so are those named ``inside`` under one of ``containers``. Pairs are compared in Arrow batches."""
    of = pairs.schema["key"].dataType.simpleString()
    names = (volatile, containers, inside)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = lambda v: v if isinstance(v, str) else None
            rows = [(k, *d) for k, a, b in zip(f["key"].tolist(), f["a"], f["b"], strict=True) for d in _compared(text(a), text(b), names)]
            yield pd.DataFrame(rows, columns=["key", "path", "kind", "ignored"])

    return pairs.select("key", "a", "b").mapInPandas(run, f"key {of}, path string, kind string, ignored boolean")


def diff_report(differences: DataFrame) -> DataFrame:
    """Counts of a tree diff: structural, numeric, ignored."""
    number = F.col("kind") == "number"
    return differences.agg(F.count_if(~F.col("ignored") & ~number).alias("structural"), F.count_if(~F.col("ignored") & number).alias("numeric"), F.count_if("ignored").alias("ignored"))
