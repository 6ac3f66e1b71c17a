"""Text output: prompts and markdown tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.rounding import fixed
from . import groundtruth as G

SLOT = "{{REQUESTED_KEYS}}"


def _line() -> Column:
    return F.concat(F.lit("- "), F.coalesce("name", F.lit("null")), F.lit(" (type: "), F.coalesce("data_type", F.lit("string")), F.lit(", critical: "), F.when(F.col("critical"), "yes").otherwise("no"), F.lit(")"))


def _filled(template: str, lines: Column) -> Column:
    body = F.array_join(lines, "\n")
    return F.replace(F.lit(template), F.lit(SLOT), body) if SLOT in template else F.concat(F.lit(template + "\n\n"), body)


def prompts(keys: DataFrame, template: str) -> DataFrame:
    """A prompt per document with its bullet list of keys, at the slot or at the end."""
    lines = F.sort_array(F.collect_list(F.struct("ordinal", _line().alias("line"))))
    return keys.groupBy("doc").agg(_filled(template, lines["line"]).alias("prompt"))


def _line_of(name: str, node: object, held: bool) -> str:
    kind = G.kind_of(node, held)
    return f"- {name} (type: {'string' if kind is None else kind}, critical: {'yes' if held and node.get('critical') else 'no'})"


@F.arrow_udf(ArrayType(StringType()))
def _line_lists(texts: pa.Array) -> pa.Array:
    return G.text_lists(texts, _line_of)


def read_prompts(docs: DataFrame, template: str) -> DataFrame:
    """``docs``: doc, json. prompts() of keys(), the lines of a text made at once (see groundtruth.read_keys)."""
    rows = G.rest(docs.select("doc", "json", _line_lists("json").alias("_r")), "_r")
    part = lambda first, lines: F.struct(first.alias("first"), lines.alias("lines"))
    read = F.when(F.size("_r") > 0, part(F.lit(1).cast("long"), F.col("_r")))
    rows = rows.select("doc", F.when(F.col("ordinal").isNull(), read).otherwise(part(F.col("ordinal"), F.array(_line()))).alias("part"))
    p = F.collect_list("part").alias("p")
    whole = rows.filter("part is not null").groupBy("doc").agg(p)
    each = F.flatten(F.transform("p", lambda x: F.transform(x["lines"], lambda t, i: F.struct((x["first"] + i).alias("ordinal"), t.alias("line")))))
    return whole.select("doc", _filled(template, F.when(F.size("p") == 1, F.get("p", F.lit(0))["lines"]).otherwise(F.sort_array(each)["line"])).alias("prompt"))


def markdown(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row: the table as markdown. The rows are a leaderboard, a handful per model."""
    cell = lambda c: F.coalesce(fixed(F.col(c), 2) if dict(rows.dtypes)[c] == "double" else F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("markdown"))


#: Columns of the three tables of a board (heading, column, form): online, offline and rebuilt.
_HEAD = [("Rank", "rank", "%d"), ("Model", "model_label", "%s"), ("Provider", "provider", "%s"), ("Tier", "tier", "%s"), ("Success %", "success_rate_pct", "%.2f")]
_COSTS = [("Cost / Doc (USD)", "avg_cost_per_doc_usd", "n/a"), ("Cost / Success (USD)", "cost_per_success_usd", "n/a"), ("Avg Latency (ms)", "avg_latency_ms", "%.1f")]
_AT_LEAST = [(f"pass^{n} (>={n}) %", f"pass_at_{n}_pct", "") for n in (2, 3, 5, 10)] + [(f"pass^{n} strict %", f"pass_at_{n}_strict_pct", "") for n in (2, 3, 5, 10)]
ONLINE = [*_HEAD, *[(f"pass^{n} %", f"pass_at_{n}_pct", "") for n in (2, 3, 5, 10)], ("Avg Field %", "avg_field_accuracy_pct", "%.2f"), ("Critical Field %", "avg_critical_accuracy_pct", "%.2f"), ("Variance %", "field_accuracy_variance_pct", "%.2f"), *_COSTS]
OFFLINE = [
    *_HEAD, *_AT_LEAST, ("Total Field Pass %", "avg_field_accuracy_pct", "%.2f"), ("Critical Field %", "avg_critical_accuracy_pct", "%.2f"), ("Keys Found %", "avg_keys_found_pct", "%.2f"),
    ("Field Variance (CV) %", "field_accuracy_variance_pct", "%.2f"), *_COSTS,
]
REBUILT = [
    *_HEAD, *_AT_LEAST, ("Keys Found %", "avg_keys_found_pct", "%.2f"), ("Avg Field %", "avg_field_accuracy_pct", "%.2f"), ("Critical Field %", "avg_critical_accuracy_pct", "%.2f"),
    ("Variance %", "field_accuracy_variance_pct", "%.2f"), *_COSTS,
]


def board_table(rows: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """One row: a board as markdown by rank. A form of "" shows a missing percentage as nothing, "n/a" a missing cost so."""

    def cell(column: str, form: str) -> Column:
        if form in ("", "n/a"):
            return F.coalesce(fixed(F.col(column), 4 if form else 2), F.lit(form))
        return fixed(F.col(column), int(form[2])) if form.endswith("f") else F.col(column).cast("string")

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c, f) for _, c, f in columns)), F.lit(" |"))
    rule = ["---" if f == "%s" or c == "rank" else "---:" for _, c, f in columns]
    head = "| " + " | ".join(h for h, _, _ in columns) + " |\n| " + " | ".join(rule) + " |"
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("markdown"))
