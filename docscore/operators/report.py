"""Documents of a snapshot: boards, data set, options and warnings as JSON, one row each.

A board has a row per model and domain, so its JSON is small whatever the number of runs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Part = Column | DataFrame


def listed(rows: DataFrame, order: str) -> DataFrame:
    """One row: j, the rows as a JSON list, null members included."""
    one = rows.select(F.col(order).alias("o"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("o", "j"))), lambda x: x["j"])
    return one.agg(F.concat(F.lit("["), F.array_join(sorted_, ","), F.lit("]")).alias("j"))


def by_bucket(rows: DataFrame, bucket: str, order: str) -> DataFrame:
    """One row: j, a JSON list of {domain, rows}, by domain; without the bucket of all domains."""
    each = rows.filter(F.col(bucket) != "overall").select(F.col(bucket).alias("b"), F.col(order).alias("o"), F.to_json(F.struct(*(c for c in rows.columns if c != bucket)), {"ignoreNullFields": "false"}).alias("j"))
    board = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "j"))), lambda x: x["j"]), ",")
    domains = each.groupBy("b").agg(F.concat(F.lit('{"domain":'), quoted(F.col("b")), F.lit(',"rows":['), board, F.lit("]}")).alias("j"))
    return domains.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "j"))), lambda x: x["j"]), ","), F.lit("]")).alias("j"))


def quoted(text: Column) -> Column:
    """A text as JSON."""
    q = F.to_json(F.array(text))
    return F.substring(q, F.lit(2), F.length(q) - 2)


def document(spark, **members) -> DataFrame:
    """One row: value, a JSON object of members in their order: one-row tables (their first column is JSON),
    or what Python has."""
    parts: list[Column] = []
    for name, v in members.items():
        text = v.select(F.col(v.columns[0])).scalar() if isinstance(v, DataFrame) else F.lit(json.dumps(v, ensure_ascii=False))
        parts += [F.lit(("," if parts else "{") + json.dumps(name) + ":"), text]
    return spark.range(1).select(F.concat(*parts, F.lit("}")).alias("value"))


def warnings(dataset: DataFrame, board: DataFrame) -> DataFrame:
    """``dataset``: domain, documents, keys, labelled; ``board``: pass_at_10_pct. One row: j, a JSON list of what
    keeps a board from being published."""
    totals = dataset.agg(F.sum("labelled").alias("l"), F.sum("keys").alias("k"))
    some = totals.filter("l < k").select(F.lit(0).alias("o"), F.format_string("Only %d/%d keys are labeled.", "l", "k").alias("t"))
    few = dataset.filter("documents < 10").select(F.lit(1).alias("o"), F.format_string('Domain "%s" has %d documents; 10 are wanted.', "domain", "documents").alias("t"))
    none = board.agg(F.count_if(F.col("pass_at_10_pct").isNull()).alias("n")).filter("n > 0").select(F.lit(2).alias("o"), F.lit("pass@10 is empty for one or more models: a document has fewer than 10 runs.").alias("t"))
    each = some.unionByName(few).unionByName(none).select("o", "t", quoted(F.col("t")).alias("j"))
    return each.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t", "j"))), lambda x: x["j"]), ","), F.lit("]")).alias("j"))
