"""Running sums and nearest-rank percentiles that no single task has to make alone.

Rows are dealt by ranges of their keys and order, so one key that holds most of them is spread
over many blocks. Each block is summed, the sums of the blocks before are added up (one row a
block), and running sums are made inside of each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` up to the row, in order within its keys, and over all of them
    (name and name_total). Equal order among rows of a key is broken at will. The dealt rows are kept once."""
    dealt = keep(rows.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "_block").agg(*(F.sum(v).alias(f"_{n}") for n, v in sums.items()))
    all_, up_to = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    before = parts.select(
        *named, F.col("_block").alias("_b"), *(F.coalesce(F.sum(f"_{n}").over(up_to), F.lit(0)).alias(f"_{n}_before") for n in sums), *(F.sum(f"_{n}").over(all_).alias(f"{n}_total") for n in sums)
    )
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *(F.sum(v).over(inside).alias(f"_{n}") for n, v in sums.items()))
    out = local.join(before, same)
    return out.select(*rows.columns, *((F.col(f"_{n}") + F.col(f"_{n}_before")).alias(n) for n in sums), *(f"{n}_total" for n in sums))


def nearest_ranks(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[int, ...]]) -> DataFrame:
    """Nearest-rank percentiles (the value of rank ceil(p / 100 * n), 1 at least) of measures, nulls left out: a
    row per keys that have any value, with columns measure_p. Equal values are counted before they are dealt."""
    each = rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("_measure"), F.col(m).cast("double").alias("_value")) for m in wanted)))).filter("_value is not null")
    counts = each.groupBy(*keys, "_measure", "_value").agg(F.count("*").alias("_n"))
    r = running(counts, [*keys, "_measure"], ["_value"], {"_upto": F.col("_n")})

    def pick(m: str, p: int) -> Column:
        need = F.greatest(F.ceil(F.lit(p / 100) * F.col("_upto_total")), F.lit(1))
        here = (F.col("_measure") == m) & (F.col("_upto") >= need) & (F.col("_upto") - F.col("_n") < need)
        return F.max(F.when(here, F.col("_value"))).alias(f"{m}_p{p}")

    return r.groupBy(*keys).agg(*(pick(m, p) for m, ps in wanted.items() for p in ps))


def with_ranks(totals: DataFrame, rows: DataFrame, keys: list[str], wanted: dict[str, tuple[int, ...]]) -> DataFrame:
    """``totals`` (one row per keys) with nearest_ranks of ``rows``; null where a key has no value."""
    ranks = nearest_ranks(rows, keys, wanted)
    named = ranks.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)), *(c for c in ranks.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return totals.join(named, same, "left").drop(*(f"_r{i}" for i in range(len(keys))))
