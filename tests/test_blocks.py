"""Running sums and percentiles by blocks, with one hot key."""

import math
import random

from pyspark.sql import functions as F

from docscore.operators import leaderboard as L
from docscore.operators.blocks import nearest_ranks, running


def rows(spark):
    rng = random.Random(2)
    out = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.randrange(50), float(rng.randrange(300)) if rng.random() < 0.9 else None) for i in range(4000)]
    return out, spark.createDataFrame(out, "k string, i long, x long, v double").repartition(7)


def test_running_sums(spark):
    data, df = rows(spark)
    got = {(r.k, r.i): (r.s, r.s_total, r.n) for r in running(df, ["k"], ["i"], {"s": F.col("x"), "n": F.lit(1)}).collect()}
    sums, counts, want = {}, {}, {}
    for k, i, x, _ in data:
        sums[k], counts[k] = sums.get(k, 0) + x, counts.get(k, 0) + 1
        want[k, i] = (sums[k], counts[k])
    assert {k: (s, n) for k, (s, _, n) in got.items()} == want and all(t == sums[k] for (k, _), (_, t, _) in got.items())
    whole = running(df, [], ["i"], {"n": F.lit(1)}).orderBy("i").collect()
    assert [r.n for r in whole] == list(range(1, len(data) + 1)) and running(df.limit(0), ["k"], ["i"], {"n": F.lit(1)}).count() == 0


def test_no_block_holds_the_hot_key(spark):
    _, df = rows(spark)
    dealt = df.repartitionByRange(4, "k", "i").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in dealt) < 0.5 * df.count()  # though one key has most rows


def test_nearest_ranks(spark):
    data, df = rows(spark)
    got = {r.k: r for r in nearest_ranks(df.withColumn("w", F.col("x")), ["k"], {"v": (5, 50, 95), "w": (1, 100)}).collect()}
    for k in {d[0] for d in data}:
        for column, ps, at in (("v", (5, 50, 95), 3), ("w", (1, 100), 2)):
            values = sorted(d[at] for d in data if d[0] == k and d[at] is not None)
            for p in ps:
                assert got[k][f"{column}_p{p}"] == values[max(0, math.ceil(p / 100 * len(values)) - 1)]


def test_progress_with_one_document(spark):
    r = spark.range(300).select(F.col("id").alias("ordinal"), F.lit("d").alias("document_id"), F.when(F.col("id") % 100 == 7, "E").when(F.col("id") % 2 == 0, "").alias("error"))
    got = L.progress(r).orderBy("ordinal").collect()
    assert [x.completed for x in got] == list(range(1, 301)) and [x.document_complete for x in got] == [False] * 299 + [True] and got[-1].failed == 3
    lines = L.progress_lines(r.withColumn("model_label", F.lit("M")).withColumn("run_number", F.lit(1)), 300, spark.createDataFrame([("d", 4)], "document_id string, runs long")).orderBy("ordinal").collect()
    assert [x.completed for x in lines] == sorted({1, 4, 8, 108, 208, *range(15, 301, 15)})
    assert lines[0].line == "1/300 (0.3%) | ok:1 fail:0 | model:M run:1" and lines[1].line.endswith(" | document complete: d (4/4)") and lines[2].line.endswith("ok:7 fail:1 | model:M run:1 | last error: E")
