"""Snapshots that appear whole or not at all, and progress that survives a restart."""

import json

import pytest
from pyspark.sql import functions as F

from docscore.operators import report as Q
from docscore.sources.snapshots import Snapshots
from docscore.streaming import leaderboard as S
from docscore.streaming import progress as P


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_parts_appear_together(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/s")
    assert store.latest() is None and store.names() == []
    with pytest.raises(FileNotFoundError):
        store.read("a")
    store.write("one", {"a": lines(spark, "1", "2"), "b": lines(spark, "{}")})
    assert store.latest() == "one" and sorted(r.value for r in store.read("a").collect()) == ["1", "2"]
    broken = lines(spark, "x").select(F.raise_error(F.lit("broken part")).cast("string").alias("value"))
    with pytest.raises(Exception, match="broken part"):
        store.write("two", {"a": lines(spark, "3"), "b": broken})
    assert store.latest() == "one" and store.names() == ["one"] and not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("_staging")]
    with pytest.raises(FileExistsError):
        store.write("one", {"a": lines(spark, "4")})
    store.write("two", {"a": lines(spark, "5")})
    assert store.latest() == "two" and store.read("a", "one").count() == 2
    store.point_to("one")
    assert Snapshots(spark, f"{tmp_path}/s").latest() == "one"
    with pytest.raises(FileNotFoundError):
        store.point_to("three")
    with pytest.raises(ValueError):
        store.write("_x", {})


def test_documents_are_json(spark):
    rows = spark.createDataFrame([(2, 'b"', None), (1, "é", 1.5)], "rank int, name string, v double")
    d = Q.document(spark, n=None, rows=Q.listed(rows, "rank"), by=Q.by_bucket(rows.withColumn("k", F.lit('q"')), "k", "rank"), empty=Q.listed(rows.limit(0), "rank"), text='x"')
    got = json.loads(d.first().value)
    assert got == {"n": None, "rows": [{"rank": 1, "name": "é", "v": 1.5}, {"rank": 2, "name": 'b"', "v": None}], "by": [{"domain": 'q"', "rows": got["rows"]}], "empty": [], "text": 'x"'}
    data = spark.createDataFrame([("a", 12, 5, 5), ("b", 3, 5, 4)], "domain string, documents long, keys long, labelled long")
    w = json.loads(Q.warnings(data, spark.createDataFrame([(None,), (1.0,)], "pass_at_10_pct double")).first().j)
    assert w[0] == "Only 9/10 keys are labeled." and w[1].startswith('Domain "b" has 3') and len(w) == 3
    assert json.loads(Q.warnings(data.limit(1), spark.createDataFrame([(1.0,)], "pass_at_10_pct double")).first().j) == []


def log(spark, lo, hi):
    r = spark.range(lo, hi, numPartitions=2).select(F.col("id").alias("ordinal"), F.concat(F.lit("d"), F.col("id") % 3).alias("document_id"), F.lit("M").alias("model_label"), F.col("id").cast("int").alias("run_number"))
    return r.withColumn("error", F.when(F.col("ordinal") % 17 == 5, "E").when(F.col("ordinal") % 4 == 0, ""))


def test_progress_neither_repeats_nor_loses_an_event(spark, tmp_path):
    from docscore.operators.leaderboard import progress_lines

    expected = spark.createDataFrame([("d0", 20), ("d1", 33), ("d2", 99)], "document_id string, runs long")
    want = sorted(map(tuple, progress_lines(log(spark, 0, 100), 100, expected).collect()))
    folder, kind = f"{tmp_path}/p", "ordinal long, document_id string, model_label string, run_number int, error string"

    def go(fail=False):
        q = P.follow(S.read_log(spark, f"{folder}/log", kind, glob="*.parquet"), 100, expected, folder, f"{folder}/checkpoint")
        q.awaitTermination()

    log(spark, 0, 40).write.mode("append").parquet(f"{folder}/log")
    go()
    log(spark, 40, 70).write.mode("append").parquet(f"{folder}/log")
    go()
    # a failure after the writes of a batch and before the stream's commit: the batch runs again
    commits = sorted((tmp_path / "p/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    crc = commits[-1].with_name(f".{commits[-1].name}.crc")
    if crc.exists():
        crc.unlink()
    go()
    log(spark, 70, 100).write.mode("append").parquet(f"{folder}/log")
    go()
    go()
    assert sorted(map(tuple, P.events(spark, folder).collect())) == want
    assert len(list((tmp_path / "p/counters").glob("batch=*"))) == 2


def test_the_newest_board_stays(spark, tmp_path):
    log(spark, 0, 10).write.parquet(f"{tmp_path}/log")
    runs = lambda: S.read_log(spark, f"{tmp_path}/log", "ordinal long, document_id string, model_label string, run_number int, error string", glob="*.parquet").groupBy("document_id").count()
    for n in (10, 20, 30):
        P.keep_newest(runs(), f"{tmp_path}/board", f"{tmp_path}/check").awaitTermination()
        assert sum(r["count"] for r in P.newest(spark, f"{tmp_path}/board").collect()) == n
        log(spark, n, n + 10).write.mode("append").parquet(f"{tmp_path}/log")
    assert len(list((tmp_path / "board").glob("batch=*"))) == 2
