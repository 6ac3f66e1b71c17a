"""Readers of logs and of selected files."""

import json
import random

import pytest

from docscore.operators import checkpoint as C
from docscore.operators import groundtruth as G
from docscore.sources import files


def test_lines_of_many_splits_keep_their_numbers(spark, tmp_path):
    rng = random.Random(1)
    texts = {}
    for name in ("a.jsonl", "b c.jsonl", "empty.jsonl"):
        rows = [json.dumps({"k": f"t{rng.randrange(50)}", "n": i, "pad": "x" * rng.randrange(200)}) if i % 9 else rng.choice(["", "  ", "broken {", "[1]"]) for i in range(3000)] if name != "empty.jsonl" else []
        texts[name] = rows
        (tmp_path / name).write_text("\n".join(rows) + ("\r\n" if name[0] == "a" else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        numbered = files.lines(spark, str(tmp_path), numbered=True)
        assert numbered.rdd.getNumPartitions() > 4
        got = {}
        for r in numbered.collect():
            got.setdefault(r.file.rsplit("/", 1)[1].replace("%20", " "), []).append((r.line, tuple(r.position), r.value))
        for name, rows in texts.items():
            found = sorted(got.get(name, []))
            assert [(n, v) for n, _, v in found] == list(enumerate(rows))
            assert [p for _, p, _ in found] == sorted(p for _, p, _ in found)
        read = files.json_lines(spark, str(tmp_path), "k string, n long")
        last = C.latest(read.select("k", "n", "file", "line").withColumnRenamed("k", "task_key").withColumn("ordinal", files.F.struct("file", "line")))
        want = {}
        for name in sorted(texts, key=lambda x: x.replace(" ", "%20")):
            for row in texts[name]:
                if row.startswith("{"):
                    want[json.loads(row)["k"]] = json.loads(row)["n"]
        assert {r.task_key: r.n for r in last.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_only_selected_files_are_opened(spark, tmp_path):
    for n in ("one", "two two", "three"):
        (tmp_path / "gt").mkdir(exist_ok=True)
        (tmp_path / "gt" / f"{n}.json").write_text(json.dumps({n: {"value": 1}}))
    (tmp_path / "gt" / "three.json").chmod(0)
    docs = spark.createDataFrame([("A", "1", "gt/one.json"), ("a", "2", "gt/two two.json"), ("B", "3", "gt/three.json")], "domain string, document_id string, truth string")
    runs = spark.createDataFrame([("a", "1"), ("A", "2"), ("A", "1"), ("c", "3")], "domain string, document_id string")
    some = G.prepared(spark, G.ran(docs, runs), str(tmp_path))
    assert sorted((r.document_id, r.json) for r in some.collect()) == [("1", '{"one": {"value": 1}}'), ("2", '{"two two": {"value": 1}}')]
    assert not any("three" in f for f in some.inputFiles())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        G.prepared(spark, docs.replace("gt/one.json", "gt/none.json"), str(tmp_path)).collect()
    assert files.selected_files(spark, str(tmp_path), docs.limit(0), "truth").count() == 0
