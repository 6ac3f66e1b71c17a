"""Settings, requests, usage and views."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docscore.functions.responses import pages_used, used_tokens
from docscore.operators import checkpoint as C
from docscore.operators import config, diff, views
from docscore.operators import requests as Q


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_request_bodies_are_json_with_the_right_members(spark):
    m, s, u, b = (F.lit(x) for x in ("gpt-5.5-x", 'a"b', "line\né", "QUJD"))
    key = hashlib.sha256('gpt-5.5-x\na"b\nline\né\nQUJD'.encode()).hexdigest()
    blocks, responses, generate, named, pages = map(json.loads, one(spark, Q.blocks_body(m, s, u, b, F.lit(9)), Q.responses_body(m, s, u, b, F.lit(9), F.lit("")), Q.generate_body(F.lit("Gemini-FLASH"), s, u, b, F.lit(9), F.lit("c")), Q.generate_body(F.lit("gemini-2.5-flash"), s, u, b, F.lit(9), F.lit("c/1")), Q.pages_body(m, s, u, b, "{}")))
    assert blocks["temperature"] == 0 and blocks["metadata"]["user_id"] == f"ocr-{key[:24]}" and blocks["system"][0]["text"] == 'a"b' and blocks["messages"][0]["content"][1]["text"] == "line\né"
    assert "temperature" not in json.loads(one(spark, Q.blocks_body(m, s, u, b, F.lit(9), temperature=False))[0])
    assert responses["prompt_cache_key"] == key and responses["reasoning"] == {"effort": "low"} and responses["input"][1]["content"][0] == {"type": "input_file", "filename": "document.pdf", "file_data": "data:application/pdf;base64,QUJD"}
    assert generate["generationConfig"] == {"maxOutputTokens": 9, "temperature": 0, "thinkingConfig": {"thinkingBudget": 0}} and "cachedContent" not in generate and named["cachedContent"] == "c/1" and "systemInstruction" not in named
    assert pages["document_annotation_prompt"] == 'a"b\n\nline\né'
    assert one(spark, *(Q.reasoning_effort(F.lit(x)) for x in ("GPT-5.4-nano", "gpt-5-mini", "o3", "gpt-4.1"))) == ("low", "minimal", "minimal", None)
    assert one(spark, *(Q.temperature_refused(F.lit(x)) for x in ("`Temperature` is DEPRECATED for this model", "temperature", None))) == (True, False, False)
    assert one(spark, Q.document_cache_key(F.lit("m"), s, b))[0] == "m:" + hashlib.sha256(b'a"b\nQUJD').hexdigest()


def test_usage(spark):
    text = json.dumps({"usage": {"input_tokens": 5.9, "output_tokens": True, "cache_read_input_tokens": 2}})
    assert tuple(one(spark, used_tokens(F.lit(text), "blocks"))[0]) == (5, 0, 2, 0)
    assert [tuple(one(spark, used_tokens(F.lit(t), "chat"))[0]) for t in ("{}", "no", '{"usage":{"prompt_tokens":"5"}}')] == [(0, 0, 0, 0)] * 3
    assert one(spark, pages_used(F.lit('{"usage_info":{"pages_processed":3}}')), pages_used(F.lit("[]"))) == (3, 0)


def test_config_models(spark):
    model = {"provider": "openai", "model_id": "m", "model_label": "M", "tier": "sota"}
    rows = lambda d: config.models(spark.createDataFrame([(json.dumps(d),)], "json string")).orderBy("position").collect()
    got = rows({"models": [model, model | {"model_id": "n"}], "max_parallel_requests": 3})
    assert [(r.position, r.model_id, r.runs_per_model, r.max_parallel_requests) for r in got] == [(0, "m", 10, 3), (1, "n", 10, 3)]
    for bad in ({}, {"models": {}}, {"models": [model | {"tier": "x"}]}, {"models": [5]}):
        with pytest.raises(Exception):  # noqa: B017
            rows(bad)


def test_state_and_layout(spark, monkeypatch, tmp_path):
    states = spark.createDataFrame([(1, '{"a": 1}'), (2, ""), (3, "[1]"), (4, "{"), (5, None)], "i int, json string")
    assert [r.state for r in config.read_state(states).collect()] == ['{"a":1}', None, None, None, None]
    monkeypatch.setenv(config.ROOT, "/x/")
    assert config.Layout.of().state == "/x/artifacts/checkpoints/state.json" and config.Layout.of("s3://b").models == "s3://b/config/models.public.json"
    (tmp_path / "p.txt").write_text("a\nb {{X}}\n")
    assert config.prompt_text(spark, str(tmp_path / "p.txt")) == "a\nb {{X}}\n"
    log = spark.createDataFrame([("t", 1, "", 5), ("u", 2, "E", -3), ("u", 3, "E", 7)], "task_key string, ordinal long, error string, cost_micro long")
    r = config.state_document(log, 2, 10, 4).first()
    assert (r.records_total, r.records_failed, r.records_successful, r.records_total_cost_usd, r.current_run_estimated_final_cost_usd, r.current_run_remaining_tasks) == (2, 1, 1, 1.2e-05, 2e-05, 2)


def test_names_and_files(spark):
    files = spark.createDataFrame([("a/b/X.PDF",), ("a/y.json",), ("c.pdf",)], "p string")
    assert [r.name for r in config.file_names(files, "p", ".pdf").collect()] == ["X.PDF", "c.pdf"]
    assert one(spark, *(config.safe_name(F.lit(x)) for x in ("__A (b).c.PDF", "é.pdf", "x" * 130 + ".pdf"))) == ("a_b_c", "", "x" * 120)
    left = spark.createDataFrame([("A b.pdf",), ("c d.pdf",), ("e.pdf",)], "file string")
    right = spark.createDataFrame([("a_b.json",), ("a-b.json",), ("c-d.json",), ("c.d.json",), ("E.json",)], "truth string")
    assert {(r.file, r.truth, r.how) for r in diff.name_match(left, right).collect()} == {("A b.pdf", "a_b.json", "preferred"), ("c d.pdf", None, "none"), ("e.pdf", "E.json", "normalised")}


def test_views(spark):
    runs = spark.createDataFrame([("d", "x", "m", "M", 2), ("d", "x", "a", "Z", 1), ("d", "x", "m", "M", 1), ("e", "x", "m", "M", 1)], "domain string, document_id string, model_key string, model_label string, run_number int")
    assert [(r.model_label, r.run_number) for r in views.runs_of(runs, "d", "x").collect()] == [("M", 1), ("M", 2), ("Z", 1)]
    assert views.runs_of(runs, "d", "x", "m", 2).count() == 1 and [r.domain for r in views.domains(runs).collect()] == ["d", "e"]
    c = views.choices(runs).filter("domain = 'd'").first()
    assert (c.models, c.numbers) == (["m", "a"], [1, 2]) and [r.document_id for r in views.documents_of(runs, "e").collect()] == ["x"]
    assert one(spark, views.row_class(F.lit(None).cast("boolean"), F.lit(True)), views.row_class(F.lit(True), F.lit(None).cast("boolean")), views.percent(F.lit(None).cast("double")), views.dollars(F.lit(0.000051)), views.seconds(F.lit(1250))) == ("gray", "fail", "", "$0.0001", "1.2s")
    board = spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 1.0, "b"), (3.0, 5.0, "c")], "success_rate_pct double, avg_critical_accuracy_pct double, m string")
    assert [r.m for r in views.shown(board).collect()] == ["c", "b", "a"]


def test_ties_of_errors_go_by_where_they_were_seen_first(spark):
    log = spark.createDataFrame([("t1", 1, "Z"), ("t2", 2, "A"), ("t3", 3, "B"), ("t3", 4, None), ("t2", 5, "Q"), ("t1", 6, "Z")], "task_key string, ordinal long, error string")
    assert [(r.error, r.n) for r in C.top_errors(log).collect()] == [("Z", 1), ("Q", 1)]


def test_replayed_answers(spark):
    from docscore.operators.runner import replay

    requests = spark.createDataFrame([("a", "openai", "k1"), ("b", "mistral", "k2"), ("c", "google", "k3"), ("d", "anthropic", "k4"), ("e", "other", "k1"), ("f", "openai", None)], "task_key string, provider string, key string")
    recorded = spark.createDataFrame([("k1", '{"output_text":"x","usage":{"input_tokens":3}}'), ("k1", '{"output_text":"w"}'), ("k2", '{"error":{"message":"down"}}'), ("k4", "broken")], "key string, response string")
    got = {r.task_key: (r.raw_output, r.input_tokens, r.error) for r in replay(requests, recorded).collect()}
    assert got == {"a": ("x", 3, None), "b": ("", 0, "down"), "c": ("", 0, "no recorded response"), "d": ("", 0, "empty response"), "e": ("", 0, "empty response"), "f": ("", 0, "no recorded response")}
