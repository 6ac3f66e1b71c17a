"""Readers of responses: real shapes, and shapes that drifted."""

import json

import pytest
from pyspark.sql import functions as F

from docscore.functions.responses import response_text

CASES = {
    "annotation": [({"document_annotation": '{"a": 1, "b": [2]}'}, '{"a":1,"b":[2]}'), ({"document_annotation": "no json"}, "no json"), ({"document_annotation": {"z": 1, "a": "é"}}, '{"z":1,"a":"é"}'), ({"document_annotation": '```json\n"t"\n```'}, '"t"'), ({"document_annotation": None}, ""), ({}, ""), ([], "")],
    "markdown": [({"pages": [{"markdown": "a"}, {"markdown": ""}, {"markdown": 3}, None, {"markdown": "b\n"}]}, "a\n\nb\n"), ({"pages": {"markdown": "a"}}, ""), ({}, "")],
    "blocks": [({"content": [{"type": "text", "text": " a"}, {"type": "tool_use", "text": "x"}, {"type": "text", "text": ""}, {"type": "text"}, "text", {"type": "text", "text": "b "}]}, "a\n\nb"), ({"content": "a"}, "")],
    "output": [({"output_text": " a ", "output": [{"content": [{"type": "output_text", "text": "b"}]}]}, "a"), ({"output_text": " ", "output": [{"content": [{"type": "output_text", "text": "b"}, {"type": "x", "text": "c"}]}, {"content": None}, {"content": [{"type": "output_text", "text": "d"}]}]}, "b\nd"), ({"output": {}}, "")],
    "candidates": [({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": ""}, {"text": 4}, 5, {"text": "b"}]}}, {"content": {"parts": [{"text": "c"}]}}]}, "a\nb"), ({"candidates": ["x", {"content": {"parts": [{"text": "c"}]}}]}, ""), ({"candidates": []}, "")],
    "chat": [({"choices": [{"message": {"content": " a "}}]}, "a"), ({"choices": [{"message": {"content": [{"text": "a"}, {"text": None}, "q", {"text": "b"}]}}]}, "a\nb"), ({"choices": [{"message": None}]}, ""), ({"choices": [{"message": {"content": 4}}]}, "")],
}


@pytest.mark.parametrize("shape", CASES)
def test_texts_of_responses(spark, shape):
    cases = [(json.dumps(r, ensure_ascii=False), t) for r, t in CASES[shape]] + [("no json", ""), (None, ""), ("", "")]
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, r string")
    got = rows.select("i", response_text(F.col("r"), shape).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [t for _, t in cases]
