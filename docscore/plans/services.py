"""Queries over responses of services, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.responses import response_text
from .adapters import table
from .scalars import sql_strip

# Every turn of every conversation is a response with two pieces of text, the turn's and a note, among
# pieces that are none. Turns that are divisible by 5 have pieces of a wrong type, by 7 no JSON at all.

def _bad():
    return F.col("turn") % 5 == 0


def _turns(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", t.alias("a"), F.concat(F.lit(" note "), F.coalesce("role", F.lit("")), F.lit("\n")).alias("b"))


def _texts(shape: str, response):
    """conv_id, turn and a digest of the text read from ``response(a, b)``."""

    def query(spark, d):
        rows = _turns(spark, d)
        said = F.when(F.col("turn") % 7 == 3, F.concat(F.lit("error: "), F.col("a"))).otherwise(response(_quoted("a"), _quoted("b")))
        text = response_text(said, shape)
        return rows.select("conv_id", "turn", F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("n"))

    return query


def _quoted(c: str):
    q = F.to_json(F.array(F.col(c)))
    return F.substring(q, F.lit(2), F.length(q) - 2)


def _join(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _markdown(a, b):
    return _join('{"pages":[', F.when(_bad(), '{"markdown":5},7,').otherwise("null,"), '{"markdown":', a, '},{"index":1,"markdown":""},{"markdown":', b, "}]}")


def _annotation(a, b):
    return _join('{"document_annotation":', F.when(_bad(), "[1]").when(F.col("turn") % 2 == 0, _join('{"x":', a, "}")).otherwise(b), "}")


def _blocks(a, b):
    return _join('{"content":[{"type":"text","text":', a, '},{"type":"tool","text":"no"},', F.when(_bad(), '{"type":"text","text":4},"text",').otherwise(""), '{"type":"text","text":', b, "}]}")


def _output(a, b):
    return _join('{"output_text":', F.when(F.col("turn") % 3 == 0, _quoted("a")).when(_bad(), "12").otherwise('"  "'), ',"output":[{"type":"reasoning"},5,{"content":[{"type":"output_text","text":', a, '},{"type":"refusal","text":"no"},{"type":"output_text"}]},{"content":[{"type":"output_text","text":', b, "}]}]}")


def _candidates(a, b):
    return _join('{"candidates":[', F.when(_bad(), '"none",').otherwise(""), '{"content":{"parts":[{"text":', a, '},{"inline":1},{"text":""},{"text":', b, '}]}},{"content":{"parts":[{"text":"second"}]}}]}')


def _chat(a, b):
    parts = _join('[{"type":"text","text":', a, '},{"type":"image"},3,{"text":', b, "}]")
    return _join('{"choices":[{"message":{"role":"x","content":', F.when(_bad(), "null").when(F.col("turn") % 2 == 0, a).otherwise(parts), "}}]}")


def _sql(text: str) -> str:
    b = "' note ' || coalesce(role, '') || chr(10)"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS a, {b} AS b FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN '' ELSE {text} END AS v FROM t) SELECT conv_id, turn, sha256(v) AS digest, length(v) AS n FROM x"""


_BOTH = sql_strip("CASE WHEN a = '' THEN b ELSE a || chr(10) || b END")

QUERIES = {
    "response_annotation": (_texts("annotation", _annotation), _sql("""CASE WHEN turn % 5 = 0 THEN '' WHEN turn % 2 = 0 THEN '{"x":' || CAST(to_json(a) AS VARCHAR) || '}' ELSE b END""")),
    "response_markdown": (_texts("markdown", _markdown), _sql("CASE WHEN a = '' THEN b ELSE a || chr(10) || chr(10) || b END")),
    "response_blocks": (_texts("blocks", _blocks), _sql(sql_strip("a || chr(10) || b"))),
    "response_output": (_texts("output", _output), _sql(f"CASE WHEN turn % 3 = 0 AND {sql_strip('a')} <> '' THEN {sql_strip('a')} ELSE {_BOTH} END")),
    "response_candidates": (_texts("candidates", _candidates), _sql(f"CASE WHEN turn % 5 = 0 THEN '' ELSE {_BOTH} END")),
    "response_chat": (_texts("chat", _chat), _sql(f"CASE WHEN turn % 5 = 0 THEN '' WHEN turn % 2 = 0 THEN {sql_strip('a')} ELSE {_BOTH} END")),
}
