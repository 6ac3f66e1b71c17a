"""Typed members, checked records and what reads them, against plain rules."""

import json

import pytest
from pyspark.sql import functions as F

from docscore.functions import jsontree as T
from docscore.functions import records as R
from docscore.operators import artifacts as A


def run(**more):
    base = {"model_key": "m", "provider": "openai", "model_id": "i", "model_label": "l", "tier": "sota", "domain": "d", "document_id": "x", "run_number": 1, "success": True, "field_total": 1, "field_correct": 1, "critical_total": 0, "critical_correct": 0}
    base |= {"field_accuracy_pct": 100, "critical_accuracy_pct": 0.5, "found_key_count": 1, "requested_key_count": 1, "latency_ms": 5, "input_tokens": 1, "output_tokens": 2, "total_cost_usd": 0.1, "cache_hit": False, "cached_input_tokens": 0, "cache_write_tokens": 0, "error": None}
    return base | more


def without(d, *names):
    return {k: v for k, v in d.items() if k not in names}


def debug(**more):
    return run(raw_output="o", parsed_output=None) | more


def line(key="t", metrics=None, dbg=None, **more):
    return json.dumps({"task_key": key, "metrics": run() if metrics is None else metrics, "debug": debug() if dbg is None else dbg} | more)


def kept(spark, *lines, **options):
    return {r.task_key: r for r in A.checkpoint_records(spark.createDataFrame(list(enumerate(lines)), "ordinal long, value string"), **options).collect()}


def test_getters(spark):
    node = lambda t: T.parsed(F.lit(t))
    text = '{"s":"x","n":4.5,"b":true,"r":{"i":1},"a":[1,"q"],"z":null,"big":1e400,"d":"1","d":2}'
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(*(R.get_string(node(text), k) for k in ("s", "n", "z", "no", "d"))) == ("x", None, None, None, None)
    assert one(*(R.get_number(node(text), k) for k in ("n", "b", "s", "big", "d"))) == (4.5, None, None, None, 2.0)
    assert one(*(R.get_record(node(text), k)["kind"] for k in ("r", "a", "s"))) == ("object", None, None)
    assert one(*(F.size(R.get_array(node(text), k)) for k in ("a",)), R.get_array(node(text), "r").isNull()) == (2, True)
    assert one(*(R.has_property(node(text), k) for k in ("z", "no")), R.has_property(node("[1]"), "a"), R.get_string(node("5"), "a"), R.get_string(node("{"), "a")) == (True, False, False, None, None)


def test_truth(spark):
    texts = {"s": False, "sx": True, "s0": True, "sfalse": True, "true": True, "false": False, "0": False, "0.0": False, "-1": True, "{}": False, "[]": False, "[0]": True, None: False}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(R.truthy_text(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == list(texts.values())


def test_valid_records_are_kept_and_others_go(spark):
    good = {
        "plain": line("plain"), "0": line("0"), "false": line("false"), "numbers": line("numbers", run(latency_ms="12", run_number=3.0, field_total=True, total_cost_usd="1e-3", cache_hit="yes", success=0, domain="")),
        "more": line("more", run(extra=[1]), debug(extra={"a": 1}), completed_at=None, other=1), "pairs": line("pairs", None, debug(extracted_pairs=[{"key": "k", "value": "v", "found": 1}], parsed_output={"a": [1, "s"]})),
        "compared": line("compared", None, debug(key_comparisons=[{"key": "k", "critical": True, "scored": True, "expected_values": ["a"], "extracted_value": "", "matched": False, "match_mode": "exact"}], input_tokens=None)),
    }
    bad = [
        line("a", run(latency_ms="bad")), line("b", run(latency_ms=1.5)), line("c", run(domain=5)), line("d", run(tier="best")), line("e", run(provider=None)), line("f", without(run(), "error")), line("g", run(error=3)),
        line("h", run(input_tokens=None)), line("i", run(cache_hit="maybe")), line("j", run(success=2)), line("k", None, without(debug(), "parsed_output")), line("l", None, debug(raw_output=None)),
        line("m", None, debug(extracted_pairs=[{"key": "k", "value": "v"}])), line("n", None, debug(extracted_pairs={"key": "k"})), line("o", completed_at=5), line(5), line("p", {}), line("q", [1], {"a": 1}), line("r") + " x", line("s")[:-1],
        "[1]", "", "nothing", "null", line(""), line("t", run(total_cost_usd="x")), line("u", None, debug(key_comparisons=[{"key": "k"}])), line("v", None, debug(extracted_pairs=["k"])),
    ]
    got = kept(spark, *good.values(), *bad)
    assert set(got) == set(good)
    n = got["numbers"].metrics
    assert (n.latency_ms, n.run_number, n.field_total, n.total_cost_usd, n.cache_hit, n.success, n.error) == (12, 3, 1, 0.001, True, False, None)
    assert [tuple(p) for p in got["pairs"].debug.extracted_pairs] == [("k", "v", True)] and got["pairs"].debug.parsed_output == '{"a":[1,"s"]}' and got["compared"].debug.key_comparisons[0].expected_values == ["a"]
    for b in bad[:4]:
        with pytest.raises(Exception, match="not valid"):
            kept(spark, line(), b, strict=True)
    assert set(kept(spark, line(), "broken", line("x", {}), strict=True)) == {"t"}  # what is no record at all never fails


def test_the_last_valid_record_counts(spark):
    got = kept(spark, line("t", run(domain="a")), line("t", run(domain="b")), line("t", run(domain="c", latency_ms="bad")), line("t", {}))
    assert got["t"].metrics.domain == "b"
    c = {r.task_key: r for r in A.from_checkpoint(A.checkpoint_records(spark.createDataFrame([(1, line())], "ordinal long, value string"))).collect()}
    assert c["t"].payload.system_prompt_used == "" and c["t"].payload.extracted_pairs == [] and c["t"].completed_at is None


def test_debug_runs_and_canonical_lines(spark):
    docs = spark.createDataFrame([(2, json.dumps({"runs": [debug(domain="late")]})), (1, json.dumps({"runs": [debug(domain="late", run_number=1, success=False), debug(task_key="own")]})), (3, "{}"), (4, "broken"), (5, '{"runs":5}')], "ordinal long, json string")
    got = {r.task_key: r for r in A.debug_runs(docs).collect()}
    assert set(got) == {"m::late::x::run1", "own"} and got["m::late::x::run1"].success is True
    with pytest.raises(Exception, match="not valid"):
        A.debug_runs(spark.createDataFrame([('{"runs":[5]}',)], "json string")).collect()
    c = A.from_checkpoint(A.checkpoint_records(spark.createDataFrame([(1, line("0")), (2, line("b"))], "ordinal long, value string")))
    c = c.withColumn("payload", F.col("payload").withField("parsed_output", F.lit(None).cast("string")))
    lines = c.select(F.lit(1).alias("ordinal"), F.to_json(F.struct(*c.columns), {"ignoreNullFields": "false"}).alias("value"))
    assert {r.task_key for r in A.canonical_lines(lines).collect()} == {"0", "b"}
    wrong = lines.withColumn("value", F.replace("value", F.lit('"1.0"'), F.lit('"2.0"')))
    assert A.canonical_lines(wrong, strict=False).count() == 0
    with pytest.raises(Exception, match="not valid"):
        A.canonical_lines(wrong).collect()


def test_a_line_is_read_once_whatever_is_asked_of_it(spark):
    lines = spark.createDataFrame([(1, line())], "ordinal long, value string")
    records = A.checkpoint_records(lines)
    canonical = A.canonical_lines(lines, strict=False)
    for df in (records, canonical, A.export_summary(A.from_checkpoint(records))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(T._END) == 2, plan  # the mark and the test for it, in one expression


def test_integers_of_all_lengths(spark):
    texts = {"7": 7, "-12": -12, "999999999999999999": 999999999999999999, "9223372036854775807": 2**63 - 1, "2.0": 2, "1e3": 1000, "1.5": None, "s12": 12, "s 3.0 ": 3, "true": 1, "false": 0, "{}": None, None: None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(R._value(F.col("t"), "int").alias("v")).collect()
    assert [r.v for r in got] == list(texts.values())
