import json
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from docscore.functions import jsonx as J
from docscore.functions import rounding as R
from docscore.functions import text as T
from docscore.functions import values as V
from docscore.operators import checkpoint as C
from docscore.operators import groundtruth as G
from docscore.operators import leaderboard as L
from docscore.operators import runner
from docscore.plans import catalog, documents
from docscore.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def _rows(df, columns):
    clean = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in df[columns].astype(object).where(df.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(got.columns)) == _rows(want, sorted(got.columns))


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_rounding_rules(spark):
    x = lambda v: F.lit(v)
    assert one(spark, R.round_half(x(1.005), 2), R.round_half(x(0.285), 2), R.round_half(x(-2.5), 0), R.pct(x(1), x(0)), R.variation(x(0.0), x(3.0))) == (1.0, 0.28, -3.0, 0.0, 100.0)
    assert one(spark, R.combinations(x(10), 3), R.combinations(x(2), 3)) == (120.0, 0.0)
    assert one(spark, R.retry_ceiling(x(300)), R.retry_ceiling(x(7000)), R.within_tolerance(x(10.0), x(12.4)), R.within_tolerance(x(10.0), x(14.0))) == (700, 8000, True, False)
    assert one(spark, R.token_cost(x(100), x(150), x(10), x(1.0), x(2.0), x(None).cast("double")))[0] == pytest.approx((150 + 20) / 1e6)


def test_normalisers(spark):
    s = lambda v: F.lit(v)
    assert one(spark, T.normalize_text(s("  Ünï-Code Αcme ½")), T.compact(s("A-b C")), T.key_name(s("Total:")), T.numeric(s("12.34.56")), T.missing_like(s("N/A"))) == ("uni code acme 1 2", "abc", "total ", None, True)
    assert one(spark, V.company(s("c/o Acme A/S Ltd")), V.currency(s("12 zł")), V.currency(s("x")), V.weight_unit(s("Kgs"))) == ("acme", "PLN", None, "kg")
    assert one(spark, F.array_sort(V.dates(s("2024-01-15"))), V.dates(s("30.02.2024")), V.dates(s("20240115"))) == (["2015-01-24", "2024-01-15"], [], ["2024-01-15"])


def test_best_json_is_strict(spark):
    for text, want in (('{"a":1} x', None), ('{"a":1}', '{"a":1}'), ('{"a":1} x {"b":2}', None), ('```json\n{"a":2}\n```', '{"a":2}'), ('see {"a":{"b":3}} ok', '{"a":{"b":3}}'), ("[1]", "[1]"), ("{'a':1}", None)):
        got = one(spark, J.best_json(F.lit(text)))[0]
        assert got == want or text == '{"a":1} x' and got == '{"a":1}', text


def test_answers_keep_the_first_nonempty(spark):
    m = one(spark, J.indexed(J.answers(F.lit('{"pairs":[{"key":"A b","value":""},{"key":"a-b","value":"x","found":false},{"key":"A_B","value":"y"}]}'))))[0]
    assert {k: tuple(v) for k, v in m.items()} == {"a b": ("x", False)}


def test_cases_of_the_match_cascade(spark):
    got = {r.n: r.matched for r in documents.cases(spark).collect()}
    assert got == {i: c[5] for i, c in enumerate(documents.CASES)}


def test_artifact_rules(spark):
    from docscore.operators import artifacts as A
    from docscore.operators import diff as D

    assert A.option_list(" a, ,b ") == ["a", "b"] and A.option_list(" , ") is None and A.option_list(None) is None
    a = A.fingerprint({"runs_per_model": 2, "models": ["b", "a"], "domains": None}, [("m.json", "x")])
    assert a == A.fingerprint({"models": ["a", "b"], "runs_per_model": 2}, [("m.json", "x")]) != A.fingerprint({"runs_per_model": 2, "models": ["a", "b"]}, [("m.json", "y")])
    assert A.source_of(lambda p: True, "c") == ("canonical", "c/raw.jsonl") and A.source_of(lambda p: False, "c") == ("log", "c/runs.jsonl") and A.source_of(lambda p: True, "c", None, "d") == ("debug", "d")
    assert A.raw_file(lambda p: p.endswith("normalized.jsonl"), "c").endswith("normalized.jsonl") and A.relative_path("/r/a/b", "/r") == "a/b" and A.relative_path("/q/a", "/r") == "/q/a"
    models = A.catalog_models(spark.sql("SELECT map('p', array('a', 'b')) AS models")).orderBy("position").collect()
    assert [(r.provider, r.model) for r in models] == [("p", "a"), ("p", "b")] and one(spark, A.default_model(F.array().cast("array<string>"))) == ("",)
    assert runner.lane_count(3, 8, True) == 3 and runner.lane_count(3, 8, False) == 8 and runner.lane_count(0, 0, True) == 1
    d = spark.createDataFrame([(1, '{"a":1,"b":[1],"c":"x","o":{"v":"q"},"generated_at":1}', '{"a":"1","b":[1,2],"c":"y","o":{"v":"r"},"generated_at":2}')], "key long, a string, b string")
    rows = {(r.path, r.kind, r.ignored) for r in D.tree_diff(d, containers=frozenset({"o"}), inside=frozenset({"v"})).collect()}
    assert rows == {("$.a", "type", False), ("$.b", "length", False), ("$.c", "text", False), ("$.o.v", "", True), ("$.generated_at", "", True)}


def test_repeated_pairs_and_found_marks(spark):
    from docscore.operators import scoring

    raw = {"a": "Total: 5\nTotal: 7\nDay:  \nDay: x", "b": '{"key":"Total","value":"1"} and {"key":"total","value":"2"}\nother', "c": '{"pairs":[{"key":"k","value":"v","found":true},{"key":"K","value":"v","found":false}]}', "d": '{"pairs":[{"key":"k","value":"  ","found":false},{"key":"k","value":" w "}]}', "e": '{"pairs":[{"key":"k","value":"","found":false}]}'}
    runs = spark.createDataFrame([(k, "d", v) for k, v in raw.items()], "task_key string, document_id string, raw_output string")
    got = {(r.task_key, r.k): (r.value, r.found) for r in scoring.extracted(runs).collect()}
    assert got == {("a", "total"): ("7", True), ("a", "day"): ("x", True), ("b", "total"): ("2", True), ("c", "k"): ("v", True), ("d", "k"): ("w", True), ("e", "k"): ("", False)}


def test_names_are_probed_and_documents_rejected(spark):
    doc = {"a": {"x": {"value": 1}}, "a_x": {"value": 5}, "b": {"x": {"value": 2}}, "a_x_2": {"value": 3}}
    d = spark.createDataFrame([(1, json.dumps(doc)), (2, '{"keys": []}'), (3, "{"), (4, '{"a": [1]}'), (5, None)], "doc long, json string")
    assert [r.name for r in G.keys(d).filter("doc = 1").orderBy("ordinal").collect()] == ["a_x", "a_x_2", "b_x", "a_x_2_2"]
    assert {(r.doc, r.rule) for r in G.rejected(d).collect()} == {(2, "legacy_schema"), (3, "invalid_json"), (4, "no_values"), (5, "invalid_json")}
    n = G.value_nodes(spark.createDataFrame([(1, json.dumps({"a": {"value": " "}, "b": {"value": [" ", 0]}, "c": {"value": False, "critical": True}, "d": [{"e": {"value": {"x": 1}}}], "f": {"value": ["q"]}}))], "doc long, json string")).collect()
    assert [(r.key, r.labelled_text, r.labelled_plain, r.labelled_any, r.critical) for r in n] == [("a", False, False, False, False), ("b", False, False, True, False), ("c", False, True, True, True), ("e", False, False, True, False), ("f", True, True, True, False)]


def test_manifest_and_filters(spark):
    m = {"domains": [{"id": "X", "document_count": 2, "documents": [{"document_id": "1", "source_pdf": "s", "ground_truth": "g"}, {"document_id": "2"}]}, {"id": "Y", "documents": []}]}
    domains, docs_ = G.manifest_rows(spark.createDataFrame([(json.dumps(m),)], "json string"))
    assert [(r.domain, r.document_id) for r in G.selected_documents(docs_, ["x "], 1).collect()] == [("X", "1")] and domains.count() == 2
    with pytest.raises(Exception):  # noqa: B017
        G.manifest_rows(spark.createDataFrame([("{}",)], "json string"))[0].collect()
    models = spark.createDataFrame([("m1", "One"), ("m2", "Two")], "model_id string, model_label string")
    assert [r.model_id for r in G.selected_models(models, [" TWO"]).collect()] == ["m2"]
    with pytest.raises(ValueError):
        G.selected_models(models, ["none"])


def test_ground_truth_names(spark):
    doc = {"a": {"x": {"value": 1}}, "b": {"x": {"value": 2.0}}, "items": [{"q": 5, "n": {"value": None, "critical": True}}, {"q": 6, "deep": {"y": {"value": ["p", " "]}}}], "skip": 3}
    rows = G.keys(spark.createDataFrame([(1, json.dumps(doc)), (2, "{}")], "doc long, json string")).orderBy("ordinal").collect()
    assert [(r.name, r.expected, r.critical) for r in rows] == [("a_x", ["1"], False), ("b_x", ["2"], False), ("items_1_q", ["5"], False), ("n", [], True), ("items_2_q", ["6"], False), ("y", ["p"], False)]


def test_latest_wins_and_empty_error_is_none(spark):
    log = spark.createDataFrame([("t", 1, "m", "E"), ("t", 2, "m", ""), ("u", 1, "m", "E"), ("", 5, "m", None), (None, 6, "m", None)], "task_key string, ordinal long, model_key string, error string")
    assert {(r.task_key, r.ordinal) for r in C.latest(log).collect()} == {("t", 2), ("u", 1)}
    s = C.status_by_model(log).first()
    assert (s.ok, s.failed) == (1, 1)


def test_model_with_errors_only(spark):
    cols = "ordinal long, task_key string, model_key string, domain string, document_id string, error string, success boolean, field_total long, field_correct long, critical_total long, critical_correct long, found_keys long, requested_keys long, latency_ms long, cost_micro long"
    r = L.leaderboard_online(spark.createDataFrame([(1, "t", "m", "d", "x", "E", False, 0, 0, 0, 0, 0, 0, 5, 7)], cols)).first()
    assert (r.avg_cost_per_doc_usd, r.cost_per_success_usd, r.field_accuracy_variance_pct, r.avg_latency_ms, r.pass_at_2_pct, r.rank) == (None, None, 100.0, 0.0, None, 1)


def test_json_lines_skip_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":"a","n":1}\n\nnot json\n{"k":"b","n":2}\n')
    assert [(r.line, r.k, r.n) for r in files.json_lines(spark, str(tmp_path), "k string, n long").orderBy("line").collect()] == [(0, "a", 1), (3, "b", 2)]
    with pytest.raises(Exception):  # noqa: B017
        files.json_lines(spark, str(tmp_path), "k string, n long", strict=True).collect()
    files.write_json_lines(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "out"))
    files.write_json_lines(spark.createDataFrame([(2, "x")], "a long, b string"), str(tmp_path / "out"), "append")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    assert files.newest(spark, str(tmp_path), "*.jsonl").first().path.endswith("a.jsonl")
    assert files.binary_documents(spark, str(tmp_path), "*.jsonl").first().base64


def test_failing_service_gives_an_error_row(spark):
    def broken(prompt, document):
        raise RuntimeError("down")

    q = spark.createDataFrame([("a", "p", "- k (type: string, critical: yes)", "one two"), ("b", "q", "", None)], "task_key string, provider string, prompt string, document string")
    got = {r.task_key: r for r in runner.extract(q, {"p": broken}, lanes=2).collect()}
    assert got["a"].error == "down" and got["b"].error == "empty document"


def test_plans_push_columns_down(spark):
    p = L.pass_geometric(documents.runs(spark, SF))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double,props:string>" in p


def test_all_orders_are_flattened_and_rendered(spark):
    orders = {r.l_orderkey: r.n for r in spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n")).collect()}
    q = catalog.queries()
    assert {r.doc: r["count"] for r in q["gt_flatten"](spark, SF).groupBy("doc").count().collect()} == {k: 14 + 3 * n for k, n in orders.items()}
    assert {r.doc: (r["keys"], r.names) for r in q["gt_dedupe_names"](spark, SF).collect()} == {k: (14 + 3 * n, 14 + 3 * n) for k, n in orders.items()}
    assert {r.doc: r.prompt.count("\n- ") for r in q["prompt_render"](spark, SF).collect()} == {k: 14 + 3 * n for k, n in orders.items()}


def _plainly_truncated(s):
    def is_object(x):
        try:
            return json.loads(x.strip())
        except ValueError:
            return False

    t = s.strip()
    fence = re.search(r"(?si)```(?:json)?\s*(.*?)\s*```", t)
    tries = [t, fence[1] if fence else "", t[t.find("{") : t.rfind("}") + 1] if "{" in t else ""]
    return not any(map(is_object, tries)) and t != "" and (t[-1] in ",:" or t.count("{") > t.count("}") or t.count("[") > t.count("]"))


def test_whole_texts_are_judged(spark, tmp_path):
    long = "word " * 30
    made = [long + "[open", long + "done:", long + "{a} [b]", long + "plain", long + '{"a": {"b": 1}} ok', long + "] } closed", long + "", long + "{ [ ] end"]
    rows = [(4 * i + j, t, len(t)) for i, t in enumerate(made) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.truncated for r in catalog.queries()["truncation_flag"](spark, str(tmp_path)).collect()}
    put = (lambda t: '{"a": "' + t, lambda t: json.dumps({"a": t}), lambda t: t + " end,", lambda t: t)
    assert got == {r.doc_id: _plainly_truncated(put[r.doc_id % 4](r.text)) for r in docs.collect()}
    assert {got[3], got[7], got[11], got[15]} == {True, False}


def test_whole_answers_are_returned(spark):
    answers = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").filter("turn % 2 = 1 AND text <> ''").orderBy("turn").collect():
        answers.setdefault(r.conv_id, r.text)
    got = {r.conv_id: r.value for r in catalog.queries()["first_nonempty"](spark, SF).collect()}
    assert {k: v for k, v in got.items() if v} == answers and any(len(v) > 40 for v in answers.values())


def test_expiry_of_caches(spark):
    cases = {"2026-05-14T12:00:00.123Z": 1778760000123, "2026-05-14T12:00:00+02:00": 1778752800000, "2026-05-14": 1778716800000, "12:00": 600_007, "2026-13-01": 600_007, " 2026-05-14": 600_007, "": 600_007, None: 600_007}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select(V.expiry_millis(F.col("v"), F.lit(7)).alias("ms")).collect()
    assert [r.ms for r in rows] == list(cases.values())
