"""JSON trees, ground truth, tree diffs and extraction against plain Python over random documents."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docscore.functions import jsontree as T
from docscore.functions import jsonx as J
from docscore.operators import diff as D
from docscore.operators import groundtruth as G
from docscore.operators import render
from docscore.operators import scoring

MODES = {"exact", "normalized_text", "contains", "numeric"}


def flat(v):
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def expected(v):
    if isinstance(v, list):
        return [t for t in (("" if x is None else flat(x) if isinstance(x, (dict, list)) else str(x)).strip() for x in v) if t]
    if v is None or isinstance(v, str):
        return [v.strip()] if v and v.strip() else []
    if isinstance(v, (bool, dict)):
        return [flat(v)]
    return [str(int(v)) if float(v).is_integer() else str(v)]


def mode(t):
    return "numeric" if isinstance(t, str) and t.strip().lower() in ("float", "integer", "number") else "normalized_text"


def leaf(v):
    if isinstance(v, dict) and "value" in v:
        text = lambda n: v.get(n) if isinstance(v.get(n), str) else None
        said = (text("match") or "").strip().lower()
        return bool(v.get("critical")), expected(v["value"]), text("type"), said if said in MODES else mode(text("type")), text("notes")
    kind = {bool: "boolean", int: "integer", float: "float", str: "string"}.get(type(v))
    if kind == "string" and re.fullmatch(r"\d{4}-\d{2}-\d{2}", v.strip()):
        kind = "date"
    return False, expected(v), kind, mode(kind), None


def leaves(node, path, item):
    """(name, path, leaf) in document order; bare values count in lists and in the items of lists."""
    for k, v in node.items():
        here = [*path, k]
        if isinstance(v, dict) and "value" in v:
            yield k, here, leaf(v)
        elif isinstance(v, dict):
            yield from leaves(v, here, False)
        elif isinstance(v, list):
            for i, e in enumerate(v, 1):
                at = [*here, str(i)]
                if isinstance(e, dict) and not item and "value" not in e:
                    yield from leaves(e, at, True)
                else:
                    yield k, at, (False, expected(e), None, "normalized_text", None) if item and isinstance(e, dict) else leaf(e)
        elif item:
            yield k, here, leaf(v)


def keys(text):
    try:
        root = json.loads(text)
    except (ValueError, TypeError):
        return []
    if not isinstance(root, dict) or isinstance(root.get("keys"), list):
        return []
    found = list(leaves(root, [], False))
    names = [k for k, _, _ in found]
    seen, out = set(), []
    for k, path, rest in found:
        wanted = name = "_".join(path) if names.count(k) > 1 else k
        n = 2
        while name in seen:
            name, n = f"{wanted}_{n}", n + 1
        seen.add(name)
        if name.strip():
            out.append((len(out) + 1, name, *rest))
    return out


def value(r, depth=0):
    """A random tree with value objects, odd types, white space and names that clash."""
    c = r.random()
    if depth > 4 or c < 0.35:
        return r.choice([None, True, False, 0, 1, -3, 2.0, 1.5, 1e16, "", "x", " 2024-01-02 ", "\n x\t", "{y", "[", "true", "5", "sé ü", 'a"b\\c', 0.0001, 1e-7, 12345678.9])
    if c < 0.5:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    if c < 0.72:
        more = {"critical": value(r, 5), "type": r.choice([" Float ", "integer", "x", 5, None]), "match": r.choice(["Exact", " contains", "zz", 3]), "notes": r.choice(["n", 4])}
        return {"value": value(r, depth + 1)} | {k: v for k, v in more.items() if r.random() < 0.6}
    names = ["a", "b", "c", "a_b", "a_2", "x", "x_2", " ", "keys", "value", "é", "a.b", "$", "s", "sx"]
    return {r.choice(names): value(r, depth + 1) for _ in range(r.randint(0, 4))}


def same(rows):
    """Rows with containers among expected texts as values, as digits of floats in them are written in their own way."""
    one = lambda e: repr(json.loads(e)) if re.match(r"[\[{].*[\]}]$", e, re.S) else e
    return sorted([(*x[:3], list(map(one, x[3])), *x[4:]) for x in rows], key=lambda x: x[0])


def test_keys_equal_plain_python(spark):
    r = random.Random(7)
    docs = [(i, json.dumps({r.choice("abcdefgh") + r.choice(["", "", "_1", "_2"]): value(r) for _ in range(r.randint(0, 5))}, ensure_ascii=r.random() < 0.5)) for i in range(600)]
    docs += [(5000, None), (5001, ""), (5002, "{"), (5003, "[1]"), (5004, "null"), (5005, '{"a":{"value":1},"a":{"value":2}}'), (5006, '{"a":{"value":1}} x'), (5007, '{"a":NaN}')]
    got = {}
    for x in G.keys(spark.createDataFrame(docs, "doc long, json string").repartition(4)).collect():
        got.setdefault(x.doc, []).append((x.ordinal, x.name, x.critical, x.expected, x.data_type, x.match, x.notes))
    for i, t in docs[:-1]:
        assert same(got.get(i, [])) == same(keys(t)), t
    assert not {5006, 5007} & got.keys()


def test_deep_documents_are_walked_in_several_plans(spark):
    deep = '{"a":' * 20 + '{"value":1}' + "}" * 20
    k = G.keys(spark.createDataFrame([(1, deep)], "doc long, json string"))
    assert [(r.name, r.expected) for r in k.collect()] == [("a", ["1"])]


#: What Python's reader reads and Spark's does not, and what only expressions read or nothing does.
DEEP = '{"a":{"value":%s1%s}}' % ("[" * 1100, "]" * 1100)
ODD = [
    (5000, None), (5001, ""), (5002, "{"), (5003, "[1]"), (5004, '{"a":NaN}'), (5005, '{"a":{"value":1},"a":{"value":2}}'), (5006, '{"a":{"value":1}} x'), (5007, DEEP), (5008, '{"a":{"value":1e23}}'),
    (5009, '{"a":{"value":"\\ud83d\\ude00"}}'), (5010, '{"keys":[],"a":{"value":1}}'), (5011, '{"a":{"value":"\\u001f1"},"a ":{"value":"\x85"}," ":{"value":1}}'), (5012, '{"a":' * 100_000), (5013, '{"a":{"value":[%s]}}' % ("1" * 1500)),
]


def test_read_keys_equal_plain_python(spark):
    r = random.Random(12)
    docs = [(i, json.dumps({r.choice("abcdefgh") + r.choice(["", "", "_1", "_2"]): value(r) for _ in range(r.randint(0, 5))}, ensure_ascii=r.random() < 0.5)) for i in range(600)]
    docs += [d for d in ODD if d[0] not in (5004, 5012)]
    got = {}
    for x in G.read_keys(spark.createDataFrame(docs + ODD, "doc long, json string").distinct()).collect():
        got.setdefault(x.doc, []).append((x.ordinal, x.name, x.critical, x.expected, x.data_type, x.match, x.notes))
    for i, t in docs:
        assert same(got.get(i, [])) == same(keys(t)), t
    assert not {5004, 5012} & got.keys()


def names(text):
    return [k[1] for k in keys(text)]


def prompt(*texts):
    """The prompt of documents that share an id."""
    lines = sorted((n, f"- {name} (type: {'string' if kind is None else kind}, critical: {'yes' if critical else 'no'})") for t in texts for n, name, critical, _, kind, _, _ in keys(t))
    return "A\n" + "\n".join(x for _, x in lines) + "\nB"


def test_key_names_equal_plain_python(spark):
    r = random.Random(13)
    docs = [(i, json.dumps({r.choice("ab") + r.choice(["", "_1", "_2"]): value(r) for _ in range(4)})) for i in range(300)] + [d for d in ODD if d[0] not in (5004, 5012)]
    got = {x.doc: x.names for x in G.key_names(spark.createDataFrame(docs, "doc long, json string")).collect()}
    assert got == {i: names(t) for i, t in docs}


def test_read_prompts_equal_plain_python(spark):
    r = random.Random(14)
    docs = [(i % 200, json.dumps({r.choice("abcdefgh"): value(r) for _ in range(3)})) for i in range(300)] + [d for d in ODD if d[0] not in (5004, 5012)]
    by = {}
    for i, t in docs:
        by.setdefault(i, []).append(t)
    got = {x.doc: x.prompt for x in render.read_prompts(spark.createDataFrame(docs, "doc long, json string"), "A\n{{REQUESTED_KEYS}}\nB").collect()}
    assert got == {i: prompt(*ts) for i, ts in by.items() if any(map(keys, ts))}


#: Half of a pair, and bytes that are no UTF-8: refused by the reader, and keys to the expressions.
HALF = [b'{"a":{"value":"\\ud800","critical":1},"l":[{"b":1,"a":2},{"b":3}]}', b'{"a":{"value":"\xff","type":"x"},"b":{"a":{"value":1}}}', b'{"a":{"value":"x"},"l":[{"b":1,"a":2},{"b":3}]}', b"\xff", b"{}"]


def halves(spark, ids=range(len(HALF))):
    return spark.createDataFrame(list(zip(ids, map(bytearray, HALF), strict=True)), "doc long, b binary").selectExpr("doc", "CAST(b AS STRING) AS json")


def test_what_the_reader_refuses_keeps_its_keys(spark):
    want = sorted(map(str, G.keys(halves(spark)).collect()))
    assert sorted(map(str, G.read_keys(halves(spark)).collect())) == want and len(want) == 4 + 2 + 4
    assert {r.doc: r.names for r in G.key_names(halves(spark)).collect()} == {0: ["a", "l_1_b", "l_1_a", "l_2_b"], 1: ["a", "b_a"], 2: ["a", "l_1_b", "l_1_a", "l_2_b"], 3: [], 4: []}


def test_prompts_of_refused_and_of_repeated_ids(spark):
    for ids in (range(5), (1, 1, 1, 2, 2), (None, 1, 1, 1, None)):
        read = render.read_prompts(halves(spark, ids), "{{REQUESTED_KEYS}}").collect()
        plain = render.prompts(G.keys(halves(spark, ids)), "{{REQUESTED_KEYS}}").collect()
        assert sorted(map(str, read)) == sorted(map(str, plain))


def test_queries_read_ground_truth_in_arrow_batches(spark):
    from docscore.plans import documents as Q

    for query in (Q.gt_flatten, Q.gt_dedupe_names, Q.prompt_render):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        assert plan.executedPlan().toString().count("ArrowEvalPython") == 1 and plan.optimizedPlan().toString().count(T._END) == 2, query


def test_walks_need_no_python_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, '{"a":{"value":1}}')], "doc long, json string")
    for df in (G.keys(docs), G.value_nodes(docs), G.rejected(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "MapInPandas" not in plan


def raw_nodes(node, lists):
    for k, v in node.items() if isinstance(node, dict) else ():
        if isinstance(v, dict) and "value" in v:
            yield k, bool(v.get("critical")), v["value"]
        elif isinstance(v, dict):
            yield from raw_nodes(v, lists)
        elif lists and isinstance(v, list):
            for e in v:
                yield from raw_nodes(e, lists)


@pytest.mark.parametrize("lists", [True, False])
def test_value_nodes_equal_plain_python(spark, lists):
    r = random.Random(8)
    docs = [(i, json.dumps({"p": value(r), "q": [value(r)], "r": {"s": value(r)}})) for i in range(400)]

    def labels(v):
        text = bool(v.strip()) if isinstance(v, str) else isinstance(v, list) and any(str(x or "").strip() for x in v)
        plain = text or isinstance(v, (bool, int, float))
        return text, plain, plain or isinstance(v, (list, dict)) and bool(v)

    want = sorted((i, k, c, *labels(v)) for i, t in docs for k, c, v in raw_nodes(json.loads(t), lists))
    assert sorted(map(tuple, G.value_nodes(spark.createDataFrame(docs, "doc long, json string"), lists).collect())) == want


def test_label_summary_counts_what_cannot_be_read(spark):
    docs = [(1, "A", '{"a":{"value":" "},"b":{"value":[],"critical":true},"c":{"value":0,"critical":1}}'), (2, "A", "{"), (3, "A", None), (4, "A", '{"keys":[],"a":{"value":1}}'), (5, "B", '{"l":[{"a":{"value":1}}]}'), (6, "B", "[]")]
    got = {r.domain: tuple(r)[1:] for r in G.label_summary(spark.createDataFrame(docs, "doc long, domain string, json string")).collect()}
    assert got == {"A": (4, 3, 1, 2, 1, 3), "B": (2, 0, 0, 0, 0, 2)}


def test_label_summary_equals_plain_python(spark):
    r = random.Random(9)
    texts = [json.dumps({"p": value(r), "q": {"r": value(r)}, r.choice(["s", "keys"]): value(r)}) for _ in range(400)]
    texts += [None, "", "{", "null", "[1]", "{} x", '{"a":NaN}', "\ufeff{}", '{"a":{"value":1},"a":{"value":""}}', '{"value":{"value":-0,"critical":-0.0}}', ' {"a":{"value":{},"critical":1e-400}} ']

    def totals(text):
        try:
            root = json.loads(text, parse_constant=lambda c: int(c))
        except (ValueError, TypeError):
            root = None
        old = isinstance(root, dict) and isinstance(root.get("keys"), list)
        found = [(v.strip() != "" if isinstance(v, str) else isinstance(v, (bool, int, float)) or bool(v), c) for _, c, v in ([] if old else raw_nodes(root, False))]
        return [len(found), sum(has for has, _ in found), sum(c for _, c in found), sum(has and c for has, c in found), not found]

    want = [len(texts), *map(sum, zip(*map(totals, texts), strict=True))]
    got = G.label_summary(spark.createDataFrame([("A", t) for t in texts], "domain string, json string").repartition(3)).collect()
    assert [tuple(x) for x in got] == [("A", *want)]


def test_label_summary_reads_what_plain_python_reads(spark):
    """Numbers of any length, more than a thousand levels, all white space; and ordinary texts are not walked level by level."""
    texts = ['{"a":{"value":%s,"critical":1}}' % ("1" * 5000), '{"a":{"value":%s1%s}}' % ("[" * 1100, "]" * 1100), '{"a":{"value":" \\u001f "}}', '{"a":' * 200_000]
    docs = spark.createDataFrame([("A", t) for t in texts], "domain string, json string")
    assert [tuple(x) for x in G.label_summary(docs).collect()] == [("A", 4, 3, 2, 1, 1, 1)]
    assert "ArrowEvalPython" in G.label_summary(docs)._jdf.queryExecution().executedPlan().toString()


def test_texts_refused_by_the_reader_are_walked(spark, monkeypatch):
    import pyarrow as pa

    docs = spark.createDataFrame([("A", '{"a":{"value":1,"critical":true},"b":{"c":{"value":" "}}}'), ("A", "{"), ("B", '{"keys":[],"a":{"value":1}}'), ("B", '{"a":{"value":[0]}}')], "domain string, json string")
    want = {("A", 2, 2, 1, 1, 1, 1), ("B", 2, 1, 1, 0, 0, 1)}
    assert set(map(tuple, G.label_summary(docs).collect())) == want
    kind = pa.struct([(c, pa.int64()) for c in G._COUNTS])
    monkeypatch.setattr(G, "_counts", F.arrow_udf(lambda t: pa.nulls(len(t), kind), G._counts.returnType))
    assert set(map(tuple, G.label_summary(docs).collect())) == want


def test_label_summary_of_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([(b'{"a":{"value":"\xff","critical":true}}',), (b"\xff",), (b'{"a":{"value":1}}',)], "b binary").selectExpr("'A' AS domain", "CAST(b AS STRING) AS json")
    assert [tuple(x) for x in G.label_summary(docs).collect()] == [("A", 3, 2, 2, 1, 1, 1)]


def test_texts_of_orders_are_as_format_string_shows_them(spark):
    from docscore.plans import documents as Q

    numbers = [None, 0.0, -0.0, 0.004, 0.005, 0.01, 1.005, 2.675, -1.5, 100.1, 123456789012.34, 9999999999999.99, 1e13, 1e22, float("nan"), float("inf")]
    rows = spark.createDataFrame([(i, None if i % 3 else "x", n) for i, n in enumerate(numbers)], "k long, f string, c double")
    k = F.when(F.col("k") % 2 == 0, F.col("k"))
    new = Q._shown('{"k":', k, ',"f":"', F.col("f"), '","c":', Q._cents(F.col("c")), "}")
    assert rows.filter(~new.eqNullSafe(F.format_string('{"k":%d,"f":"%s","c":%.2f}', k, "f", "c"))).count() == 0


def test_repeated_ids_are_documents_of_their_own(spark):
    docs = [(1, "A", '{"a":{"value":1,"critical":true}}'), (1, "A", '{"a":{"value":""},"l":[{"b":{"value":2}}]}'), (None, "A", '{"a":{"value":1}}'), (2, "A", '{"keys":[],"a":{"value":1}}'), (2, None, "{}")]
    rows = spark.createDataFrame(docs, "doc long, domain string, json string")
    assert {r.domain: tuple(r)[1:] for r in G.raw_summary(rows).collect()} == {"A": (4, 5, 4, 1, 1), None: (1, 0, 0, 0, 0)}
    assert {r.domain: tuple(r)[1:] for r in G.label_summary(rows).collect()} == {"A": (4, 3, 2, 1, 1, 1), None: (1, 0, 0, 0, 0, 1)}


def test_a_text_is_read_and_walked_once(spark):
    docs = spark.createDataFrame([(1, "A", '{"a":{"value":1}}')], "doc long, domain string, json string")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    for df in (G.keys(docs), G.key_names(docs), G.value_nodes(docs), G.raw_summary(docs), G.label_summary(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(T._END) == 2, plan  # the mark and the test for it, in one expression
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before


def test_members_are_told_by_the_text_where_they_come_first(spark):
    texts = {'{"value":1}': True, '{ "value" : 1 }': True, '{"a":{"value":1}}': False, '{"a":1,"value":2}': True, '{"a":"{\\"value\\":1}"}': False, '["value"]': False, '"value"': False, '{"values":1}': False, "{": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.parsed(F.col("t")).alias("n")).select(T.has_member(F.col("n"), "value").alias("v"))
    assert [r.v for r in rows.collect()] == list(texts.values())
    assert 'StartsWith(n#' in rows._jdf.queryExecution().optimizedPlan().toString()


def test_depth_of_deep_texts(spark):
    texts = {"[" * n + "]" * n: n for n in (1, 7, 8, 9, 40)} | {'{"a":"]}","b":[{},[[]]],"c\\\\":{"d\\"{":[]}}': 4, "": 1, "]]": 1, '{"a":[': 2}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.depth(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == list(texts.values())
    deep = '{"a":' * 40 + '[{"b":{"value":1},"c":2}]' + "}" * 40
    assert [(r.name, r.expected) for r in G.keys(spark.createDataFrame([(1, deep)], "doc long, json string")).collect()] == [("b", ["1"]), ("c", ["2"])]


# --- tree diff -------------------------------------------------------------------------


def differences(a, b, path="$", name=None, within=False):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    free = lambda k: k in D.VOLATILE or within and k in D.INSIDE
    if free(name):
        yield path, "", True
    elif number(a) and number(b):
        if abs(a - b) > 1 and abs(a - b) > 0.25 * max(abs(a), abs(b)):
            yield path, "number", False
    elif type(a) is not type(b):
        yield path, "type", False
    elif isinstance(a, dict):
        for k in a.keys() | b.keys():
            if k in a and k in b:
                yield from differences(a[k], b[k], f"{path}.{k}", k, within or k in D.CONTAINERS)
            else:
                yield f"{path}.{k}", "key_a" if k in a else "key_b", free(k)
    elif isinstance(a, list) and len(a) != len(b):
        yield path, "length", False
    elif isinstance(a, list):
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            yield from differences(x, y, f"{path}[{i}]", None, within)
    elif a != b:
        yield path, "text" if isinstance(a, str) else "value", isinstance(a, str) and (" " in a + b or len(a) >= 40 or len(b) >= 40)


def test_tree_diff_equals_plain_python(spark):
    r = random.Random(3)
    names = ["a", "b", "value", "found", "extracted_pairs", "latency_ms", "source", "notes", "é"]

    def tree(depth=0):
        c = r.random()
        if depth > 4 or c < 0.4:
            return r.choice([None, True, False, 0, 1, 2, 100, 101.5, 130, "x", "y", "x y", "z" * 50, 1.0])
        return [tree(depth + 1) for _ in range(r.randint(0, 3))] if c < 0.6 else {r.choice(names): tree(depth + 1) for _ in range(r.randint(0, 5))}

    def changed(t):
        if r.random() < 0.15:
            return tree(3)
        return {k: changed(v) for k, v in t.items() if r.random() > 0.08} if isinstance(t, dict) else [changed(v) for v in t] if isinstance(t, list) else t

    trees = [{n: tree(1) for n in r.sample(names, 4)} for _ in range(800)]
    rows = [(i, json.dumps(t), json.dumps(changed(t))) for i, t in enumerate(trees)] + [(9005, "1", "1.5"), (9006, "null", "null"), (9007, "[1]", "{}")]
    broken = [(9001, None, "{}"), (9002, "{", "1"), (9003, None, None), (9004, "", "x")]
    got = {}
    for x in D.tree_diff(spark.createDataFrame(rows + broken, "key long, a string, b string")).collect():
        got.setdefault(x.key, []).append((x.path, x.kind, x.ignored))
    for k, a, b in rows:
        assert sorted(got.get(k, [])) == sorted(differences(json.loads(a), json.loads(b))), (a, b)
    assert {k: sorted(kind for _, kind, _ in got[k]) for k, _, _ in broken} == {9001: ["missing_a"], 9002: ["invalid_a"], 9003: ["missing_a", "missing_b"], 9004: ["invalid_a", "invalid_b"]}


# --- extraction --------------------------------------------------------------------------


def test_answers_read_text_where_json_names_nothing(spark):
    cases = {
        "Total: 5\n{}": [("Total", "5")],
        '{"note":"x"}\nTotal: 5': [("Total", "5")],
        '[{"key":"total","value":"b"}]': [("Total", "b")],
        '{"total":7.0,"note":"x","Day":null}': [("total", "7"), ("Day", "")],
        '{"pairs":[{"key":"any","value":true},3,{"name":"","field":"f","value":null,"extracted_value":1e-7}],"values":{"x":1,"DAY":[1,"a"]}}': [("any", "true"), ("f", "1e-07"), ("DAY", '[1,"a"]')],
        '{"pairs":[{"key":0,"value":"x"}],"total":"t"}': [("total", "t")],
        "null": [],
        "": [],
        None: [],
        "day: 1\nTOTAL : 2\nday: 3\nother: 4": [("Day", "3"), ("Total", "2")],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = rows.select("i", J.answers(F.col("t"), F.array(F.lit("Total"), F.lit("Day"))).alias("p")).orderBy("i").collect()
    for r, (t, want) in zip(got, cases.items(), strict=True):
        assert [(p.key, p.value) for p in r.p] == want, t


def test_found_marks_are_booleans_and_keys_count_once(spark):
    raw = '{"pairs":[{"key":"k k","value":"v","found":"false"},{"key":"q","value":"w","found":false}]}'
    p = spark.range(1).select(J.answers(F.lit(raw)).alias("p")).first().p
    assert [(x.key, x.found) for x in p] == [("k k", None), ("q", False)]
    runs = spark.createDataFrame([("t", "d", raw), ("u", "d", "K k: v\nsecond: x"), ("w", "e", "K k: v")], "task_key string, document_id string, raw_output string")
    truth = spark.createDataFrame([("d", "k k", True, ["v"]), ("d", "K-K", False, ["v"]), ("d", "Second", False, []), ("d", "q", False, ["w"])], "document_id string, name string, critical boolean, expected array<string>")
    truth = truth.withColumn("data_type", F.lit(None).cast("string")).withColumn("match", F.lit("normalized_text"))
    s = {r.task_key: r for r in scoring.score_runs(scoring.key_scores(runs, truth)).collect()}
    assert set(s) == {"t", "u"}
    assert (s["t"].field_total, s["t"].field_correct, s["t"].found_keys, s["t"].requested_keys, s["t"].success) == (3, 3, 1, 4, True)
    assert (s["u"].field_correct, s["u"].found_keys) == (2, 2)


def test_listed_keys(spark):
    text = "- Invoice Number: 1\n* Vendor Name : x\nCompany- y\n- Invoice Number: 2\nno colon here\n" + "\n".join(f"Key{i}: v" for i in range(100))
    got = spark.range(1).select(J.distinct_keys(F.lit(text)).alias("k")).first().k
    assert got[:3] == ["Invoice Number", "Vendor Name", "Company"] and len(got) == 50


def test_depth_and_parsing(spark):
    texts = ['{"a":[{"b":"]]["}]}', "[]", "5", '"s"', "tru", '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', " {} ", None, "1 2", "{'a':1}"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.parsed(F.col("t"))["kind"].alias("k"), T.depth(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.k for r in got] == ["object", "array", "integer", "string", None, None, None, "object", None, None, None] and got[0].d == 3
