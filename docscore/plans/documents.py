"""Queries over answers, ground truth, datasets, artifacts and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsontree as JT
from ..functions import jsonx as J
from ..functions import text as T
from ..functions.rounding import retry_ceiling
from ..operators import artifacts as A
from ..operators import diff as D
from ..operators import groundtruth as G
from ..operators import leaderboard as L
from ..operators import matching as M
from ..operators import render, runner, scoring
from ..operators import report as Q
from ..operators.checkpoint import first_nonempty
from ..session import keep
from ..sources import files
from ..sources.snapshots import Snapshots
from ..streaming import leaderboard as S
from ..streaming import progress as P
from .adapters import LOG, RUNS, log, runs, table
from .aggregates import OFFLINE_BY_DOMAIN, ONLINE, PROGRESS, r

# --- answers in eight shapes ------------------------------------------------------------

_KEYS = ("Name", "Segment", "Visits")


def _answers(spark, d):
    """An answer a customer: JSON with typed values, in a fence, in prose, lines, lines before an empty object,
    an object that names no requested key before lines, a list, and members that nobody asked for."""
    k = F.col("c_custkey")
    seg = F.when(k % 5 == 1, F.upper("c_mktsegment")).when(k % 5 == 2, "").when(k % 5 == 3, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    name = F.when(k % 5 == 3, F.concat("c_name", F.lit(" Inc."))).when(k % 5 == 4, F.lit("Nobody")).otherwise(F.col("c_name"))
    shapes = (
        F.format_string('{"pairs":[{"key":"Name","value":"%s","found":true},{"name":"Segment","extracted_value":"%s"},{"key":"","value":"x"},"odd",{"field":"Visits","value":%d.0,"found":"yes"}]}', name, seg, k % 7),
        F.format_string('Here it is:\n```json\n{"values":{"name":"%s","segment":"%s"}}\n```\nbye', name, seg),
        F.format_string('The answer is {"name":"%s","segment":"%s"} thanks', name, seg),
        F.format_string('Name: not yet known\nSegment: "%s"\nnothing here\nOther: z\nName: %s', seg, name),
        F.format_string("Name: %s\nSegment: %s\n{}", name, seg),
        F.format_string('{"note":"x"}\nName: %s\nSegment: "%s"', name, seg),
        F.format_string('[{"key":"name","value":"%s"},{"key":"Segment","value":"%s"}]', name, seg),
        F.format_string('{"other":"z","values":{"Seg":"no","segment":"%s","NAME":"%s"}}', seg, name),
    )
    raw = F.when(k % 8 == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        raw = raw.when(k % 8 == i, shape)
    return table(spark, d, "customer").select(k.alias("id"), "c_name", "c_mktsegment", name.alias("name"), seg.alias("segment"), raw.alias("raw"))


_ANSWERS = """a AS (SELECT c_custkey AS id, c_name, c_mktsegment, CASE c_custkey % 5 WHEN 3 THEN c_name || ' Inc.' WHEN 4 THEN 'Nobody' ELSE c_name END AS name,
  CASE c_custkey % 5 WHEN 1 THEN upper(c_mktsegment) WHEN 2 THEN '' WHEN 3 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment FROM customer),
x AS (SELECT *, CASE id % 8 WHEN 0 THEN printf('{"pairs":[{"key":"Name","value":"%s","found":true},{"name":"Segment","extracted_value":"%s"},{"key":"","value":"x"},"odd",{"field":"Visits","value":%d.0,"found":"yes"}]}', name, segment, id % 7)
  WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || printf('{"values":{"name":"%s","segment":"%s"}}', name, segment) || chr(10) || '```' || chr(10) || 'bye'
  WHEN 2 THEN printf('The answer is {"name":"%s","segment":"%s"} thanks', name, segment) WHEN 3 THEN printf('Name: %s', name) WHEN 4 THEN 'Name: ' || name || chr(10) || '{}' WHEN 5 THEN '{"note":"x"}' || chr(10) || 'Name: ' || name
  WHEN 6 THEN printf('[{"key":"name","value":"%s"},{"key":"Segment","value":"%s"}]', name, segment) ELSE printf('{"other":"z","values":{"Seg":"no","segment":"%s","NAME":"%s"}}', segment, name) END AS raw FROM a),
j AS (SELECT *, coalesce(CASE WHEN try_cast(raw AS JSON) IS NOT NULL THEN raw END, CASE WHEN contains(raw, '```') THEN regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) END,
  CASE WHEN contains(raw, '{') THEN regexp_extract(raw, '(?s)\\{.*\\}', 0) END) AS doc FROM x)"""


def best_effort_json(spark, d):
    return _answers(spark, d).select("id", J.best_json(F.col("raw")).alias("doc"))


def _flat(pairs):
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")


def _asked():
    return F.array(*(F.lit(k) for k in _KEYS))


def extract_pairs_json(spark, d):
    """What JSON alone gives of every answer."""
    return _answers(spark, d).select("id", _flat(J.json_pairs(J.first_json(F.col("raw")), _asked())).alias("pairs"))


def extract_pairs_text(spark, d):
    """What text alone gives of every answer."""
    return _answers(spark, d).select("id", _flat(J.text_pairs(F.col("raw"), _asked())).alias("pairs"))


def extract_answers(spark, d):
    """Pairs of every answer: of JSON where that names a requested key, else of the text."""
    return _answers(spark, d).select("id", _flat(J.answers(F.col("raw"), _asked())).alias("pairs"))


_LINES = "'Name=' || name || CASE WHEN segment = '' THEN '' ELSE ';Segment=' || segment END"
_PAIRS_JSON = """SELECT id, CASE id % 8 WHEN 0 THEN 'Name=' || (doc::JSON->'pairs'->0->>'value') || ';Segment=' || (doc::JSON->'pairs'->1->>'extracted_value') || ';Visits=' || id % 7
  WHEN 1 THEN 'name=' || (doc::JSON->'values'->>'name') || ';segment=' || (doc::JSON->'values'->>'segment') WHEN 2 THEN 'name=' || (doc::JSON->>'name') || ';segment=' || (doc::JSON->>'segment')
  WHEN 7 THEN 'segment=' || (doc::JSON->'values'->>'segment') || ';NAME=' || (doc::JSON->'values'->>'NAME') ELSE '' END AS pairs FROM j"""
_PAIRS_TEXT = f"SELECT id, CASE WHEN id % 8 = 0 THEN 'Name=' || name WHEN id % 8 IN (3, 4, 5) THEN {_LINES} WHEN id % 8 = 6 THEN 'Name=' || name || ';Segment=' || segment ELSE '' END AS pairs FROM a"
_PAIRS_ALL = f"SELECT a.id, CASE WHEN p.pairs <> '' THEN p.pairs ELSE t.pairs END AS pairs FROM a JOIN ({_PAIRS_JSON}) p ON a.id = p.id JOIN ({_PAIRS_TEXT}) t ON a.id = t.id"


def _truth(spark, d):
    """Three keys a customer: its name (critical), its segment and a number."""
    c = table(spark, d, "customer").select(F.concat(F.lit("doc-"), "c_custkey").alias("document_id"), "c_name", "c_mktsegment", (F.col("c_custkey") % 7).cast("string").alias("visits"))
    one = lambda name, col, critical, kind, match: F.struct(F.lit(name).alias("name"), F.lit(critical).alias("critical"), F.array(col).alias("expected"), F.lit(kind).alias("data_type"), F.lit(match).alias("match"))
    keys = F.array(one("name", "c_name", True, "string", "normalized_text"), one("Segment", "c_mktsegment", False, "string", "normalized_text"), one("Visits", "visits", False, "integer", "numeric"))
    return c.select("document_id", F.inline(keys))


def _scored(spark, d):
    a = _answers(spark, d).select(F.concat(F.lit("t-"), "id").alias("task_key"), F.concat(F.lit("doc-"), "id").alias("document_id"), F.col("raw").alias("raw_output"))
    return scoring.key_scores(a, _truth(spark, d))


def score_runs(spark, d):
    return scoring.score_runs(_scored(spark, d))


_SCORE = """SELECT 't-' || id AS task_key, 3 AS field_total, (id % 5 <> 4)::BIGINT + (id % 5 <> 2)::BIGINT + (id % 8 = 0)::BIGINT AS field_correct, 1 AS critical_total, (id % 5 <> 4)::BIGINT AS critical_correct,
  1 + (id % 5 <> 2)::BIGINT + (id % 8 = 0)::BIGINT AS found_keys, 3 AS requested_keys, id % 5 <> 4 AS success FROM a"""

#: actual, expected, mode, key name, key type, matches
CASES = (
    ("", "N/A", "normalized_text", "x", "string", True), ("", "value", "normalized_text", "x", "string", False), (" a ", "a", "exact", "x", "string", True), ("A", "a", "exact", "x", "string", False),
    ("2024-01-15", "15.01.2024", "normalized_text", "x", "string", True), ("15/01/2024", "2024-01-15", "normalized_text", "invoice date", "date", True), ("2024-01-15 10:30", "15.01.2024 10:30", "normalized_text", "x", "string", True),
    ("2024-01-15 10:30", "15.01.2024 11:30", "normalized_text", "x", "string", False), ("02/03/2024", "2024-03-02", "normalized_text", "x", "string", True), ("02/03/2024", "2024-02-03", "normalized_text", "x", "string", True),
    ("30.02.2024", "2024-02-30", "normalized_text", "x", "string", False), ("10:30 am", "10:30", "normalized_text", "x", "string", True), ("10:30:05", "10:30", "normalized_text", "time", "string", True), ("10:30:05", "10:30:06", "normalized_text", "time", "string", False),
    ("12:15 AM", "00:15", "normalized_text", "x", "string", True), ("3:05 p.m.", "15:05", "normalized_text", "x", "string", True), ("€", "EUR", "normalized_text", "currency", "string", True), ("12 EUR", "€ 9", "normalized_text", "currency", "string", True),
    ("€", "EUR", "normalized_text", "x", "string", False), ("Freight Prepaid", "prepaid", "normalized_text", "freight terms", "string", True), ("collect", "prepaid", "normalized_text", "freight terms", "string", False),
    ("STC Cartons", "cartons", "normalized_text", "package type", "string", True), ("Kgs", "kilogram", "normalized_text", "weight unit", "string", True), ("lb", "kg", "normalized_text", "weight unit", "string", False),
    ("Acme Inc.", "ACME Ltd", "normalized_text", "supplier name", "string", True), ("Acme Inc.", "ACME Ltd", "normalized_text", "x", "string", False), ("c/o Acme A/S", "Acme", "normalized_text", "name", "string", True),
    ("Sea Freight", "sea", "normalized_text", "transport mode", "string", True), ("1.5", "15", "normalized_text", "x", "string", True), ("-5", "5", "numeric", "x", "float", True), ("1,234.56", "1234.56", "numeric", "x", "float", True),
    ("1,50", "1.5", "numeric", "x", "float", True), ("abc", "1", "numeric", "x", "float", False), ("hello big world", "Big World", "contains", "x", "string", True), ("hello", "hello world", "contains", "x", "string", False),
    ("Café", "cafe", "normalized_text", "x", "string", True), ("Αcme", "acme", "normalized_text", "x", "string", True), ("a-b", "a b", "normalized_text", "x", "string", True), ("ab", "a b", "normalized_text", "x", "string", False),
)


def cases(spark):
    """The rules' cases with what they should give."""
    c = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "n long, actual string, expected string, mode string, name string, type string, wanted boolean")
    return _matched(c).select("n", "matched")


def _matched(rows):
    p = rows.withColumn("h", M.hints(F.col("name"), F.col("type")))
    p = p.withColumn("a", M.prepared(F.col("actual"), F.col("h"))).withColumn("e", M.prepared(F.col("expected"), F.col("h")))
    return p.withColumn("matched", M.is_match(F.col("a"), F.col("e"), F.col("mode"), F.col("h")))


def match_cascade(spark, d):
    """Every order as a value of one of twelve kinds, some right and some not, against what is expected of it."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    price, whole = F.format_string("%.2f", "o_totalprice"), F.format_string("%.2f", F.col("o_totalprice") + 1)
    iso, other = F.date_format(day, "yyyy-MM-dd"), F.date_add(day.cast("date"), 31)
    kinds = (
        (F.date_format(day, "dd/MM/yyyy"), iso, "normalized_text", "x", "string"), (F.date_format(other, "dd.MM.yyyy"), iso, "normalized_text", "x", "date"), (F.replace(price, F.lit("."), F.lit(",")), price, "numeric", "x", "float"),
        (whole, price, "numeric", "x", "float"), (F.concat(F.lit("€ "), F.col("o_custkey")), F.lit("EUR"), "normalized_text", "currency", "string"), (F.concat(F.lit("€ "), F.col("o_custkey")), F.lit("EUR"), "normalized_text", "x", "string"),
        (F.concat(F.lower("o_orderpriority"), F.lit(" Inc.")), F.concat("o_orderpriority", F.lit(", LTD")), "normalized_text", "supplier name", "string"), (F.concat(F.lower("o_orderpriority"), F.lit(" Inc.")), F.concat("o_orderpriority", F.lit(", LTD")), "normalized_text", "x", "string"),
        (F.lit(""), F.when(k % 2 == 0, "N/A").otherwise(F.col("o_orderpriority")), "normalized_text", "x", "string"), (F.concat(F.lit("seen by "), "o_orderpriority"), F.col("o_orderpriority"), "contains", "x", "string"),
        (F.concat(F.lit(" "), "o_orderpriority"), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(F.lower("o_orderpriority")), "exact", "x", "string"), (F.concat(iso, F.lit(" 10:30")), F.concat(F.date_format(day, "dd.MM.yyyy"), F.when(k % 2 == 0, " 10:30 AM").otherwise(" 11:30")), "normalized_text", "x", "string"),
    )
    cols = []
    for at, name in enumerate(("actual", "expected", "mode", "name", "type")):
        lit = lambda v: F.lit(v) if isinstance(v, str) else v
        c = F.when(k % 12 == 0, lit(kinds[0][at]))
        for i, kind in enumerate(kinds[1:], 1):
            c = c.when(k % 12 == i, lit(kind[at]))
        cols.append(c.alias(name))
    return _matched(table(spark, d, "orders").select(k.alias("o_orderkey"), *cols)).select("o_orderkey", "matched")


_CASCADE = """WITH o AS (SELECT o_orderkey, o_orderkey % 12 AS k, o_orderkey % 2 = 0 AS even, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 31 AS other FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN true WHEN 1 THEN other = day OR (day(other) <= 12 AND year(other) = year(day) AND month(other) = day(day) AND day(other) = month(day))
  WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN true WHEN 7 THEN false WHEN 8 THEN even WHEN 9 THEN true WHEN 10 THEN even ELSE even END AS matched FROM o"""

# --- ground truth ------------------------------------------------------------------------


#: Leaves that need care: white space, whole floats, truthiness, modes and types as they are written, types that are no text.
_HARD = '"odd":[" 2024-01-02 ","\\n x\\t",1e16,true,[1],null],"hard":{"one":{"value":1.50,"critical":1,"match":" Exact ","type":5},"two":{"value":[true,2.0,null," z "],"critical":"yes","type":" Float ","notes":"n"},"three":{"value":{"k":1},"critical":[],"type":"x"}},'


def _shown(*parts) -> Column:
    """Texts and columns as one text, as format_string shows them (null as a word) but without reading a pattern for each row."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts))


def _cents(c: Column) -> Column:
    """A number with two digits behind the point. Only what these don't hold exactly is left to format_string."""
    exact = c.try_cast("decimal(15,2)")
    return F.when((c > 0) & (exact.cast("double") == c), exact.cast("string")).otherwise(F.format_string("%.2f", c))


def _gt(spark, d):
    """An order as nested ground truth with its lines as a list of items."""
    li = table(spark, d, "lineitem")
    item = _shown('{"qty":', F.col("l_quantity").cast("long"), ',"flag":"', F.col("l_returnflag"), '","price":{"value":', _cents(F.col("l_extendedprice")), ',"critical":true,"type":"float"}}')
    order = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("i"))))
    items = li.groupBy("l_orderkey").agg(F.array_join(order["i"], ",").alias("items"))
    j = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = _shown(
        '{"order":{"id":{"value":', F.col("o_orderkey"), ',"critical":true,"type":"integer"},"day":{"value":"', day, '"},"note":{"value":null,"critical":true}},"status":{"value":["', F.col("o_orderstatus"),
        '"," ","?"],"match":"exact"},"plain":7,"other":{"day":{"value":" "}},' + _HARD + '"items":[', F.col("items"), "]}",
    )
    return j.select(F.col("o_orderkey").alias("doc"), text.alias("json"), day.alias("day"), "o_orderstatus")


def gt_flatten(spark, d):
    k = G.read_keys(_gt(spark, d).select("doc", "json"))
    return k.select("doc", "ordinal", "name", "critical", F.array_join("expected", "|").alias("expected"), "data_type", "match")


_HARD_ROWS = """(6, 'odd_1', false, '2024-01-02', 'date', 'normalized_text'), (7, 'odd_2', false, 'x', 'string', 'normalized_text'), (8, 'odd_3', false, '10000000000000000', 'float', 'numeric'),
  (9, 'odd_4', false, 'true', 'boolean', 'normalized_text'), (10, 'odd_5', false, '1', NULL, 'normalized_text'), (11, 'odd_6', false, '', NULL, 'normalized_text'),
  (12, 'one', true, '1.5', NULL, 'exact'), (13, 'two', true, 'True|2.0|z', ' Float ', 'numeric'), (14, 'three', false, '{"k":1}', 'x', 'normalized_text')"""
_GT_SQL = f"""WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, printf('{{"qty":%d,"flag":"%s","price":{{"value":%.2f', CAST(l_quantity AS BIGINT), l_returnflag, l_extendedprice)) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM li))
SELECT o_orderkey AS doc, 1 AS ordinal, 'id' AS name, true AS critical, CAST(o_orderkey AS VARCHAR) AS expected, 'integer' AS data_type, 'numeric' AS match FROM o
UNION ALL SELECT o_orderkey, 2, 'order_day', false, strftime(o_orderdate, '%Y-%m-%d'), NULL, 'normalized_text' FROM o
UNION ALL SELECT o_orderkey, 3, 'note', true, '', NULL, 'normalized_text' FROM o
UNION ALL SELECT o_orderkey, 4, 'status', false, o_orderstatus || '|?', NULL, 'exact' FROM o
UNION ALL SELECT o_orderkey, 5, 'other_day', false, '', NULL, 'normalized_text' FROM o
UNION ALL SELECT o_orderkey, h.* FROM o, (VALUES {_HARD_ROWS}) h
UNION ALL SELECT l_orderkey, 12 + 3 * i, CASE WHEN n > 1 THEN 'items_' || i || '_qty' ELSE 'qty' END, false, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 'integer', 'numeric' FROM li
UNION ALL SELECT l_orderkey, 13 + 3 * i, CASE WHEN n > 1 THEN 'items_' || i || '_flag' ELSE 'flag' END, false, l_returnflag, 'string', 'normalized_text' FROM li
UNION ALL SELECT l_orderkey, 14 + 3 * i, CASE WHEN n > 1 THEN 'items_' || i || '_price' ELSE 'price' END, true, regexp_replace(regexp_replace(printf('%.2f', l_extendedprice), '0+$', ''), '\\.$', ''), 'float', 'numeric' FROM li"""


def gt_dedupe_names(spark, d):
    """Names of clashing leaves, counted."""
    k = G.key_names(_gt(spark, d).select("doc", "json")).groupBy("doc").agg(F.flatten(F.collect_list("names")).alias("n"))
    size = lambda c: F.size(c).cast("long")
    return k.select("doc", size("n").alias("keys"), size(F.array_distinct("n")).alias("names"), size(F.filter("n", lambda t: t.startswith("items_"))).alias("pathed")).filter("keys > 0")


_GT_NAMES = f"SELECT doc, count(*) AS keys, count(DISTINCT name) AS names, count(*) FILTER (starts_with(name, 'items_')) AS pathed FROM ({_GT_SQL}) GROUP BY doc"


def _label_keys(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "l_id")
    j = docs.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    none = F.array().cast("array<string>")
    return j.select(F.col("lang").alias("domain"), F.col("doc_id").alias("doc"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("critical"), F.when(F.col("toxic").isNull(), none).otherwise(F.array(F.col("toxic").cast("string"))).alias("expected"))


_LABEL_KEYS = "k AS (SELECT lang AS domain, d.doc_id AS doc, coalesce(quality = 1, false) AS critical, toxic IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id))"


def label_completeness(spark, d):
    g = G.dataset_summary(_label_keys(spark, d))
    return g.select("domain", "critical", "critical_labelled", F.when(F.col("critical") > 0, F.col("critical_labelled") / F.col("critical") * 100).otherwise(0.0).alias("critical_pct"))


def _manifest(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id")
    return p.select(F.concat(F.lit("dom"), k % 3).alias("domain"), k.alias("position"), F.when(k % 50 == 7, "").otherwise(F.concat(F.lit("doc-"), F.when(k % 40 == 3, k + 1).otherwise(k))).alias("document_id"), F.concat(F.lit("documents/a/src"), k % 200, F.lit(".pdf")).alias("source"), F.concat(F.lit("gt/"), k).alias("truth"))


def dataset_validate(spark, d):
    """A manifest of all pages: missing, repeated and broken entries; every thirteenth ground truth is no JSON, some are of the old schema or empty."""
    k = F.col("page_id")
    p = table(spark, d, "pages")
    text = F.when(k % 13 == 1, '{"a": ').when(k % 13 == 2, '{"keys": []}').when(k % 13 == 3, '{"a": {"b": 1}, "c": [{"d": [1]}]}').otherwise('{"a": {"b": {"value": 1}}}')
    there = p.filter("page_id % 11 <> 0").select(F.concat(F.lit("gt/"), k).alias("path"), text.alias("json"))
    there = there.unionByName(p.filter("page_id < 190").select(F.concat(F.lit("documents/a/src"), k, F.lit(".pdf")).alias("path"), F.lit(None).cast("string").alias("json")))
    there = there.unionByName(p.filter("page_id < 5").select(F.concat(F.lit("documents/a/"), F.when(k % 2 == 0, "full_size").otherwise(F.concat(F.lit("odd"), k)), F.lit("/x.PDF")).alias("path"), F.lit(None).cast("string").alias("json")))
    domains = _manifest(spark, d).groupBy("domain").agg(F.count("*").cast("int").alias("listed")).select("domain", (F.col("listed") + F.when(F.col("domain") == "dom1", 1).otherwise(0)).alias("document_count"), "listed", (F.col("domain") != "dom2").alias("valid"))
    return G.validate(_manifest(spark, d), there, domains).groupBy("rule", "document_id").agg(F.count("*").alias("n"))


_VALIDATE = """WITH m AS (SELECT page_id, CASE WHEN page_id % 50 = 7 THEN '' ELSE 'doc-' || CASE WHEN page_id % 40 = 3 THEN page_id + 1 ELSE page_id END END AS document_id, page_id % 200 AS source FROM pages),
c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_id) AS nd, row_number() OVER (PARTITION BY source ORDER BY page_id) AS ns FROM m WHERE document_id <> ''),
v AS (SELECT 'missing_fields' AS rule, document_id FROM m WHERE document_id = '' UNION ALL SELECT 'duplicate_id', document_id FROM c WHERE nd > 1 UNION ALL SELECT 'reused_source', document_id FROM c WHERE ns > 1
 UNION ALL SELECT 'missing_source', document_id FROM c WHERE source NOT IN (SELECT page_id FROM pages WHERE page_id < 190) UNION ALL SELECT 'missing_truth', document_id FROM c WHERE page_id % 11 = 0
 UNION ALL SELECT CASE page_id % 13 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'legacy_schema' ELSE 'no_values' END, document_id FROM c WHERE page_id % 11 <> 0 AND page_id % 13 IN (1, 2, 3)
 UNION ALL SELECT 'nested_pdf', 'odd' || page_id FROM pages WHERE page_id < 5 AND page_id % 2 <> 0
 UNION ALL SELECT 'bad_domain', 'dom2' WHERE EXISTS (SELECT 1 FROM pages WHERE page_id % 3 = 2) UNION ALL SELECT 'count_mismatch', 'dom1' WHERE EXISTS (SELECT 1 FROM pages WHERE page_id % 3 = 1)) SELECT rule, document_id, count(*) AS n FROM v GROUP BY ALL"""


def raw_summary(spark, d):
    """Value objects of all orders as the raw walk meets them, by status."""
    return G.raw_summary(_gt(spark, d).select("doc", F.col("o_orderstatus").alias("domain"), "json"))


_RAW_SUMMARY = """WITH li AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT o_orderstatus AS domain, count(*) AS documents, CAST(sum(8 + n) AS BIGINT) AS keys, CAST(sum(5 + n) AS BIGINT) AS labelled, CAST(sum(4 + n) AS BIGINT) AS critical, CAST(sum(3 + n) AS BIGINT) AS critical_labelled FROM orders JOIN li ON o_orderkey = l_orderkey GROUP BY ALL"""


def label_summary(spark, d):
    """Labels of all orders by status; some documents are broken, in the old schema, without values or not there."""
    k = F.col("doc")
    text = F.when(k % 11 == 3, '{"a": ').when(k % 11 == 4, '{"keys": [], "a": {"value": 1}}').when(k % 11 == 5, '{"items": [{"a": {"value": 1}}]}').when(k % 11 != 6, F.col("json"))
    return G.label_summary(_gt(spark, d).select("doc", F.col("o_orderstatus").alias("domain"), text.alias("json")))


_LABEL_SUMMARY = """WITH o AS (SELECT o_orderstatus AS domain, o_orderkey % 11 IN (3, 4, 5, 6) AS bad FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT domain, count(*) AS documents, 8 * count(*) FILTER (NOT bad) AS keys, 6 * count(*) FILTER (NOT bad) AS labelled, 4 * count(*) FILTER (NOT bad) AS critical, 3 * count(*) FILTER (NOT bad) AS critical_labelled, count(*) FILTER (bad) AS invalid FROM o GROUP BY domain"""


def selected_documents(spark, d):
    """The first fifty pages of two named domains."""
    return G.selected_documents(_manifest(spark, d), [" DOM1", "dom2 "], 50).select("domain", "position")


_SELECTED = "SELECT 'dom' || page_id % 3 AS domain, page_id AS position FROM pages WHERE page_id % 3 IN (1, 2) QUALIFY row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) <= 50"


def _folder(spark, name: str) -> str:
    """A new folder of our own in the shared one."""
    sc = spark.sparkContext
    keep(spark.range(1))  # sees to it that there is one
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def selected_truth(spark, d):
    """Ground truth of those documents alone that were run with an error by one provider: thirty files, of which the others are not opened."""
    n = F.col("c_custkey") % 30
    docs = table(spark, d, "customer").groupBy(n.alias("n")).agg(F.format_string('{"total":{"value":%d,"critical":true},"most":[{"name":{"value":"%s"}}]}', F.count("*"), F.max("c_name")).alias("value"))
    folder = _folder(spark, "truth")
    docs.select(F.concat(F.lit("doc-"), "n").alias("doc"), "value").repartition("doc").write.partitionBy("doc").text(folder)
    documents = docs.select(F.concat(F.lit("D"), F.col("n") % 3).alias("domain"), F.concat(F.lit("doc-"), "n").alias("document_id"), F.concat(F.lit("doc=doc-"), "n").alias("truth"))
    some = G.ran(documents, runs(spark, d).filter("error is not null and model_key like 'p1:%' and ordinal % 30 <> 0"))
    k = G.keys(G.prepared(spark, some, folder).select(F.col("document_id").alias("doc"), "json"))
    return k.select("doc", "ordinal", "name", "critical", F.array_join("expected", "|").alias("expected"))


_SELECTED_TRUTH = f"""WITH {RUNS}, s AS (SELECT DISTINCT document_id FROM runs WHERE error IS NOT NULL AND starts_with(model_key, 'p1:') AND ordinal % 30 <> 0),
f AS (SELECT 'doc-' || c_custkey % 30 AS doc, count(*) AS n, max(c_name) AS most FROM customer GROUP BY ALL)
SELECT doc, 1 AS ordinal, 'total' AS name, true AS critical, CAST(n AS VARCHAR) AS expected FROM f SEMI JOIN s ON doc = document_id UNION ALL SELECT doc, 2, 'name', false, most FROM f SEMI JOIN s ON doc = document_id"""


def log_file(spark, d):
    """The run log as files of many splits, read without reading any of them whole; the last record of each task counts."""
    folder = _folder(spark, "log")
    x = log(spark, d)
    line = F.to_json(F.struct("task_key", "ordinal", "latency_ms"))
    x.repartitionByRange(4, "ordinal").sortWithinPartitions("ordinal").select(F.when(F.col("ordinal") % 50 == 7, F.concat(line, F.lit("\n\nbroken {"))).otherwise(line).alias("value")).write.text(folder)
    read = files.json_lines(spark, folder, "task_key string, ordinal long, latency_ms long")
    last = read.groupBy("task_key").agg(F.max_by(F.struct("ordinal", "latency_ms"), F.struct("file", "line")).alias("r"), F.max_by("ordinal", F.struct("file", "position")).alias("by_position"))
    return last.select("task_key", "r.ordinal", "r.latency_ms", "by_position")


_LOG_FILE = f"WITH {LOG} SELECT task_key, ordinal, latency_ms, ordinal AS by_position FROM latest"


def dataset_warnings(spark, d):
    """Domains with nothing labelled, not all labelled, or fewer than ten documents."""
    g = G.dataset_summary(_label_keys(spark, d))
    w = F.array_compact(F.array(F.when(F.col("labelled") == 0, "none_labelled"), F.when(F.col("labelled") < F.col("keys"), "not_all_labelled"), F.when(F.col("documents") < 10, "few_documents")))
    return g.select("domain", F.explode(w).alias("warning"))


# --- artifacts, text, runtime -------------------------------------------------------------


def name_match(spark, d):
    k = F.col("p_partkey")
    left = table(spark, d, "part").select(F.concat(F.when(k % 3 == 0, F.upper(F.concat(F.lit("Doc "), k))).otherwise(F.concat(F.lit("doc-"), k)), F.lit(".pdf")).alias("file"))
    n = F.col("s_suppkey")
    more = F.when(n % 5 == 0, F.concat(F.lit("doc_"), n, F.lit(".json"))).when(n % 7 == 0, F.concat(F.lit("doc "), n, F.lit(".json")))
    right = table(spark, d, "supplier").select(F.explode(F.array_compact(F.array(F.concat(F.lit("doc-"), n, F.lit(".json")), more))).alias("truth"))
    return D.name_match(left, right)


_NAME_MATCH = """WITH l AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'DOC ' || p_partkey ELSE 'doc-' || p_partkey END || '.pdf' AS file, p_partkey AS k FROM part),
j AS (SELECT file, k, s_suppkey, CASE WHEN s_suppkey IS NULL THEN 'none' WHEN k % 3 <> 0 THEN 'exact' WHEN k % 5 = 0 THEN 'preferred' WHEN k % 7 = 0 THEN 'none' ELSE 'normalised' END AS how FROM l LEFT JOIN supplier ON s_suppkey = k)
SELECT file, CASE how WHEN 'none' THEN NULL WHEN 'preferred' THEN 'doc_' || k || '.json' ELSE 'doc-' || k || '.json' END AS truth, how FROM j"""


def artifact_diff(spark, d):
    e = runs(spark, d)
    a = e.filter("ordinal % 13 <> 1").select("ordinal", F.col("latency_ms").cast("double").alias("latency"), "error", "model_key")
    b = e.filter("ordinal % 17 <> 2").select("ordinal", F.when(F.col("ordinal") % 5 == 0, F.col("latency_ms") * 2.0).otherwise(F.col("latency_ms") + 1.0).alias("latency"), F.when(F.col("ordinal") % 11 == 0, "changed").otherwise(F.col("error")).alias("error"), F.lit("other").alias("model_key"))
    x = D.artifact_diff(a, b, "ordinal", ["latency"], ["error", "model_key"], ignored=("model_key",))
    return x.select("key", "field", "kind", r_(F.col("drift")).alias("drift"))


def r_(c):
    from ..functions.rounding import round_half

    return round_half(c, 6)


_DIFF = f"""WITH {RUNS}, a AS (SELECT ordinal, CAST(latency_ms AS DOUBLE) AS latency, error FROM runs WHERE ordinal % 13 <> 1),
b AS (SELECT ordinal, CASE WHEN ordinal % 5 = 0 THEN latency_ms * 2e0 ELSE latency_ms + 1e0 END AS latency, CASE WHEN ordinal % 11 = 0 THEN 'changed' ELSE error END AS error FROM runs WHERE ordinal % 17 <> 2),
j AS (SELECT coalesce(a.ordinal, b.ordinal) AS key, a.ordinal AS ao, b.ordinal AS bo, a.latency AS al, b.latency AS bl, a.error AS ae, b.error AS be FROM a FULL JOIN b ON a.ordinal = b.ordinal)
SELECT key, '' AS field, CASE WHEN ao IS NULL THEN 'missing_left' ELSE 'missing_right' END AS kind, CAST(NULL AS DOUBLE) AS drift FROM j WHERE ao IS NULL OR bo IS NULL
UNION ALL SELECT key, 'latency', 'number', {r("CASE WHEN al = 0 THEN 'inf'::DOUBLE ELSE (bl - al) / abs(al) END", 6)} FROM j WHERE ao IS NOT NULL AND bo IS NOT NULL AND NOT (abs(al - bl) <= 1 OR abs(al - bl) / greatest(abs(al), abs(bl), 1e-300) <= 0.25)
UNION ALL SELECT key, 'error', 'text', NULL FROM j WHERE ao IS NOT NULL AND bo IS NOT NULL AND ae IS DISTINCT FROM be"""


def first_value(spark, d):
    """The first answer of each conversation."""
    c = table(spark, d, "conversations").withColumn("value", F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")))
    return first_nonempty(c, ["conv_id"], "value", "turn")


def prompt_render(spark, d):
    """Prompts of all keys of all orders."""
    return render.read_prompts(_gt(spark, d).select("doc", "json"), "Read the keys.\n{{REQUESTED_KEYS}}\nEnd.")


_PROMPT = f"""SELECT doc, 'Read the keys.' || chr(10) || string_agg('- ' || name || ' (type: ' || coalesce(data_type, 'string') || ', critical: ' || CASE WHEN critical THEN 'yes' ELSE 'no' END || ')', chr(10) ORDER BY ordinal) || chr(10) || 'End.' AS prompt
FROM ({_GT_SQL}) GROUP BY doc"""

_MD = ["rank", "model_key", "success_rate_pct", "avg_field_accuracy_pct", "cost_per_success_usd"]


def markdown_table(spark, d):
    return render.markdown(L.leaderboard_online(runs(spark, d)), _MD, "rank")


_MARKDOWN = f"""SELECT '| {' | '.join(_MD)} |' || chr(10) || '|{'---|' * len(_MD)}' || chr(10) || string_agg('| ' || rank || ' | ' || model_key || ' | ' || printf('%.2f', success_rate_pct) || ' | ' || printf('%.2f', avg_field_accuracy_pct) || ' | ' || coalesce(printf('%.2f', cost_per_success_usd), '-') || ' |', chr(10) ORDER BY rank) AS markdown FROM ({ONLINE})"""


def truncation_flag(spark, d):
    """Whole texts as answers: as they are, in an object that is cut off, in a whole object, and with a comma at the end.

    SQL has no strict JSON object out of free text; tests hold it against plain Python."""
    k, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    s = F.when(k % 4 == 0, F.concat(F.lit('{"a": "'), t)).when(k % 4 == 1, F.to_json(F.struct(t.alias("a")))).when(k % 4 == 2, F.concat(t, F.lit(" end,"))).otherwise(t)
    return table(spark, d, "documents").select("doc_id", T.looks_truncated(s, JT.let(J.first_json(s), JT.truthy)).alias("truncated"), retry_ceiling(F.col("n_chars")).alias("ceiling"))


_GRADES = ("budget", "balanced", "sota")


def _lines(spark, d):
    """The log as checkpoint lines, on disk. Every fifth record has no debug members, so it does not count; some
    have members of a wrong type (a word for a number, a number for a text, an unknown grade, a pair without
    its mark) and do not count either; some write numbers as texts, which do. Some keys are "0" and "false"."""
    x, n = log(spark, d), F.col("ordinal")
    key = F.when(n % 97 == 3, "0").when(n % 97 == 5, "false").otherwise(F.col("task_key"))
    k = F.split("model_key", ":")[1]
    provider = F.get(F.array(*(F.lit(p) for p in A.PROVIDERS)), F.substring("model_key", 2, 1).cast("int"))
    of = {
        "provider": provider, "model_id": k, "model_label": F.upper("model_key"), "tier": F.when(n % 19 == 4, "best").otherwise(F.get(F.array(*(F.lit(g) for g in _GRADES)), (n % 3).cast("int"))),
        "run_number": (n % 40).cast("int"), "total_cost_usd": F.col("cost_micro") / 1e6, "cached_input_tokens": F.col("cached_tokens"), "cache_write_tokens": F.lit(0), "field_accuracy_pct": F.lit(0.0), "critical_accuracy_pct": F.lit(0.0),
        "found_key_count": F.col("found_keys"), "requested_key_count": F.col("requested_keys"), "latency_ms": F.when(n % 19 == 3, "bad").otherwise(F.col("latency_ms").cast("string")), "document_id": F.col("document_id"),
    }
    own = lambda names: [of.get(c, F.col(c) if c in x.columns else F.lit(None)).alias(c) for c in names]
    metrics = F.struct(*own([c for c in A._names(A.METRICS) if c != "task_key"]))
    pairs = F.array(F.struct(F.lit("k").alias("key"), F.lit("v").alias("value"), F.when(n % 19 != 5, True).alias("found")))
    more = {"input_tokens": F.when(n % 3 != 0, F.col("input_tokens")), "raw_output": F.when(n % 2 == 0, F.col("task_key")).otherwise("")}
    rest = {"system_prompt_used": F.lit("sys"), "parsed_output": F.lit(None).cast("string"), "extracted_pairs": F.when(n % 4 == 1, pairs)}
    debug = F.struct(*(more.get(c, of.get(c, F.col(c) if c in x.columns else F.lit(None))).alias(c) for c in A._names(A.MODEL + A.DOCUMENT + A.SCORES + A.RUNTIME)), more["raw_output"].alias("raw_output"), *(v.alias(c) for c, v in rest.items()))
    line = A.checkpoint_line(metrics, F.when(n % 5 != 0, debug), key, F.when(n % 4 != 0, "2024-01-01T00:00:00Z"))
    odd = F.when(n % 19 == 6, F.regexp_replace(line, '"completed_at":"[^"]*"', '"completed_at":5')).when(n % 19 == 7, F.concat(line, F.lit(" x"))).otherwise(line)
    # A log on disk, as files, which are written in one pass (a checkpoint takes two).
    cores = spark.sparkContext.defaultParallelism
    lines, folder = x.select("ordinal", odd.alias("value")), _folder(spark, "lines")
    (lines if x.rdd.getNumPartitions() >= cores else x.repartition(cores).select("ordinal", odd.alias("value"))).write.parquet(folder)
    return spark.read.parquet(folder)


def _flat_contract(c):
    return c.select("task_key", "completed_at", "model.provider", "model.model_label", "model.tier", "document.document_id", "document.run_number", "runtime.latency_ms", "runtime.input_tokens", "runtime.error", "payload.raw_output", F.size("payload.extracted_pairs").cast("long").alias("n_pairs"), "legacy_metrics.field_total")


_VALID = "ordinal % 5 <> 0 AND ordinal % 19 NOT IN (3, 4, 7) AND NOT (ordinal % 19 = 5 AND ordinal % 4 = 1) AND NOT (ordinal % 19 = 6 AND ordinal % 4 <> 0)"
_CANONICAL = f"""c AS (SELECT * REPLACE (CASE ordinal % 97 WHEN 3 THEN '0' WHEN 5 THEN 'false' ELSE task_key END AS task_key), task_key AS said FROM log WHERE {_VALID}
  QUALIFY row_number() OVER (PARTITION BY CASE ordinal % 97 WHEN 3 THEN '0' WHEN 5 THEN 'false' ELSE task_key END ORDER BY ordinal DESC) = 1)"""
_FLAT = "['anthropic', 'openai', 'google', 'mistral'][CAST(model_key[2] AS INT) + 1] AS provider, upper(model_key) AS model_label, ['budget', 'balanced', 'sota'][ordinal % 3 + 1] AS tier, document_id, ordinal % 40 AS run_number, latency_ms"


def raw_contract(spark, d):
    """Canonical raw records of the whole checkpoint log, flattened for comparison."""
    return _flat_contract(A.from_checkpoint(A.checkpoint_records(_lines(spark, d))))


def debug_contract(spark, d):
    """Canonical raw records of debug snapshots, one for every hundred records of the log, of runs without a task key of their own."""
    debug = F.get_json_object("value", "$.debug")
    part = F.floor(F.col("ordinal") / 100)
    runs_ = _lines(spark, d).select(part.alias("part"), "ordinal", debug.alias("run")).filter("run is not null")
    docs = runs_.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "run"))), lambda x: x["run"]), ",").alias("r"))
    docs = docs.select(F.col("part").alias("ordinal"), F.concat(F.lit('{"runs":['), "r", F.lit("]}")).alias("json"))
    return _flat_contract(A.from_debug(A.debug_runs(docs, strict=False)))


def export_summary(spark, d):
    return A.export_summary(A.from_checkpoint(A.checkpoint_records(_lines(spark, d))))


def canonical_raw(spark, d):
    """The canonical records, written as lines and read back; the last of each task counts."""
    c = A.from_checkpoint(A.checkpoint_records(_lines(spark, d)))
    c = c.withColumn("payload", F.col("payload").withField("parsed_output", F.lit(None).cast("string")))
    lines = c.select(F.lit(1).alias("ordinal"), F.to_json(F.struct(*c.columns), {"ignoreNullFields": "false"}).alias("value"))
    return A.canonical_lines(lines).select("task_key", F.get_json_object("value", "$.runtime.latency_ms").cast("double").alias("latency_ms"))


def key_sets(spark, d):
    x = log(spark, d)
    return A.key_sets(x.filter("ordinal % 3 = 0"), x.filter("ordinal % 3 <> 0"))


def tree_diff(spark, d):
    """Trees of neighbouring prices of a line: numbers out of tolerance, members of one side, other flags and comments, output of a model, broken and missing trees."""
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber")

    def side(x: int):
        text = F.format_string(
            '{"at":%d,"m":{"price":%.2f,"flag":"%s","note":"a b %s","generated_at":%d},"l":[1,%s],"extracted_pairs":[{"key":"k","value":%d}]%s}', F.lit(1), F.col("l_extendedprice") * x, "l_returnflag" if x == 1 else "l_linestatus",
            F.lit("x" * x), n + x, F.lit("2") if x == 1 else F.col("l_quantity").cast("long").cast("string"), F.lit(100 * x), F.when((n == 1) & F.lit(x == 1), ',"only":1').otherwise(""),
        )
        return F.when((n != 6) | F.lit(x == 1), F.when((n == 7) & F.lit(x == 2), F.left(text, F.lit(40))).otherwise(text))

    return D.diff_report(D.tree_diff(li.select(F.col("l_orderkey").alias("key"), side(1).alias("a"), side(2).alias("b"))))


_TREE = """WITH x AS (SELECT * FROM lineitem WHERE l_linenumber NOT IN (6, 7))
SELECT count(*) FILTER (l_returnflag <> l_linestatus) + count(*) FILTER (l_linenumber = 1) + (SELECT count(*) FROM lineitem WHERE l_linenumber IN (6, 7)) AS structural,
  count(*) FILTER (l_extendedprice > 1) + count(*) FILTER (abs(CAST(l_quantity AS BIGINT) - 2) > 1 AND abs(CAST(l_quantity AS BIGINT) - 2) / greatest(CAST(l_quantity AS BIGINT), 2) > 0.25) AS numeric, 3 * count(*) AS ignored FROM x"""


def runner_stub(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("task_key"), F.concat(F.lit("p"), F.col("doc_id") % 4).alias("provider"), F.lit("- first (type: string, critical: yes)\n- second (type: string, critical: no)").alias("prompt"), F.col("text").alias("document"))
    return runner.extract(q).select("task_key", "provider", F.get_json_object("raw_output", "$.pairs[1].key").alias("second"), "input_tokens", "error")


def pdf_base64(spark, d):
    """Files as they are, in base64: a file for every two hundred documents, written and read again as bytes."""
    folder = _folder(spark, "files")
    text = F.concat(F.lit("d"), F.col("doc_id"), F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " "))
    lines = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 200).alias("part"), "doc_id", text.alias("value"))
    whole = lines.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "value"))), lambda x: x["value"]), "\n").alias("value"))
    whole.repartition("part").write.partitionBy("part").option("lineSep", "\n").text(folder)
    b = files.binary_documents(spark, f"{folder}/part=*", "part-*")
    return b.select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long").alias("part"), F.sha2("base64", 256).alias("digest"))


_FILES = """SELECT doc_id // 200 AS part, sha256(base64(encode(string_agg('d' || doc_id || ': ' || regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g'), chr(10) ORDER BY doc_id) || chr(10)))) AS digest FROM documents GROUP BY ALL"""


def stream_leaderboard(spark, d):
    """The running leaderboard over a stream of event files, as far as there are any."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema.simpleString()
    raw = S.read_log(spark, d, schema[7:-1].replace(":", " "), glob="events.parquet*")
    k, v, u = F.get_json_object("props", "$.k").cast("long"), F.col("value"), F.col("user_id")
    critical, total = F.when(k % 11 == 0, 0).otherwise(3 + k % 2), 8 + k % 5
    win = F.when(critical > 0, F.least(critical, F.floor(v / 8)) == critical).otherwise(F.least(total, F.floor(v / 4)) == total) & (F.col("event_type") != "error")
    x = raw.select(F.concat(F.lit("p"), u % 4, F.lit(":m"), u % 12).alias("model_key"), win.alias("success"), F.floor(v * 100 + 0.5).alias("cost_micro"))
    folder = _folder(spark, "rates")
    P.keep_newest(S.running_rates(x), f"{folder}/board", f"{folder}/checkpoint").awaitTermination()
    return P.newest(spark, f"{folder}/board")


def stream_progress(spark, d):
    """What a run reports while its log grows three times; the stream is started anew each time, from its checkpoint."""
    x = runs(spark, d).select("ordinal", "document_id", "model_key", F.upper("model_key").alias("model_label"), (F.col("ordinal") % 40).cast("int").alias("run_number"), "error")
    expected = keep(x.groupBy("document_id").agg(F.countDistinct("model_key").alias("runs")))
    span = x.agg(F.count("*").alias("n"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b")).first()
    folder = _folder(spark, "progress")
    kind = x.drop("model_key").schema.simpleString()[7:-1].replace(":", " ")
    step = ((span.b or 0) - (span.a or 0)) // 3 + 1
    for i in range(3):
        lo = (span.a or 0) + i * step
        x.drop("model_key").filter((F.col("ordinal") >= lo) & (F.col("ordinal") < lo + step)).write.mode("append").parquet(f"{folder}/log")
        P.follow(S.read_log(spark, f"{folder}/log", kind, glob="*.parquet"), span.n, expected, folder, f"{folder}/checkpoint").awaitTermination()
    return P.events(spark, folder)


def snapshot_files(spark, d):
    """A snapshot of the offline boards, the data set and the canonical log, written, read back and taken apart again."""
    x = runs(spark, d)
    board, domains = L.leaderboard_offline(x), L.leaderboard_offline_by_domain(x)
    dataset = G.dataset_summary(_label_keys(spark, d))
    board, domains, dataset = keep(board), keep(domains), keep(dataset)
    count = x.agg(F.count("*").alias("n"))
    ranges = L.metric_ranges_run(x)
    metrics = Q.document(spark, schema_version="1.0", run_count=count, model_rows=Q.listed(board, "rank"), by_domain=Q.by_bucket(domains, "bucket", "rank"))
    aggregation = Q.document(spark, schema_version="1.0", dataset=Q.listed(dataset, "domain"), leaderboard=Q.listed(board, "rank"), ranges=Q.listed(ranges.filter("bucket = 'overall'"), "model_key"), run_count=count, warnings=Q.warnings(dataset, board))
    frontend = Q.document(spark, options={"max_parallel_requests": 1, "provider_parallel": False}, leaderboard=Q.listed(board, "rank"), by_domain=Q.by_bucket(domains, "bucket", "rank"), run_count=count, markdown_table=render.markdown(board, _MD, "rank").select(Q.quoted(F.col("markdown"))), cache_summary=Q.listed(L.cache_summary(x), "position"), warnings=Q.warnings(dataset, board))
    store = Snapshots(spark, _folder(spark, "snapshots"))
    raw = x.select("ordinal", F.to_json(F.struct("ordinal", "model_key", "latency_ms")).alias("value")).repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("value")
    store.write("snapshot-1", {"metrics": metrics.select(F.lit("{}").alias("value"))})
    store.write("snapshot-2", {"metrics": metrics, "aggregation": aggregation, "frontend": frontend, "raw": raw})
    row = "struct<model_key:string,rank:bigint,success_rate_pct:double,pass_at_3_strict_pct:double,p95_latency_ms:double,cost_per_success_usd:double>"
    of = lambda part, shape: store.read(part).select(F.from_json("value", f"struct<{shape}>").alias("v"))
    rows = of("metrics", f"model_rows:array<{row}>").select(F.lit("overall").alias("bucket"), F.inline("v.model_rows"))
    per = of("frontend", f"by_domain:array<struct<domain:string,rows:array<{row}>>>").select(F.explode("v.by_domain").alias("x")).select(F.col("x.domain").alias("bucket"), F.inline("x.rows"))
    lines = store.read("raw").select(F.from_json("value", "struct<model_key:string,latency_ms:bigint>").alias("r")).groupBy("r.model_key").agg(F.count("*").alias("raw_lines"), F.sum("r.latency_ms").alias("raw_latency"))
    said = of("aggregation", "warnings:array<string>,run_count:bigint").select(F.size("v.warnings").cast("long").alias("n_warnings"), "v.run_count")
    return rows.unionByName(per).join(lines, "model_key").withColumn("n_warnings", said.select("n_warnings").scalar()).withColumn("run_count", said.select("run_count").scalar())


_SNAPSHOT = f"""WITH b AS ({OFFLINE_BY_DOMAIN}), x AS (WITH {RUNS} SELECT model_key, count(*) AS raw_lines, CAST(sum(latency_ms) AS BIGINT) AS raw_latency FROM runs GROUP BY ALL),
{_LABEL_KEYS}, g AS (SELECT domain, count(DISTINCT doc) AS d, count(*) AS k, count(*) FILTER (labelled) AS l FROM k GROUP BY domain),
w AS (SELECT (SELECT CASE WHEN sum(l) < sum(k) THEN 1 ELSE 0 END FROM g) + (SELECT count(*) FROM g WHERE d < 10) + (SELECT CASE WHEN count(*) FILTER (pass_at_10_pct IS NULL) > 0 THEN 1 ELSE 0 END FROM b WHERE bucket = 'overall') AS n_warnings)
SELECT bucket, model_key, rank, success_rate_pct, pass_at_3_strict_pct, p95_latency_ms, cost_per_success_usd, raw_lines, raw_latency, n_warnings, (SELECT count(*) FROM events) AS run_count FROM b JOIN x USING (model_key), w"""

_STREAM = f"WITH {RUNS} SELECT model_key, count(*) AS runs, count(*) FILTER (success) AS successes, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, {r('count(*) FILTER (success) * 100e0 / count(*)', 2)} AS success_rate_pct FROM runs GROUP BY model_key"

QUERIES = {
    "best_effort_json": (best_effort_json, f"WITH {_ANSWERS} SELECT id, doc FROM j"),
    "extract_pairs_json": (extract_pairs_json, f"WITH {_ANSWERS} {_PAIRS_JSON}"),
    "extract_pairs_text": (extract_pairs_text, f"WITH {_ANSWERS} {_PAIRS_TEXT}"),
    "extract_answers": (extract_answers, f"WITH {_ANSWERS} {_PAIRS_ALL}"),
    "match_cascade": (match_cascade, _CASCADE),
    "score_runs": (score_runs, f"WITH {_ANSWERS} {_SCORE}"),
    "gt_flatten": (gt_flatten, _GT_SQL),
    "gt_dedupe_names": (gt_dedupe_names, _GT_NAMES),
    "dataset_summary": (lambda s, d: G.dataset_summary(_label_keys(s, d)), f"WITH {_LABEL_KEYS} SELECT domain, count(DISTINCT doc) AS documents, count(*) AS keys, count(*) FILTER (labelled) AS labelled, count(*) FILTER (critical) AS critical, count(*) FILTER (labelled AND critical) AS critical_labelled, count(*) FILTER (labelled) / (count(*) * 1e0) * 100 AS labelled_pct FROM k GROUP BY domain"),
    "label_completeness": (label_completeness, f"WITH {_LABEL_KEYS}, g AS (SELECT domain, count(*) FILTER (critical) AS critical, count(*) FILTER (labelled AND critical) AS critical_labelled FROM k GROUP BY domain) SELECT *, CASE WHEN critical > 0 THEN critical_labelled / (critical * 1e0) * 100 ELSE 0e0 END AS critical_pct FROM g"),
    "dataset_validate": (dataset_validate, _VALIDATE),
    "raw_summary": (raw_summary, _RAW_SUMMARY),
    "label_summary": (label_summary, _LABEL_SUMMARY),
    "selected_documents": (selected_documents, _SELECTED),
    "selected_truth": (selected_truth, _SELECTED_TRUTH),
    "log_file": (log_file, _LOG_FILE),
    "dataset_warnings": (dataset_warnings, f"WITH {_LABEL_KEYS}, g AS (SELECT domain, count(DISTINCT doc) AS d, count(*) AS k, count(*) FILTER (labelled) AS l FROM k GROUP BY domain) SELECT domain, 'none_labelled' AS warning FROM g WHERE l = 0 UNION ALL SELECT domain, 'not_all_labelled' FROM g WHERE l < k UNION ALL SELECT domain, 'few_documents' FROM g WHERE d < 10"),
    "name_match": (name_match, _NAME_MATCH),
    "artifact_diff": (artifact_diff, _DIFF),
    "first_nonempty": (first_value, "WITH c AS (SELECT *, CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS value FROM conversations) SELECT conv_id, coalesce(arg_min(value, turn) FILTER (value <> ''), arg_min(value, turn)) AS value FROM c GROUP BY conv_id"),
    "prompt_render": (prompt_render, _PROMPT),
    "markdown_table": (markdown_table, _MARKDOWN),
    "truncation_flag": (truncation_flag, None),
    "raw_contract": (raw_contract, f"WITH {LOG}, {_CANONICAL} SELECT task_key, CASE WHEN ordinal % 4 <> 0 THEN '2024-01-01T00:00:00Z' END AS completed_at, {_FLAT}, input_tokens, error, CASE WHEN ordinal % 2 = 0 THEN said ELSE '' END AS raw_output, CASE WHEN ordinal % 4 = 1 THEN 1 ELSE 0 END AS n_pairs, field_total FROM c"),
    "debug_contract": (debug_contract, f"WITH {LOG}, c AS (SELECT *, concat_ws('::', model_key, domain, document_id, 'run' || CAST(ordinal % 40 AS VARCHAR)) AS k FROM log WHERE ordinal % 5 <> 0 AND ordinal % 19 NOT IN (3, 4) AND NOT (ordinal % 19 = 5 AND ordinal % 4 = 1) QUALIFY row_number() OVER (PARTITION BY k ORDER BY ordinal DESC) = 1) SELECT k AS task_key, CAST(NULL AS VARCHAR) AS completed_at, {_FLAT}, CASE WHEN ordinal % 3 <> 0 THEN input_tokens ELSE 0 END AS input_tokens, error, CASE WHEN ordinal % 2 = 0 THEN task_key ELSE '' END AS raw_output, CASE WHEN ordinal % 4 = 1 THEN 1 ELSE 0 END AS n_pairs, field_total FROM c"),
    "export_summary": (export_summary, f"WITH {LOG}, {_CANONICAL} SELECT 'model' AS kind, upper(model_key) AS name, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'domain', domain, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'records', '', count(*) FROM c UNION ALL SELECT 'errored', '', count(error) FROM c"),
    "canonical_raw": (canonical_raw, f"WITH {LOG}, {_CANONICAL} SELECT task_key, CAST(latency_ms AS DOUBLE) AS latency_ms FROM c"),
    "key_sets": (key_sets, f"WITH {LOG} SELECT task_key, CASE WHEN bool_or(ordinal % 3 = 0) AND bool_or(ordinal % 3 <> 0) THEN 'both' WHEN bool_or(ordinal % 3 = 0) THEN 'left' ELSE 'right' END AS side FROM log GROUP BY task_key"),
    "tree_diff": (tree_diff, _TREE),
    "runner_stub": (runner_stub, "SELECT CAST(doc_id AS VARCHAR) AS task_key, 'p' || doc_id % 4 AS provider, CASE WHEN text <> '' THEN 'second' END AS second, 12 AS input_tokens, CASE WHEN text <> '' THEN NULL ELSE 'empty document' END AS error FROM documents"),
    "pdf_base64": (pdf_base64, _FILES),
    "stream_leaderboard": (stream_leaderboard, _STREAM),
    "stream_progress": (stream_progress, PROGRESS),
    "snapshot_files": (snapshot_files, _SNAPSHOT),
}
