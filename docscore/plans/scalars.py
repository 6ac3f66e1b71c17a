"""Queries over the normalisers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounding as R
from ..functions import text as T
from ..functions import values as V
from .adapters import table


def sql_fold(x: str) -> str:
    return f"translate({x}, '{T.LOOKALIKES}', '{T.ASCII_FORMS}')"


_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{_WS}+|{_WS}+$', '', 'g')"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({sql_strip(sql_fold(f'coalesce({x}, {chr(39) * 2})'))})), '[^a-z0-9]+', ' ', 'g'))"


def sql_compact(x: str) -> str:
    return f"replace({sql_norm(x)}, ' ', '')"


def sql_key(x: str) -> str:
    return f"regexp_replace(lower({sql_strip(x)}), '[^a-z0-9]+', ' ', 'g')"


def sql_without(x: str, *tokens: str) -> str:
    words = ", ".join(f"'{t}'" for t in ("", *tokens))
    return f"array_to_string(list_filter(string_split({sql_norm(x)}, ' '), lambda t: t NOT IN ({words})), ' ')"


def sql_in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def sql_missing(x: str) -> str:
    return f"({sql_compact(x)} = '' OR {sql_compact(x)} IN {sql_in(T.MISSING)})"


def sql_company(x: str) -> str:
    a = rf"regexp_replace({x}, '\bcare\s+of\b', ' ', 'gi')"
    b = rf"regexp_replace({a}, '\bc\s*/?\s*o\b', ' ', 'gi')"
    c = rf"regexp_replace({b}, '\ba\s*[/.]?\s*s\b', 'as', 'gi')"
    return f"trim(regexp_replace({sql_norm(c)}, '((^| )({'|'.join(V.LEGAL_FORMS)}))+$', ''))"


def sql_weight(x: str) -> str:
    when = " ".join(f"WHEN {sql_compact(x)} IN {sql_in(s)} THEN '{u}'" for u, s in V.WEIGHT_UNITS.items())
    return f"CASE WHEN {sql_compact(x)} = '' THEN NULL {when} ELSE {sql_compact(x)} END"


def sql_currency(x: str) -> str:
    t = sql_strip(x)
    parts = [f"WHEN {t} = '' THEN NULL", f"WHEN upper({t}) IN {sql_in(V.CURRENCY_CODES)} THEN upper({t})"]
    parts += [f"WHEN {t} = '{s}' OR upper({t}) = '{s.upper()}' THEN '{c}'" for s, c in V.CURRENCY_SYMBOLS]
    parts += [f"WHEN contains(upper({t}), '{c}') THEN '{c}'" for c in V.CURRENCY_CODES]
    parts += [f"WHEN contains({t}, '{s}') THEN '{c}'" for s, c in V.CURRENCY_SYMBOLS]
    return "CASE " + " ".join(parts) + " END"


def sql_number(x: str) -> str:
    return rf"try_cast(regexp_replace(replace(regexp_replace(coalesce({x}, ''), '{_WS}+', '', 'g'), ',', '.'), '[^0-9.-]', '', 'g') AS DOUBLE)"


def sql_day(y: str, m: str, d: str) -> str:
    year = f"(CASE WHEN try_cast({y} AS INT) < 100 THEN try_cast({y} AS INT) + 2000 ELSE try_cast({y} AS INT) END)"
    return f"CASE WHEN {m} <> '' AND {d} <> '' THEN strftime(try_cast(lpad(CAST({year} AS VARCHAR), 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE), '%Y-%m-%d') END"


def sql_dates(x: str) -> str:
    t = sql_strip(x)
    g = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    y, n = V._YMD, V._DMY
    iso = rf"CASE WHEN regexp_full_match({t}, '[0-9]{{8}}') THEN strftime(try_strptime({t}, '%Y%m%d'), '%Y-%m-%d') WHEN regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9:]+)?') THEN strftime(try_cast({t} AS TIMESTAMP), '%Y-%m-%d') END"
    return f"list_distinct(list_filter([{sql_day(g(y, 1), g(y, 2), g(y, 3))}, {sql_day(g(n, 3), g(n, 2), g(n, 1))}, {sql_day(g(n, 3), g(n, 1), g(n, 2))}, {iso}], lambda d: d IS NOT NULL))"


#: Names with look-alikes, care-of and legal forms; the same list on both sides of every comparison.
def _names(spark, d):
    k = F.col("s_suppkey")
    forms = F.array(*(F.lit(x) for x in ("Inc.", "GmbH & Co", "A/S", "Ltd", "c/o Widget B.V.", "S.A.", "", "Αcme Limited")))
    return table(spark, d, "supplier").select(k, F.concat_ws(" ", F.lit("Café"), "s_name", F.get(forms, k % 8)).alias("v"))


_NAMES = "n AS (SELECT s_suppkey, concat_ws(' ', 'Café', s_name, ['Inc.', 'GmbH & Co', 'A/S', 'Ltd', 'c/o Widget B.V.', 'S.A.', '', 'Αcme Limited'][s_suppkey % 8 + 1]) AS v FROM supplier)"
_TERMS = ("Freight Prepaid", "freight terms: COLLECT", "Prepaid term", "STC 12 Cartons", "cartons stc", " Pallet ", "", "Term")
_UNITS = ("KG", "kgs.", "Gram", "LBS", "pounds", "Tonnes", "m t", "", "boxes", "кg")
_MONEY = ("usd", "US$", "€ 12.50", "12,00 EUR", "kr 100", "zł", "A$5", "", "none", "CHF", "100 $", "R$ 9", "12 xyz")
_MISS = ("N/A", "none", "--", "", "not stated", "Unknown", "nil", "value", "  ", "N.V.D.")


def _pick(words, k):
    return F.get(F.array(*(F.lit(w) for w in words)), k % len(words))


def _sql_pick(words, k):
    return f"[{', '.join(chr(39) + w + chr(39) for w in words)}][{k} % {len(words)} + 1]"


def _from_part(words, **out):
    def q(spark, d):
        v = _pick(words, F.col("p_partkey"))
        return table(spark, d, "part").select("p_partkey", *(f(v).alias(n) for n, f in out.items()))

    return q


def _sql_part(words, **out):
    v = _sql_pick(words, "p_partkey")
    return f"SELECT p_partkey, {', '.join(f'{f('v')} AS {n}' for n, f in out.items())} FROM (SELECT p_partkey, {v} AS v FROM part)"


_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM.dd.yy", "yyyyMMdd", "'on' d-M-yyyy 'at noon'", "yyyy/M/d HH:mm")
_STRF = ("%Y-%m-%d", "%d/%m/%Y", "%m.%d.%y", "%Y%m%d", "on %-d-%-m-%Y at noon", "%Y/%-m/%-d %H:%M")


def _order_dates(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 6 == 0, F.date_format(day, _FORMATS[0]))
    for i, f in enumerate(_FORMATS[1:], 1):
        text = text.when(k % 6 == i, F.date_format(day, f))
    return table(spark, d, "orders").select("o_orderkey", text.alias("v"), F.date_format(day, "yyyy-MM-dd").alias("iso"))


_ORDER_DATES = f"o AS (SELECT o_orderkey, CASE o_orderkey % 6 {' '.join(f'WHEN {i} THEN strftime(o_orderdate, {chr(39)}{f}{chr(39)})' for i, f in enumerate(_STRF))} END AS v, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)"


def date_candidates(spark, d):
    return _order_dates(spark, d).select("o_orderkey", F.array_join(F.array_sort(V.dates(F.col("v"))), ",").alias("days"))


def date_equiv(spark, d):
    return _order_dates(spark, d).select("o_orderkey", F.arrays_overlap(V.dates(F.col("v")), V.dates(F.col("iso"))).alias("same"))


def _event_times(spark, d):
    k, t = F.col("event_id"), F.col("ts").cast("timestamp")
    half = F.when(F.hour(t) >= 12, "p.m.").otherwise("AM")
    h12 = F.when(F.hour(t) % 12 == 0, 12).otherwise(F.hour(t) % 12)
    v = F.when(k % 4 == 0, F.date_format(t, "HH:mm:ss")).when(k % 4 == 1, F.concat(h12.cast("string"), F.lit(":"), F.date_format(t, "mm"), F.lit(" "), half)).when(k % 4 == 2, F.concat(F.lit("at "), F.date_format(t, "H:mm"))).otherwise(F.concat(F.date_format(t, "mm"), F.lit(":77")))
    return table(spark, d, "events").select("event_id", v.alias("v"))


def time_parse(spark, d):
    c = V.clock(F.col("v"))
    return _event_times(spark, d).select("event_id", c["h"].alias("h"), c["m"].alias("m"), c["s"].alias("s"), c["has_s"].alias("has_s"))


_HALF = "CASE WHEN hour(ts) >= 12 THEN 'p.m.' ELSE 'AM' END"
_TIMES = f"""e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%H:%M:%S') WHEN 1 THEN CAST(CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END AS VARCHAR) || ':' || strftime(ts, '%M') || ' ' || {_HALF}
  WHEN 2 THEN 'at ' || CAST(hour(ts) AS VARCHAR) || ':' || strftime(ts, '%M') ELSE strftime(ts, '%M') || ':77' END AS v FROM events),
g AS (SELECT event_id, {', '.join(f"regexp_extract(v, '([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?\\s*([aApP]\\.?[mM]\\.?)?', {i}) AS g{i}" for i in (1, 2, 3, 4))} FROM e),
p AS (SELECT event_id, try_cast(g2 AS INT) AS m, coalesce(try_cast(g3 AS INT), 0) AS s, g3 <> '' AS has_s, CASE WHEN replace(lower(g4), '.', '') = 'pm' AND try_cast(g1 AS INT) < 12 THEN try_cast(g1 AS INT) + 12 WHEN replace(lower(g4), '.', '') = 'am' AND try_cast(g1 AS INT) = 12 THEN 0 ELSE try_cast(g1 AS INT) END AS h FROM g)
SELECT event_id, CASE WHEN ok THEN h END AS h, CASE WHEN ok THEN m END AS m, CASE WHEN ok THEN s END AS s, CASE WHEN ok THEN has_s END AS has_s FROM (SELECT *, coalesce(m BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59 AND h BETWEEN 0 AND 23, false) AS ok FROM p)"""

_NUM = ("1,5", "1 234.50", "-7", "12.34.56", "EUR 99", "", "1-2", "x", "0,25 kg")


def numeric_parse(spark, d):
    k = F.col("o_orderkey")
    v = F.when(k % 10 == 9, F.concat(F.lit("$ "), F.col("o_custkey").cast("string"), F.lit(",25"))).otherwise(_pick(_NUM, k))
    return table(spark, d, "orders").select("o_orderkey", T.numeric(v).alias("number"))


def _texts(f):
    def q(spark, d):
        docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
        turns = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text")
        return docs.unionByName(turns).select("id", F.sha2(f(F.col("text")), 256).alias("digest"), F.length(f(F.col("text"))).cast("long").alias("n"))

    return q


def _sql_texts(f):
    return f"WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations), x AS (SELECT id, {f('text')} AS v FROM t) SELECT id, sha256(v) AS digest, length(v) AS n FROM x"


def task_key_project(spark, d):
    from .adapters import log

    r = log(spark, d)
    stamp = F.regexp_replace(F.concat(F.lit("run-"), F.date_format(F.timestamp_seconds(F.col("ordinal") % 100000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), "[:.]", "-")
    return r.filter("ordinal < 10000000000").select("ordinal", "task_key", F.sha2(F.concat_ws("\n", "model_key", "domain", "document_id"), 256).alias("cache_key"), stamp.alias("benchmark_id"))


def _task_key_sql() -> str:
    from .adapters import LOG

    return f"WITH {LOG} SELECT ordinal, task_key, sha256(model_key || chr(10) || domain || chr(10) || document_id) AS cache_key, 'run-' || strftime(epoch_ms(CAST(ordinal % 100000 * 1000 AS BIGINT)), '%Y-%m-%dT%H-%M-%S-000Z') AS benchmark_id FROM log0"


#: Times of the orders in several forms; every other one is no time, or none.
def cache_expiry(spark, d):
    k, at = F.col("o_orderkey"), lambda form: F.date_format("o_orderdate", form)
    forms = F.array(at("yyyy-MM-dd'T'HH:mm:ss'.125Z'"), F.lit("soon"), at("yyyy-MM-dd'T'HH:mm:ss'+02:00'"), F.lit(None), at("yyyy-MM-dd"), F.lit(""), at("yyyy-MM-dd HH:mm"), at("yyyy-MM"))
    return table(spark, d, "orders").select("o_orderkey", V.expiry_millis(F.get(forms, k % 8), F.lit(1_700_000_000_000)).alias("expires_ms"))


_EXPIRY_SQL = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN epoch_ms(o_orderdate) + 125 WHEN 2 THEN epoch_ms(o_orderdate) - 7200000
WHEN 4 THEN epoch_ms(date_trunc('day', o_orderdate)) WHEN 6 THEN epoch_ms(date_trunc('minute', o_orderdate)) ELSE 1700000600000 END AS expires_ms FROM orders"""


def page_costs(spark, d):
    pages, annotated = F.col("o_custkey") % 9 - 1, F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").select("o_orderkey", R.page_cost(pages, annotated).alias("usd"), R.round6(F.col("o_totalprice") / 7).alias("share"))


_PAGE_SQL = "SELECT o_orderkey, greatest(o_custkey % 9 - 1, 0) * CAST(CASE WHEN o_orderstatus = 'F' THEN 0.003 ELSE 0.002 END AS DOUBLE) AS usd, round_even(o_totalprice / 7 * 1e6, 0) / 1e6 AS share FROM orders"

QUERIES = {
    "cache_expiry": (cache_expiry, _EXPIRY_SQL),
    "page_costs": (page_costs, _PAGE_SQL),
    "normalize_text": (_texts(T.normalize_text), _sql_texts(sql_norm)),
    "compact_alnum": (_texts(T.compact), _sql_texts(sql_compact)),
    "key_name": (_texts(T.key_name), _sql_texts(sql_key)),
    "company_name": (lambda s, d: _names(s, d).select("s_suppkey", V.company(F.col("v")).alias("name")), f"WITH {_NAMES} SELECT s_suppkey, {sql_company('v')} AS name FROM n"),
    "freight_terms": (_from_part(_TERMS, freight=V.freight_terms), _sql_part(_TERMS, freight=lambda v: sql_without(v, "freight", "term", "terms"))),
    "package_type": (_from_part(_TERMS, package=V.package_type), _sql_part(_TERMS, package=lambda v: sql_without(v, "stc"))),
    "weight_unit": (_from_part(_UNITS, unit=V.weight_unit), _sql_part(_UNITS, unit=sql_weight)),
    "currency_code": (_from_part(_MONEY, code=V.currency), _sql_part(_MONEY, code=sql_currency)),
    "missing_like": (_from_part(_MISS, missing=T.missing_like), _sql_part(_MISS, missing=sql_missing)),
    "numeric_parse": (numeric_parse, f"SELECT o_orderkey, {sql_number('v')} AS number FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN '$ ' || o_custkey || ',25' ELSE {_sql_pick(_NUM, 'o_orderkey')} END AS v FROM orders)"),
    "date_candidates": (date_candidates, f"WITH {_ORDER_DATES} SELECT o_orderkey, array_to_string(list_sort({sql_dates('v')}), ',') AS days FROM o"),
    "date_equiv": (date_equiv, f"WITH {_ORDER_DATES} SELECT o_orderkey, list_has_any({sql_dates('v')}, {sql_dates('iso')}) AS same FROM o"),
    "time_parse": (time_parse, f"WITH {_TIMES}"),
    "task_key_project": (task_key_project, _task_key_sql()),
}
