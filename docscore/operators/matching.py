"""Whether an extracted value matches an expected one: typed rules, the first that holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def prepared(value: Column, h: Column | None = None) -> Column:
    """What the rules compare of a value, computed once a value; the forms that only some kinds of keys need
    come from these where they are asked for. ``h``: hints() of its key, if known."""
    company = V.company(value) if h is None else F.when(h["name"], V.company(value))
    return F.struct(
        F.coalesce(value, F.lit("")).alias("raw"), T.strip(value).alias("trim"), T.normalize_text(value).alias("norm"),
        V.dates(value).alias("dates"), V.clock(value).alias("clock"), company.alias("company"),
    )


def _compact(p: Column) -> Column:
    return F.replace(p["norm"], F.lit(" "), F.lit(""))


def hints(name: Column, data_type: Column) -> Column:
    """What kind of value a key's name or type suggests."""
    n, t = T.key_name(name), F.lower(F.coalesce(data_type, F.lit("")))
    says = lambda word: t.contains(word) | n.contains(word)
    return F.struct(
        (says("date") | t.contains("timestamp")).alias("date"), says("time").alias("time"), says("currency").alias("currency"), n.contains("freight terms").alias("freight"),
        n.contains("package type").alias("package"), (n.contains("weight unit") | (n.contains("weight") & t.contains("unit"))).alias("weight"), n.contains("name").alias("name"), n.contains("transport mode").alias("transport"),
    )


def _within(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def _same(a: Column, b: Column) -> Column:
    return (a != "") & (a == b)


def _same_package(a: Column, b: Column) -> Column:
    joined = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return _same(a, b) | _same(joined(a), joined(b))


def is_match(a: Column, e: Column, mode: Column, h: Column) -> Column:
    """``a`` and ``e``: prepared() actual and expected; ``h``: hints(); mode: exact, contains, numeric or normalized_text."""
    day = F.arrays_overlap(a["dates"], e["dates"])
    has_clock = a["clock"].isNotNull() | e["clock"].isNotNull()
    clock = V.same_clock(a["clock"], e["clock"])
    dated = (h["date"] | (F.size(a["dates"]) > 0) | (F.size(e["dates"]) > 0)) & day
    both_clocks = a["clock"].isNotNull() & e["clock"].isNotNull()
    typed = (
        ((h["time"] | has_clock) & clock)
        | (h["currency"] & F.coalesce(V.currency(a["trim"]) == V.currency(e["trim"]), F.lit(False)))
        | (h["freight"] & _within(*(V.words_without(x["norm"], *V.FREIGHT_WORDS) for x in (a, e))))
        | (h["package"] & _same_package(*(V.words_without(x["norm"], *V.PACKAGE_WORDS) for x in (a, e))))
        | (h["weight"] & F.coalesce(V.unit_of(_compact(a)) == V.unit_of(_compact(e)), F.lit(False)))
        | (h["name"] & _same(a["company"], e["company"]))
        | (h["transport"] & _within(*(V.words_without(x["norm"], *V.TRANSPORT_WORDS) for x in (a, e))))
        | (_same(_compact(a), _compact(e)) & a["norm"].rlike("[0-9]"))
    )
    by_mode = (
        F.when(mode == "contains", a["norm"].contains(e["norm"]))
        .when(mode == "numeric", F.coalesce(F.abs(T.numeric(a["raw"]) - T.numeric(e["raw"])) < 1e-6, F.lit(False)))
        .otherwise(a["norm"] == e["norm"])
    )
    return (
        F.when((a["trim"] == "") & (e["trim"] != ""), T.missing(_compact(e)))
        .when(mode == "exact", a["trim"] == e["trim"])
        .when(dated, F.when(both_clocks, clock).otherwise(True))
        .when(typed, True)
        .otherwise(by_mode)
    )


def matches_any(a: Column, expected: Column, mode: Column, h: Column) -> Column:
    """Whether any of an array of prepared expected values matches."""
    return F.exists(expected, lambda e: is_match(a, e, mode, h))


def empty_expectation(value: Column, found: Column) -> Column:
    """Nothing is expected: right if nothing, or a word for nothing, was found."""
    return value.isNull() | ~F.coalesce(found, F.lit(True)) | T.missing_like(value)


def scorable(expected: Column, critical: Column) -> Column:
    """Keys with an expected value, and critical ones, count."""
    return (F.size(F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda v: F.trim(v) != "")) > 0) | critical
