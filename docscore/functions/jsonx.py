"""Key and value pairs out of free-text answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsontree as T
from .text import key_name, strip

#: How pairs look in text, and keys in lists.
PAIR = r'\{[^{}]*"key"\s*:\s*"([^"]+)"[^{}]*"value"\s*:\s*"([^"]*)"[^{}]*\}'
LINE = r"""^\s*["']?([^:"']{2,120})["']?\s*:\s*(.+)\s*$"""
FENCE = r"(?si)```(?:json)?\s*(.*?)\s*```"
LISTED = r"""^[-*]?\s*["']?([A-Za-z0-9_\-\s]{2,60})["']?\s*[:\-]"""


def first_json(text: Column) -> Column:
    """The JSON value of an answer as a tree's node: the whole text, else its first fenced block, else from
    the first brace to the last; null if none of them is JSON. The first that is counts, whatever it is."""
    t = strip(text)
    fence = strip(F.regexp_extract(t, FENCE, 1))
    first, last = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
    braces = F.when((first > 0) & (last > first), F.substring(t, first, last - first + 1))
    return F.coalesce(T.parsed(t), T.parsed(fence), T.parsed(braces))


def best_json(text: Column) -> Column:
    """The JSON value of an answer as compact text."""
    return T.let(first_json(text), T.compact)


PAIRS = "array<struct<key:string,value:string,found:boolean>>"


def _asked(names: Column, keys: Column | None) -> Column:
    """Whether a key was asked for, by its normalised name; all are where no keys are named."""
    return F.lit(True) if keys is None else F.array_contains(F.transform(keys, key_name), key_name(names))


def json_pairs(node: Column, keys: Column | None = None) -> Column:
    """Pairs of an object: its "pairs" list and the requested members of its "values" object; without any of
    these its own requested members. Other JSON has none. ``keys``: array of the names that are asked for."""
    none = F.array().cast(PAIRS)
    unknown = F.lit(None).cast("boolean")

    def pair(c: Column) -> Column:
        key = F.coalesce(*(F.when(T.truthy(T.member(c, n)), T.listed_text(T.member(c, n))) for n in ("key", "name", "field")))
        value, found = F.coalesce(*(F.when(T.member(c, n)["kind"] != "null", T.member(c, n)) for n in ("value", "extracted_value"))), T.member(c, "found")
        return F.struct(strip(key).alias("key"), F.coalesce(T.scalar_text(value), F.lit("")).alias("value"), F.when(found["kind"] == "boolean", found["text"] == "true").alias("found"))

    def own(m: Column) -> Column:
        asked = F.filter(m, lambda c: _asked(c["name"], keys))
        return F.transform(asked, lambda c: F.struct(c["name"].alias("key"), T.scalar_text(c).alias("value"), unknown.alias("found")))

    def of(m: Column) -> Column:
        listed, values = T.member(m, "pairs"), T.member(m, "values")
        objects = F.filter(T.elements(F.when(listed["kind"] == "array", listed["text"])), lambda e: e["kind"] == "object")
        from_list = F.filter(F.transform(objects, lambda e: T.let(T.children(e), pair)), lambda p: p["key"] != "")
        from_map = own(T.members(F.when(values["kind"] == "object", values["text"])))
        both = F.concat(F.coalesce(from_list.cast(PAIRS), none), F.coalesce(from_map.cast(PAIRS), none))
        return T.let(both, lambda b: F.when(F.size(b) > 0, b).otherwise(own(m).cast(PAIRS)))

    return F.coalesce(T.let(T.members(F.when(node["kind"] == "object", node["text"])), of), none)


def text_pairs(text: Column, keys: Column | None = None) -> Column:
    """Pairs of plain text: objects with a key and a value, then "key: value" lines with a value; of the
    requested keys alone, under the name that was asked for. The last of each key counts, in the place of
    the first; the found mark is never seen there."""
    row = lambda key, value: F.struct(key_name(key).alias("k"), key.alias("key"), value.alias("value"))
    objects = F.zip_with(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)), row)
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(LINE))
    unquote = lambda c: F.regexp_replace(strip(c), "^[\"']|[\"']$", "")
    rows = F.transform(lines, lambda x: row(strip(F.regexp_extract(x, LINE, 1)), unquote(F.regexp_extract(x, LINE, 2))))
    every = F.concat(objects, F.filter(rows, lambda p: p["value"] != ""))
    name = lambda p: p["key"]
    if keys is not None:
        wanted = F.transform(keys, lambda n: F.struct(key_name(n).alias("k"), n.alias("name")))
        every = T.let(F.transform(wanted, lambda w: w["k"]), lambda ks: F.filter(every, lambda p: F.array_contains(ks, p["k"])))
        name = lambda p: F.element_at(F.filter(wanted, lambda w: w["k"] == p["k"]), -1)["name"]

    def last(e: Column) -> Column:
        ks = F.array_distinct(F.transform(e, lambda p: p["k"]))
        found = F.transform(ks, lambda k: F.element_at(F.filter(e, lambda p: p["k"] == k), -1))
        return F.transform(found, lambda p: F.struct(name(p).alias("key"), p["value"].alias("value"), F.lit(None).cast("boolean").alias("found")))

    return T.let(every, last).cast(PAIRS)


def answers(text: Column, keys: Column | None = None) -> Column:
    """Pairs of an answer: of its JSON if that gives any, else of its text. ``keys``: array of the names that
    are asked for (all count without it)."""
    pairs = T.let(first_json(text), lambda node: json_pairs(node, keys))
    return T.let(pairs, lambda p: F.when(F.size(p) > 0, p).otherwise(text_pairs(F.coalesce(text, F.lit("")), keys)))


def indexed(pairs: Column) -> Column:
    """Map of key name to (value, found): the first of each key, or the first that isn't empty if that is."""
    named = F.transform(pairs, lambda p: F.struct(key_name(p["key"]).alias("k"), strip(p["value"]).alias("value"), F.coalesce(p["found"], F.lit(True)).alias("found")))
    names = F.array_distinct(F.transform(named, lambda p: p["k"]))

    def best(name: Column) -> Column:
        own = F.filter(named, lambda p: p["k"] == name)
        return F.coalesce(F.get(F.filter(own, lambda p: p["value"] != ""), F.lit(0)), F.get(own, F.lit(0)))

    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.struct(best(n)["value"].alias("value"), best(n)["found"].alias("found")))))


def distinct_keys(text: Column, most: int = 50) -> Column:
    """Fallback list of keys that lines begin with, as in lists, in order, at most ``most``."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: strip(F.regexp_extract(strip(x), LISTED, 1)))
    return F.slice(F.array_distinct(F.filter(lines, lambda k: k != "")), 1, most)
