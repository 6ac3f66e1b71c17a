"""JSON values as trees, in column expressions: what a value is, its children in document order,
and walks that go level by level inside of a row, without Python and without a shuffle.

A node is a struct (name, kind, text). Kinds are object, array, string, integer, float, boolean
and null. Inside of a tree every string is marked (an "s" is put behind its first quote), so that
a member's text shows whether it was quoted; text is the string itself without the mark, the
marked JSON of a container (see compact), or a scalar's digits or word (null: null). Of members
that repeat a name the last one counts, in the place of the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

NODE = "struct<name:string,kind:string,text:string>"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
#: Levels of brackets that are counted by taking pairs away.
LEVELS = 8


#: A JSON string; possessive, so that long ones take no stack.
_STRING = r'"((?:[^"\\]++|\\.)*+)"'
_END = "e:end of the value"
_MARKED = r'"s((?:[^"\\]++|\\.)*+)"'


def _node(name: Column, text: Column) -> Column:
    kind = (
        F.when(text.isNull(), "null").when(text.startswith("s"), "string").when(text.startswith("{"), "object").when(text.startswith("["), "array")
        .when(text.isin("true", "false"), "boolean").when(text.rlike("^-?[0-9]+$"), "integer").otherwise("float")
    )
    return F.struct(name.alias("name"), kind.alias("kind"), F.when(text.startswith("s"), F.substring(text, F.lit(2), F.length(text))).otherwise(text).alias("text"))


def elements(text: Column) -> Column:
    """Nodes of a marked array's text, without names; null if it is none."""
    return F.transform(F.from_json(text, "array<string>", _STRICT), lambda t: _node(F.lit(None).cast("string"), t))


def members(text: Column) -> Column:
    """Nodes of a marked object's text; null if it is none."""

    def nodes(m: Column) -> Column:
        each = F.transform(F.map_entries(m), lambda e: _node(F.substring(e["key"], F.lit(2), F.length(e["key"])), e["value"]))
        return let(F.array_distinct(F.map_keys(m)), lambda d: F.when(F.size(d) == F.size(m), each).otherwise(let(each, lambda ns: F.transform(d, lambda k: member(ns, F.substring(k, F.lit(2), F.length(k)))))))

    return let(F.from_json(text, "map<string,string>", _STRICT), lambda m: F.when(m.isNotNull(), nodes(m)))


def fields(text: Column, *names: str) -> Column:
    """Struct of the marked texts of some members of a marked object (null: null or missing), in one reading."""
    return F.from_json(text, "struct<" + ",".join(f"`s{n}`:string" for n in names) + ">", _STRICT)


def field(f: Column, name: str) -> Column:
    """A member of fields() as a node."""
    return _node(F.lit(None).cast("string"), f[f"s{name}"])


def field_text(f: Column, name: str) -> Column:
    """A member of fields() if it is a text, else null."""
    t = f[f"s{name}"]
    return F.when(t.startswith("s"), F.substring(t, F.lit(2), F.length(t)))


def compact(node: Column) -> Column:
    """A node's text, containers as plain JSON without their marks."""
    return F.when(node["kind"].isin("object", "array"), F.regexp_replace(node["text"], _MARKED, '"$1"')).otherwise(node["text"])


def has_member(node: Column, name: str) -> Column:
    """Whether a node is an object with a member of that name."""
    # Most objects without it, and those that begin with it, are told by their text alone.
    listed = node["text"].contains(f'"s{name}":') & F.array_contains(F.json_object_keys(node["text"]), "s" + name)
    return F.coalesce((node["kind"] == "object") & (node["text"].startswith(f'{{"s{name}":') | listed), F.lit(False))


def children(node: Column) -> Column:
    """Children of a node, in order; none of a scalar."""
    kids = F.when(node["kind"] == "object", members(node["text"])).when(node["kind"] == "array", elements(node["text"]))
    return F.coalesce(kids, F.array().cast(f"array<{NODE}>"))


def member(nodes: Column, name: Column | str) -> Column:
    """The last of some nodes that has a name; null if none has."""
    return F.try_element_at(F.filter(nodes, lambda n: n["name"] == (F.lit(name) if isinstance(name, str) else name)), F.lit(-1))


def parsed(text: Column) -> Column:
    """The node of a text that is one JSON value and nothing else; else null. It is read as a list that ends with a
    mark of our own, so what stands behind the value, or closes the list, shows."""
    marked = F.regexp_replace(text, _STRING, '"s$1"')
    listed = F.from_json(F.concat(F.lit("["), marked, F.lit(f',"{_END}"]')), "array<string>", _STRICT)
    return let(listed, lambda a: F.when((F.size(a) == 2) & F.coalesce(F.get(a, F.lit(1)) == _END, F.lit(False)), _node(F.lit(None).cast("string"), F.get(a, F.lit(0)))))


def truthy(node: Column) -> Column:
    """Whether a value counts as true: not missing, null, false, zero or empty."""
    text, kind = node["text"], node["kind"]
    yes = F.when(kind == "boolean", text == "true").when(kind.isin("integer", "float"), text.try_cast("double") != 0).when(kind == "string", text != "")
    return F.coalesce(yes.when(kind == "object", text != "{}").when(kind == "array", text != "[]"), F.lit(False))


def listed_text(node: Column) -> Column:
    """A value as an entry of a list: true and false with a capital, floats with their fraction."""
    kind = node["kind"]
    return F.when(kind == "boolean", F.initcap(node["text"])).when(kind == "float", float_text(node["text"])).otherwise(F.coalesce(compact(node), F.lit("")))


def float_text(text: Column) -> Column:
    """A float as shortest decimal digits, with an exponent below 1e-4 and from 1e16 on, else with a point."""
    d = text.cast("double")
    short = d.cast("string")
    plain = F.regexp_replace(F.regexp_replace(short.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    e = F.regexp_replace(F.regexp_replace(short, r"\.0E", "E"), r"E(-?)([0-9])$", "E$10$2")
    power = F.regexp_replace(F.lower(e), "e([0-9])", "e+$1")
    return F.when((F.abs(d) >= 1e-3) & (F.abs(d) < 1e7), short).when((F.abs(d) >= 1e16) | ((d != 0) & (F.abs(d) < 1e-4)), power).otherwise(plain)


def scalar_text(node: Column) -> Column:
    """A value as text: a whole float without its fraction (17 digits, then zeros, from 9e18 on), null as empty, containers as compact JSON."""
    text, d = node["text"], node["text"].try_cast("double")
    whole = F.when(F.abs(d) < 9e18, d.try_cast("bigint").cast("string")).otherwise(F.format_string("%.0f", d))
    number = F.when(d % 1 == 0, whole).otherwise(float_text(text))
    return F.when(node["kind"] == "float", number).otherwise(F.coalesce(compact(node), F.lit("")))


def depth(text: Column) -> Column:
    """How deep brackets are nested outside of strings; at least 1. An upper bound where the text is no JSON."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++|"', "")
    step = lambda s, c: let(s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0), lambda n: F.struct(n.alias("now"), F.greatest(s["most"], n).alias("most")))
    zero = F.struct(F.lit(0).alias("now"), F.lit(1).alias("most"))
    counted = lambda m: F.aggregate(F.split(m, ""), zero, step, lambda s: s["most"])
    # Each round takes the innermost pairs away; what is left after LEVELS rounds is counted mark by mark.
    shorter = lambda s, i: F.when(s["marks"] == "", s).otherwise(F.struct(F.regexp_replace(s["marks"], r"(?:[\[{][\]}])++", "").alias("marks"), i.alias("rounds")))
    peeled = lambda m: F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.struct(m.alias("marks"), F.lit(1).alias("rounds")), shorter)
    return let(marks, lambda m: let(peeled(m), lambda s: F.when(s["marks"] == "", s["rounds"]).otherwise(counted(m))))


def walked(text: Column, nodes: Column, step: Callable[[Column], Column]) -> Column:
    """The array ``nodes`` unfolded: ``step`` gives what each of them becomes, again and again as deep as the
    text goes. A loop inside of the row, so that no pass over all texts has to find out how deep they are."""
    return F.aggregate(F.sequence(F.lit(1), depth(text)), nodes, lambda ns, _: F.flatten(F.transform(ns, step)))
