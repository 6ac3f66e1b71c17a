"""Typed members of JSON objects: getters that never raise, and records checked against a list of fields.

A field is (name, kind, need). Kinds: text, int, float, bool, any (kept as compact JSON), a tuple
of texts (one of them), a list of fields (a list of such records) or "texts" (a list of texts).
Need: "must" (there and not null), "there" (may be null) or "may" (may be null or missing). Values
are taken as a lenient reader takes them: whole floats, true and false and digits in a text are
integers, and so on; a text is never made of anything else. Integers must fit 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jsontree as T
from .text import let, once

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
#: Texts that mean yes and no.
_YES, _NO = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")


# --- getters on tree nodes -------------------------------------------------------------


def get_member(node: Column, name: str) -> Column:
    """A member of an object's node; null for other nodes and missing members."""
    return T.member(T.members(F.when(node["kind"] == "object", node["text"])), name)


def has_property(node: Column, name: str) -> Column:
    return T.has_member(node, name)


def is_number(node: Column) -> Column:
    """A finite number; true and false are none."""
    d = node["text"].try_cast("double")
    return F.coalesce(node["kind"].isin("integer", "float") & (F.abs(d) != float("inf")), F.lit(False))


def get_string(node: Column, name: str) -> Column:
    """A member if it is a text, else null."""
    return let(get_member(node, name), lambda m: F.when(m["kind"] == "string", m["text"]))


def get_number(node: Column, name: str) -> Column:
    """A member if it is a finite number, else null."""
    return let(get_member(node, name), lambda m: F.when(is_number(m), m["text"].try_cast("double")))


def get_record(node: Column, name: str) -> Column:
    """A member's node if it is an object, else null."""
    return let(get_member(node, name), lambda m: F.when(m["kind"] == "object", m))


def get_array(node: Column, name: str) -> Column:
    """The nodes of a member's list; null if it is none."""
    return let(get_member(node, name), lambda m: T.elements(F.when(m["kind"] == "array", m["text"])))


# --- records ---------------------------------------------------------------------------


def truthy_text(t: Column) -> Column:
    """Whether a member's marked text counts as true."""
    number = F.when(t.rlike("^-?[0-9]"), t.try_cast("double") != 0)
    return F.coalesce(F.when(t.startswith("s"), t != "s").when(t.isin("true", "false"), t == "true").when(t.isin("{}", "[]"), F.lit(False)), number, t.isNotNull())


def _strings(fields: list) -> str:
    return "struct<" + ",".join(f"`s{name}`:string" for name, _, _ in fields) + ">"


def _value(t: Column, kind) -> Column:
    """A member of a kind out of its marked text; null if it can't be one."""
    text = F.when(t.startswith("s"), F.substring(t, F.lit(2), F.length(t)))
    if kind == "text":
        return text
    if isinstance(kind, tuple):
        return F.when(text.isin(*kind), text)
    digits = F.when(text.rlike(r"^\s*[+-]?[0-9]+(\.0*)?\s*$"), F.trim(text))
    number = F.when(t.rlike("^-?[0-9]"), t)
    flag = F.when(t == "true", 1).when(t == "false", 0)
    if kind == "int":
        whole = lambda x: F.coalesce(F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("bigint")), F.when(x.try_cast("double") % 1 == 0, x.try_cast("double").try_cast("bigint")))
        # Most are plain digits; these are told first.
        return F.when(t.rlike("^-?[0-9]{1,18}$"), t.try_cast("bigint")).otherwise(F.coalesce(whole(number), whole(digits), flag.cast("bigint")))
    if kind == "float":
        return F.coalesce(number.try_cast("double"), F.when(text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(text).try_cast("double")), flag.cast("double"))
    if kind == "bool":
        said = F.when(F.lower(text).isin(*_YES), True).when(F.lower(text).isin(*_NO), False)
        of = number.try_cast("double")
        return F.coalesce(F.when(t == "true", True).when(t == "false", False), said, F.when(of == 1, True).when(of == 0, False))
    if kind == "any":
        return F.when(t.startswith("s"), text).otherwise(F.regexp_replace(t, T._MARKED, '"$1"'))
    items = F.from_json(F.when(t.startswith("["), t), "array<string>", _STRICT)
    one = (lambda x: _value(x, "text")) if kind == "texts" else (lambda x: record(x, kind))
    return let(F.transform(items, one), lambda a: F.when(F.forall(a, lambda x: x.isNotNull()), a))


def record(t: Column, fields: list) -> Column:
    """An object's marked text as a struct of its fields; null if a field can't be what it must be."""

    def checked(r: Column, values: Column) -> Column:
        fine = F.lit(True)
        for name, _, need in fields:
            fine = fine & (values[name].isNotNull() if need == "must" else r[f"s{name}"].isNull() | values[name].isNotNull())
        there = [f"s{name}" for name, _, need in fields if need == "there"]
        if there:
            fine = fine & let(F.json_object_keys(t), lambda keys: F.forall(F.array(*(F.lit(n) for n in there)), lambda n: F.array_contains(keys, n)))
        return F.when(F.coalesce(fine, F.lit(False)), values)

    def of(r: Column) -> Column:
        return let(F.struct(*(_value(r[f"s{name}"], kind).alias(name) for name, kind, _ in fields)), lambda values: checked(r, values))

    return let(F.from_json(F.when(t.startswith("{"), t), _strings(fields), _STRICT), of)


def objects(lines: DataFrame, value: str, names: list[str]) -> DataFrame:
    """Lines that are one JSON object: with _o, a struct of the marked texts of the named members (s before each name)."""
    node = once(lines, "_node", T.parsed(F.col(value))).filter("_node.kind = 'object'")
    return once(node, "_o", F.from_json("_node.text", _strings([(n, "", "") for n in names]), _STRICT)).drop("_node")
