"""Ground-truth documents (nested JSON) flattened to keys.

Documents are walked inside of their rows, level by level, with column expressions: no Python and
no shuffle. Where many are walked (label_summary, read_keys, key_names), Python's reader does it in
Arrow batches, and the expressions what it refuses. A text that is null or no JSON gives no keys
and no nodes, and a row of rejected().
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ..functions import jsontree as T
from ..functions.text import strip

MODES = ("exact", "normalized_text", "contains", "numeric")
_STATE = "array<struct<name:string,path:array<string>,mode:string,kind:string,text:string>>"


def _state(name: Column, path: Column, mode: Column, node: Column) -> Column:
    return F.struct(name.alias("name"), path.alias("path"), mode.alias("mode"), node["kind"].alias("kind"), node["text"].alias("text"))


def _unfolded(docs: DataFrame, mode, legacy: bool = False, paths: bool = False) -> DataFrame:
    """``docs``: json. With _root, the parsed text, and _nodes: what the walk from it ends at. ``mode(parent,
    child)`` says what a child is: "value" (a value object) and "leaf" stay, null goes, others are walked on.
    Without ``legacy`` documents in the old schema are not walked, without ``paths`` paths stay empty."""
    root = T.parsed(F.col("json"))
    docs = docs.withColumn("_root", root)
    fine = (F.col("_root.kind") == "object") & (F.lit(legacy) | ~old_schema(F.col("_root")))
    first = F.array(_state(F.lit("").cast("string"), F.array().cast("array<string>"), F.lit("object"), F.col("_root")))

    def step(n: Column) -> Column:
        own = lambda c: F.coalesce(c["name"], n["name"])  # noqa: E731 - what is in a list has the list's name
        path = lambda c, i: F.concat(n["path"], F.array(F.coalesce(c["name"], (i + 1).cast("string")))) if paths else n["path"]
        kids = F.transform(T.children(n), lambda c, i: _state(own(c), path(c, i), mode(n, c), c))
        return F.when(n["mode"].isin("value", "leaf"), F.array(n)).otherwise(F.filter(kids, lambda c: c["mode"].isNotNull()))

    return docs.withColumn("_nodes", F.when(F.coalesce(fine, F.lit(False)), T.walked(F.col("json"), first, step)).otherwise(F.array().cast(_STATE)))


def old_schema(root: Column) -> Column:
    """A list of keys, which is not read any more."""
    return F.coalesce((root["kind"] == "object") & root["text"].contains('"skeys":') & T.fields(root["text"], "keys")["skeys"].startswith("["), F.lit(False))


def _leaf_mode(n: Column, c: Column) -> Column:
    """Bare values count in the items of lists, in lists there and in lists only."""
    kind = c["kind"]
    in_item = F.when(kind == "object", "object").when(kind == "array", "row").otherwise("leaf")
    plain = F.when(kind == "object", "object").when(kind == "array", "list")
    by = F.when(n["mode"] == "list", F.when(kind == "object", "item").otherwise("leaf")).when(n["mode"] == "item", in_item).otherwise(plain)
    return F.when(n["mode"] == "row", "leaf").when(T.has_member(c, "value"), "value").otherwise(by)


def expected(v: Column) -> Column:
    """Expected texts of a value: none for null and blanks; of a list those that aren't blank."""
    many = F.filter(F.transform(T.elements(v["text"]), lambda e: strip(T.listed_text(e))), lambda t: t != "")
    one = strip(T.scalar_text(v))
    return F.when(v["kind"] == "array", many).when(one != "", F.array(one)).otherwise(F.array().cast("array<string>"))


def _mode_of(data_type: Column) -> Column:
    return F.when(F.lower(strip(data_type)).isin("float", "integer", "number"), "numeric").otherwise("normalized_text")


def _leaves(rows: DataFrame) -> DataFrame:
    """``rows``: n, a value object or a bare value. With critical, expected, data_type, match and notes. In steps, so
    that each is compiled and what it gives is there for the next."""
    f = F.when(F.col("n.mode") == "value", T.fields(F.col("n.text"), "value", "critical", "type", "match", "notes"))
    rows = rows.withColumn("_f", f).withColumn("_v", F.when(F.col("n.mode") == "value", T.field(F.col("_f"), "value")).otherwise(F.struct(F.lit(None).cast("string").alias("name"), "n.kind", "n.text")))
    kind, held = F.col("_v.kind"), F.col("n.mode") == "value"
    day = (kind == "string") & F.col("_v.text").contains("-") & strip(F.col("_v.text")).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    bare = F.when(day, "date").when(kind.isin("string", "boolean", "integer", "float"), kind)
    rows = rows.withColumn("data_type", F.when(held, T.field_text(F.col("_f"), "type")).otherwise(bare)).withColumn("_said", F.when(held, F.lower(strip(T.field_text(F.col("_f"), "match")))))
    match = F.when(F.col("_said").isin(*MODES), F.col("_said")).otherwise(_mode_of(F.col("data_type")))
    critical = F.when(held, T.truthy(T.field(F.col("_f"), "critical"))).otherwise(False)
    return rows.select("*", critical.alias("critical"), expected(F.col("_v")).alias("expected"), match.alias("match"), T.field_text(F.col("_f"), "notes").alias("notes")).drop("_f", "_v", "_said")


def _repeated(texts: Column) -> Column:
    """Texts that an array holds more than once, by sorting."""
    return T.let(F.sort_array(texts), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))


def _preferred(leaves: Column) -> Column:
    """A leaf's own name if no other leaf of the document has it, else its path."""
    names = F.sort_array(F.transform(leaves, lambda x, i: F.struct(x["name"].alias("name"), i.alias("i"))))
    same = lambda s, x, i: F.coalesce(F.get(s, i)["name"] == x["name"], F.lit(False))
    shared = T.let(names, lambda s: F.sort_array(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (same(s, x, i - 1) | same(s, x, i + 1)).alias("shared")))))
    return T.let(shared, lambda s: F.transform(leaves, lambda x, i: F.when(F.get(s, i)["shared"], F.array_join(x["path"], "_")).otherwise(x["name"])))


def _probed(names: Column) -> Column:
    """Names with _2, _3 ... behind those that an earlier one took, the first that is free. Only names that
    are some repeated name but for numbers at their end can meet, so only these are gone through."""
    base = lambda t: F.regexp_replace(t, "(_[0-9]+)+$", "")
    empty = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        name = x["name"]
        before = F.size(F.filter(s["asked"], lambda t: t == name))  # these took the name itself and the first numbers
        others = F.size(F.filter(s["taken"], lambda t: t.startswith(F.concat(name, F.lit("_")))))
        tries = F.transform(F.sequence(before + 1, before + 2 + others), lambda k: F.when(k == 1, name).otherwise(F.concat(name, F.lit("_"), k.cast("string"))))
        free = F.get(F.filter(tries, lambda t: ~F.array_contains(s["taken"], t)), F.lit(0))
        return F.struct(F.concat(s["taken"], F.array(free)).alias("taken"), F.concat(s["asked"], F.array(name)).alias("asked"))

    def probe(repeated: Column) -> Column:
        bases = F.transform(repeated, base)
        some = F.filter(F.transform(names, lambda t, i: F.struct(i.alias("i"), t.alias("name"))), lambda x: F.array_contains(bases, base(x["name"])))
        return T.let(some, lambda s: T.let(F.aggregate(s, F.struct(empty.alias("taken"), empty.alias("asked")), step, lambda x: x["taken"]), lambda taken: T.let(F.transform(s, lambda x: x["i"]), lambda at: F.transform(names, lambda t, i: F.coalesce(F.get(taken, F.array_position(at, i).cast("int") - 1), t)))))

    return T.let(_repeated(names), lambda r: F.when(F.size(r) == 0, names).otherwise(probe(r)))


def _named(docs: DataFrame) -> DataFrame:
    """``docs``: json. With _nodes, the leaves, and _names, the name of each."""
    some, none = F.size("_nodes") > 0, F.array().cast("array<string>")
    found = _unfolded(docs, _leaf_mode, paths=True).withColumn("_wanted", F.when(some, _preferred(F.col("_nodes"))).otherwise(none))
    return found.withColumn("_names", F.when(some, _probed(F.col("_wanted"))).otherwise(none))


def _key_rows(docs: DataFrame, *more: str) -> DataFrame:
    """``docs``: json. A row for each key with ``more`` of the document's columns, or one with nulls of a document without."""
    named = F.arrays_zip(F.col("_nodes").alias("n"), F.col("_names").alias("name"))
    # Outer, as what an inner one requires of the array would be looked for by a second walk.
    rows = _named(docs).select(*more, F.posexplode_outer(F.filter(named, lambda x: strip(x["name"]) != "")).alias("at", "k"))
    return _leaves(rows.select(*more, (F.col("at") + 1).cast("long").alias("ordinal"), "k.name", "k.n"))


def keys(docs: DataFrame) -> DataFrame:
    """``docs``: doc, json. Keys of ground truth: doc, ordinal, name, critical, expected, data_type, match, notes.

    A leaf's name is its own if no other leaf of the document has it, else its path; a name that
    an earlier leaf took gets _2, _3 ..., the first that is free. Documents in the old schema, or
    that are no JSON objects, give no keys (see rejected)."""
    return _key_rows(docs.select("doc", "json"), "doc").filter("ordinal is not null").select("doc", "ordinal", *_KEY)


_KEY = ("name", "critical", "expected", "data_type", "match", "notes")
_PLAIN, _ITEM, _LIST, _ROW = range(4)  # members of objects and of the items of lists, entries of lists and of lists in items
_KINDS = {str: "string", bool: "boolean", int: "integer", float: "float"}
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
_flat = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def _constant(name: str) -> None:
    raise ValueError(name)


_EXACT = json.JSONDecoder(parse_constant=_constant)


def named_leaves(text: bytes | None) -> list[tuple[str, object, bool]]:
    """Keys of a text as keys() has them, in order: name, node, and whether that is a value object. Raises what
    REFUSED lists where Python's reader can't read the text."""
    root = _EXACT.decode(text.decode()) if text is not None else None
    if text is not None and (b"\\ud" in text or b"\\uD" in text):
        _flat(root).encode()  # half of a pair is no text
    if type(root) is not dict or type(root.get("keys")) is list:
        return []
    todo = [("", k, k, v, _PLAIN) for k, v in reversed(root.items())]
    found = []
    while todo:
        path, at, name, node, where = todo.pop()
        kind = type(node)
        if kind is dict and where != _ROW:
            if "value" in node:
                found.append((path, at, name, node, True))
            else:
                path, below = f"{path}{at}_", _ITEM if where == _LIST else _PLAIN
                todo += [(path, k, k, v, below) for k, v in reversed(node.items())]
        elif kind is list and where <= _ITEM:
            path, below = f"{path}{at}_", _ROW if where == _ITEM else _LIST
            todo += [(path, str(i), name, node[i - 1], below) for i in range(len(node), 0, -1)]
        elif where != _PLAIN:
            found.append((path, at, name, node, False))
    names = [x[2] for x in found]
    if len(set(names)) < len(names):
        count = Counter(names)
        names = [name if count[name] == 1 else path + at for path, at, name, _, _ in found]
        if len(set(names)) < len(names):
            names = _free(names)
    return [(name, x[3], x[4]) for name, x in zip(names, found, strict=True) if name and not name.isspace()]


def _free(names: list[str]) -> list[str]:
    """Names with _2, _3 ... behind those that an earlier one took, the first that is free."""
    taken: dict[str, None] = {}
    number: dict[str, int] = {}
    for wanted in names:
        name, n = wanted, number.get(wanted, 2)
        while name in taken:
            name, n = f"{wanted}_{n}", n + 1
        number[wanted] = n
        taken[name] = None
    return list(taken)


def kind_of(node: object, held: bool) -> str | None:
    """The type that a value object states, or that of a bare value."""
    if held:
        said = node.get("type")
        return said if type(said) is str else None
    return "date" if type(node) is str and "-" in node and _DAY.fullmatch(node.strip()) else _KINDS.get(type(node))


def _expected(v: object) -> tuple[str, ...]:
    """expected() of a value."""
    kind = type(v)
    if kind is list:
        texts = ["" if e is None else _flat(e) if type(e) in (dict, list) else str(e).strip() for e in v]
        return tuple(t for t in texts if t)
    if kind is float:
        return (str(int(v) if v.is_integer() else v),)
    text = "" if v is None else v.strip() if kind is str else str(v) if kind is int else _flat(v)
    return (text,) if text else ()


def _key(name: str, node: object, held: bool) -> tuple:
    """A key's members in the order of _KEY."""
    kind, said = kind_of(node, held), node.get("match") if held else None
    match = said.strip().lower() if type(said) is str else None
    if match not in MODES:
        match = "numeric" if kind is not None and kind.strip().lower() in ("float", "integer", "number") else "normalized_text"
    if not held:
        return name, False, _expected(node), kind, match, None
    notes = node.get("notes")
    return name, bool(node.get("critical")), _expected(node["value"]), kind, match, notes if type(notes) is str else None


#: What Python's reader and writer raise on texts that they don't take: no JSON, no UTF-8, too deep, too many digits.
REFUSED = (ValueError, RecursionError)


def listed(texts: pa.Array, put: Callable[[list[tuple[str, object, bool]]], None]) -> tuple[pa.Array, pa.Array]:
    """Gives the keys of each text to ``put``, which raises before it takes any or takes all. Where each text's begin, and which texts are refused."""
    begin, refused = [0], []
    for text in texts.cast(pa.binary()).to_pylist():  # bytes, as a text may be no UTF-8
        try:
            put(found := named_leaves(text))
        except REFUSED:
            found = None
        begin.append(begin[-1] + len(found or ()))
        refused.append(found is None)
    return pa.array(begin, pa.int32()), pa.array(refused, pa.bool_())


def text_lists(texts: pa.Array, one: Callable[[str, object, bool], str]) -> pa.Array:
    """``one`` of each key of each text, null where the text is refused."""
    all_: list[str] = []
    begin, refused = listed(texts, lambda found: all_.extend([one(*x) for x in found]))
    return pa.ListArray.from_arrays(begin, pa.array(all_, pa.string()), mask=refused)


@F.arrow_udf(ArrayType(StringType()))
def _name_lists(texts: pa.Array) -> pa.Array:
    return text_lists(texts, lambda name, *_: name)


@F.arrow_udf(ArrayType(StructType([StructField(c, BooleanType() if c == "critical" else ArrayType(StringType()) if c == "expected" else StringType()) for c in _KEY])))
def _key_lists(texts: pa.Array) -> pa.Array:
    columns: list[list] = [[] for _ in _KEY]

    def put(found: list) -> None:
        # By columns, as millions of rows that are kept would be gone through again and again for garbage.
        for column, more in zip(columns, zip(*[_key(*x) for x in found], strict=True), strict=False):
            column += more

    begin, refused = listed(texts, put)
    kinds = {"critical": pa.bool_(), "expected": pa.list_(pa.string())}
    arrays = [pa.array(v, kinds.get(c, pa.string())) for c, v in zip(_KEY, columns, strict=True)]
    return pa.ListArray.from_arrays(begin, pa.StructArray.from_arrays(arrays, list(_KEY)), mask=refused)


def rest(read: DataFrame, name: str) -> DataFrame:
    """``read``: doc, json and ``name``, what was read of it (null: refused). A row for each key of what was refused, by
    expressions, and one with an ordinal of null for any other document."""
    return _key_rows(read.select("doc", name, F.when(F.col(name).isNull(), F.col("json")).alias("json")), "doc", name)


def key_names(docs: DataFrame) -> DataFrame:
    """``docs``: doc, json. The names of each one's keys in order, in a list: doc, names."""
    read = docs.select("doc", "json", _name_lists("json").alias("_r"))
    named = _named(read.select("doc", "_r", F.when(F.col("_r").isNull(), F.col("json")).alias("json")))
    return named.select("doc", F.coalesce("_r", F.filter("_names", lambda t: strip(t) != "")).alias("names"))


def read_keys(docs: DataFrame) -> DataFrame:
    """keys() by Python's reader, in Arrow batches; what that refuses is walked in expressions, so no key is lost."""
    rows = rest(docs.select("doc", "json", _key_lists("json").alias("_r")), "_r").select("*", F.posexplode_outer("_r").alias("_at", "_k"))
    read = F.col("_at").isNotNull()
    rows = rows.filter(read | F.col("ordinal").isNotNull())
    ordinal = F.when(read, (F.col("_at") + 1).cast("long")).otherwise(F.col("ordinal"))
    return rows.select("doc", ordinal.alias("ordinal"), *(F.when(read, F.col("_k")[c]).otherwise(F.col(c)).alias(c) for c in _KEY))


def _node_mode(lists: bool):
    def mode(n: Column, c: Column) -> Column:
        below = F.when(T.has_member(c, "value"), "value").when(c["kind"] == "object", "object")
        below = below.when(c["kind"] == "array", "list") if lists else below
        return F.when(n["mode"] == "list", F.when(c["kind"] == "object", "object")).otherwise(below)

    return mode


def value_nodes(docs: DataFrame, lists: bool = True) -> DataFrame:
    """``docs``: doc, json. Raw value objects, through objects and, with ``lists``, lists of objects: doc, key,
    critical, and whether each is labelled by three rules: text (a text or list that isn't blank), plain (or
    a number or boolean), any (or a list or object that isn't empty)."""
    # Outer, as what an inner one requires of the array would be looked for by a second walk.
    rows = _unfolded(docs.select("doc", "json"), _node_mode(lists), legacy=True).select("doc", F.explode_outer("_nodes").alias("n"))
    return _labelled(rows.filter("n is not null"), "doc", F.col("n.name").alias("key"))


def _labelled(rows: DataFrame, *more: str | Column) -> DataFrame:
    """``rows``: n, a value object (or null: neither critical nor labelled). With critical and the three rules."""
    m = rows.select(*more, T.fields(F.col("n.text"), "value", "critical").alias("_m"))
    own = m.columns[:-1]
    v = m.select(*own, T.truthy(T.field(F.col("_m"), "critical")).alias("critical"), T.field(F.col("_m"), "value").alias("v"))
    kind = F.col("v.kind")
    filled = F.exists(T.elements(F.col("v.text")), lambda e: T.truthy(e) & (strip(e["text"]) != ""))
    text = F.coalesce(F.when(kind == "string", strip(F.col("v.text")) != "").when(kind == "array", filled), F.lit(False))
    plain = text | kind.isin("boolean", "integer", "float")
    return v.select(*own, "critical", text.alias("labelled_text"), plain.alias("labelled_plain"), (plain | (kind.isin("array", "object") & T.truthy(F.col("v")))).alias("labelled_any"))


def raw_summary(docs: DataFrame) -> DataFrame:
    """``docs``: domain, json. By domain: documents, and value objects: all, labelled (plain), critical and both, in
    one walk: a document's first row, or its only one if it has none, stands for it, and only sums of domains meet."""
    rows = _unfolded(docs.select("domain", "json"), _node_mode(True), legacy=True).select("domain", F.posexplode_outer("_nodes").alias("at", "n"))
    label = F.col("labelled_plain")
    return _labelled(rows, "domain", "at").groupBy("domain").agg(
        F.count_if(F.col("at").isNull() | (F.col("at") == 0)).alias("documents"), F.count("at").alias("keys"), F.count_if(label).alias("labelled"),
        F.count_if("critical").alias("critical"), F.count_if(label & F.col("critical")).alias("critical_labelled"),
    )


#: Whole numbers as floats, as these may have any number of digits.
_READER = json.JSONDecoder(parse_int=float, parse_constant=_constant)
_COUNTS = ("keys", "labelled", "critical", "critical_labelled")


def _counted(text: bytes | None) -> tuple[int, int, int, int] | None:
    """_COUNTS of a text's value objects in objects alone, zeros of the old schema; None of a text that can't be read."""
    try:
        root = _READER.decode(text.decode()) if text is not None else None
    except (ValueError, RecursionError):
        return None
    todo = [root] if isinstance(root, dict) and not isinstance(root.get("keys"), list) else []
    keys = labelled = critical = both = 0
    while todo:
        for x in todo.pop().values():
            if type(x) is not dict:
                continue
            if "value" not in x:
                todo.append(x)
                continue
            v = x["value"]
            has = v.strip() != "" if isinstance(v, str) else isinstance(v, (bool, float)) or bool(v)
            keys += 1
            labelled += has
            if x.get("critical"):
                critical += 1
                both += has
    return keys, labelled, critical, both


@F.arrow_udf(StructType([StructField(c, LongType()) for c in _COUNTS]))
def _counts(texts: pa.Array) -> pa.Array:
    found = [_counted(t) for t in texts.cast(pa.binary()).to_pylist()]  # bytes, as a text may be no UTF-8
    columns = [pa.array([c and c[i] for c in found], pa.int64()) for i in range(len(_COUNTS))]
    return pa.StructArray.from_arrays(columns, list(_COUNTS), mask=pa.array([c is None for c in found], pa.bool_()))


def label_summary(docs: DataFrame) -> DataFrame:
    """``docs``: domain, json (null: not readable). By domain, for a report on labels: value objects in
    objects alone: all, labelled (any), critical and both, and documents that can't be read, are in the
    old schema or hold none. What Python's reader refuses is walked in expressions, so none that these read is lost."""
    read = docs.select("domain", "json", _counts("json").alias("_c"))
    rest = _unfolded(read.select("domain", "_c", F.when(F.col("_c").isNull(), F.col("json")).alias("json")), _node_mode(False))
    rows = _labelled(rest.select("domain", "_c", F.posexplode_outer("_nodes").alias("at", "n")), "domain", "_c", "at")
    none, label = F.col("at").isNull(), F.col("labelled_any")
    # Rows of the walk, and the counts of documents without any.
    both = lambda rows, c: (rows + F.coalesce(F.sum(F.col("_c")[c]), F.lit(0))).alias(c)
    return rows.groupBy("domain").agg(
        F.count_if(none | (F.col("at") == 0)).alias("documents"), both(F.count("at"), "keys"), both(F.count_if(label), "labelled"), both(F.count_if("critical"), "critical"),
        both(F.count_if(label & F.col("critical")), "critical_labelled"), F.count_if(none & (F.coalesce(F.col("_c.keys"), F.lit(0)) == 0)).alias("invalid"),
    )


def rejected(docs: DataFrame) -> DataFrame:
    """``docs``: doc, json. Documents that can't be ground truth, and the rule: invalid_json, legacy_schema (a list of keys), no_values (no value objects)."""
    found = _unfolded(docs.select("doc", "json"), _node_mode(True), legacy=True)
    rule = F.when(F.col("_root").isNull(), "invalid_json").when(old_schema(F.col("_root")), "legacy_schema").when(F.size("_nodes") == 0, "no_values")
    return found.select("doc", rule.alias("rule")).filter("rule is not null")


def dataset_summary(rows: DataFrame, by: str = "domain") -> DataFrame:
    """Documents, keys, labelled, critical and both, by domain, with percentages."""
    has = F.size("expected") > 0
    g = rows.groupBy(by).agg(F.countDistinct("doc").alias("documents"), F.count("*").alias("keys"), F.count_if(has).alias("labelled"), F.count_if("critical").alias("critical"), F.count_if(has & F.col("critical")).alias("critical_labelled"))
    return g.withColumn("labelled_pct", F.when(F.col("keys") > 0, F.col("labelled") / F.col("keys") * 100).otherwise(0.0))


def manifest_rows(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``manifest``: json (one row). Its domains (domain, document_count, listed) and its documents in
    order (domain, position, document_id, source, truth). A manifest that is no JSON or has no list of domains raises."""
    shape = "struct<domains array<struct<id string, document_count int, documents array<struct<document_id string, source_pdf string, ground_truth string>>>>>"
    m = manifest.select(F.from_json("json", shape, {"mode": "FAILFAST"}).alias("m"))
    m = m.select(F.when(F.col("m.domains").isNull(), F.raise_error(F.lit("the manifest has no list of domains"))).otherwise(F.col("m.domains")).alias("d"))
    m = m.select(F.posexplode("d").alias("at", "d"))
    domains = m.select(F.col("d.id").alias("domain"), F.col("d.document_count").alias("document_count"), F.size("d.documents").alias("listed"), F.col("d.documents").isNotNull().alias("valid"))
    docs = m.select("at", F.col("d.id").alias("domain"), F.posexplode("d.documents").alias("i", "x"))
    return domains, docs.select("domain", (F.col("at") * 1_000_000 + F.col("i")).cast("long").alias("position"), F.col("x.document_id").alias("document_id"), F.col("x.source_pdf").alias("source"), F.col("x.ground_truth").alias("truth"))


def domain_key(c: str) -> Column:
    """Trimmed lower case; null is empty."""
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def selected_documents(documents: DataFrame, domains: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Documents of the named domains (all without names), at most the first ``most`` of each in manifest order; before any file is read."""
    wanted = [d.strip().lower() for d in domains or []]
    some = documents.filter(domain_key("domain").isin(wanted)) if wanted else documents
    if not most or most < 1:
        return some
    n = F.row_number().over(Window.partitionBy("domain").orderBy("position"))
    return some.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def ran(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents that some run is about, by domain in any case and id; before any file is read."""
    done = runs.select(F.lower("domain").alias("_d"), F.col("document_id").alias("_i")).distinct()
    return documents.join(done, (F.lower("domain") == F.col("_d")) & (F.col("document_id") == F.col("_i")), "left_semi")


def prepared(spark, documents: DataFrame, folder: str) -> DataFrame:
    """``documents``: domain, document_id, truth (a path below ``folder``), as they were selected. With json,
    the text of each one's file; only these files are opened."""
    from ..sources.files import selected_files

    found = selected_files(spark, folder, documents, "truth").select(F.col("name").alias("truth"), F.col("text").alias("json"))
    return documents.join(found, "truth")


def selected_models(models: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Models whose id or label is named, in any case; all without names. None selected raises."""
    names = [w.strip().lower() for w in wanted or [] if w.strip()]
    some = models.filter(F.lower(F.trim("model_id")).isin(names) | F.lower(F.trim("model_label")).isin(names)) if names else models
    if some.isEmpty():
        raise ValueError("no model is selected")
    return some


def validate(manifest: DataFrame, files: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """``manifest``: domain, position, document_id, source, truth; ``files``: path and, of ground truth,
    json; ``domains``: domain, document_count, listed, valid. One row per broken rule: rule, document_id
    (the domain's or folder's name for rules of these). Entries with a missing field break no other rule;
    of repeated ids and sources every one after the first is named."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lacking = empty("document_id") | empty("source") | empty("truth")
    whole = manifest.filter(~lacking)
    known = files.select("path").distinct()
    row = lambda d, rule, c="document_id": d.select(F.lit(rule).alias("rule"), F.col(c).alias("document_id"))
    missing = lambda col, rule: row(whole.join(known, whole[col] == known["path"], "left_anti"), rule)
    later = lambda c: whole.withColumn("_n", F.row_number().over(Window.partitionBy(c).orderBy("position"))).filter("_n > 1")
    out = row(manifest.filter(lacking), "missing_fields").unionByName(row(later("document_id"), "duplicate_id")).unionByName(row(later("source"), "reused_source"))
    out = out.unionByName(missing("source", "missing_source")).unionByName(missing("truth", "missing_truth"))
    if "json" in files.columns:
        read = whole.join(files.filter("json is not null"), whole["truth"] == files["path"]).select(F.col("document_id").alias("doc"), "json")
        out = out.unionByName(rejected(read).select("rule", F.col("doc").alias("document_id")))
    folder = F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+\.(?i:pdf)$", 2)
    standard = ("ground_truth", "reduced_size", "full_size", "full size")
    nested = known.filter(F.col("path").rlike(r"(?:^|/)documents/[^/]+/[^/]+/[^/]+\.(?i:pdf)$") & ~folder.isin(*standard)).select(folder.alias("document_id")).distinct()
    out = out.unionByName(row(nested, "nested_pdf"))
    if domains is not None:
        out = out.unionByName(row(domains.filter("coalesce(domain, '') = '' or not valid"), "bad_domain", "domain"))
        out = out.unionByName(row(domains.filter("coalesce(domain, '') <> '' and valid and document_count <> listed"), "count_mismatch", "domain"))
    return out
