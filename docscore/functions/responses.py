"""The text of a service's answer, out of the JSON of its response, in six shapes.

Readers take a response's tree node (jsontree.parsed) and never raise: what is missing or of
another type is passed over, and a response without text gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsontree as T
from .jsonx import first_json
from .records import get_array, get_member, get_number, get_record, get_string
from .text import let, strip


def _objects(nodes: Column) -> Column:
    return F.filter(F.coalesce(nodes, F.array().cast(f"array<{T.NODE}>")), lambda n: n["kind"] == "object")


def _joined(texts: Column, between: str = "\n") -> Column:
    """Texts that are not empty, in order."""
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), between)


def annotation(response: Column) -> Column:
    """A page service's annotation of the whole document: an object, or a text, of which its JSON if it holds any."""
    inside = lambda m: let(first_json(m["text"]), lambda j: F.when(j.isNull() | (j["kind"] == "null"), m["text"]).otherwise(_json_text(j)))
    of = lambda m: F.when(m["kind"] == "string", inside(m)).when(m["kind"] == "object", T.compact(m)).otherwise("")
    return F.coalesce(let(get_member(response, "document_annotation"), of), F.lit(""))


def _json_text(node: Column) -> Column:
    """A node as JSON: texts in quotes again."""
    quoted = F.to_json(F.array(node["text"]))
    return F.when(node["kind"] == "string", F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(T.compact(node))


def markdown(response: Column) -> Column:
    """A page service's pages, with a blank line between."""
    return _joined(F.transform(_objects(get_array(response, "pages")), lambda p: get_string(p, "markdown")), "\n\n")


def blocks(response: Column) -> Column:
    """Text blocks of a list of content, also empty ones."""
    texts = F.transform(F.filter(_objects(get_array(response, "content")), lambda b: get_string(b, "type") == "text"), lambda b: get_string(b, "text"))
    return strip(F.array_join(texts, "\n"))


def output(response: Column) -> Column:
    """The collected output text if it isn't blank, else the text parts of all output items."""
    parts = lambda item: F.filter(_objects(get_array(item, "content")), lambda p: get_string(p, "type") == "output_text")
    texts = F.flatten(F.transform(_objects(get_array(response, "output")), lambda i: F.transform(parts(i), lambda p: get_string(p, "text"))))
    collected = strip(get_string(response, "output_text"))
    return F.when(collected != "", collected).otherwise(strip(_joined(texts)))


def _first_record(nodes: Column) -> Column:
    return let(F.get(nodes, F.lit(0)), lambda n: F.when(n["kind"] == "object", n))


def candidates(response: Column) -> Column:
    """The text parts of the first candidate."""
    content = get_record(_first_record(get_array(response, "candidates")), "content")
    return strip(_joined(F.transform(_objects(get_array(content, "parts")), lambda p: get_string(p, "text"))))


def chat(response: Column) -> Column:
    """The message of the first choice: a text, or the text of its parts."""
    message = get_record(_first_record(get_array(response, "choices")), "message")

    def of(c: Column) -> Column:
        texts = F.transform(_objects(T.elements(F.when(c["kind"] == "array", c["text"]))), lambda p: get_string(p, "text"))
        return F.when(c["kind"] == "string", strip(c["text"])).otherwise(strip(_joined(texts)))

    return F.coalesce(let(get_member(message, "content"), of), F.lit(""))


SHAPES: dict[str, Callable[[Column], Column]] = {"annotation": annotation, "markdown": markdown, "blocks": blocks, "output": output, "candidates": candidates, "chat": chat}


def response_text(response: Column, shape: str) -> Column:
    """The text of a response's JSON (a text); a response that is no JSON gives an empty one."""
    return F.coalesce(let(T.parsed(response), SHAPES[shape]), F.lit(""))


#: Where the shapes say what was used: the object, then members for input, output, cached and written tokens.
_USED = {
    "blocks": ("usage", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"),
    "output": ("usage", "input_tokens", "output_tokens", None, None),
    "candidates": ("usageMetadata", "promptTokenCount", "candidatesTokenCount", "cachedContentTokenCount", None),
    "chat": ("usage", "prompt_tokens", "completion_tokens", None, None),
}


def used_tokens(response: Column, shape: str) -> Column:
    """Struct of input, output, cached and written tokens that a response's JSON names; what is missing, or no
    number, is 0, and fractions are cut."""
    at, *names = _USED[shape]

    def of(u: Column) -> Column:
        count = lambda n: F.coalesce(get_number(u, n).cast("bigint"), F.lit(0)) if n else F.lit(0).cast("bigint")
        cached = F.coalesce(get_number(get_record(u, "prompt_tokens_details"), "cached_tokens").cast("bigint"), F.lit(0)) if shape == "output" else count(names[2])
        return F.struct(count(names[0]).alias("input_tokens"), count(names[1]).alias("output_tokens"), cached.alias("cached_tokens"), count(names[3]).alias("written_tokens"))

    return let(let(T.parsed(response), lambda r: get_record(r, at)), of)


def pages_used(response: Column) -> Column:
    """Pages that a page service has read."""
    return let(T.parsed(response), lambda r: F.coalesce(get_number(get_record(r, "usage_info"), "pages_processed").cast("bigint"), F.lit(0)))
