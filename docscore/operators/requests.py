"""What is sent to services: request bodies as JSON, one expression a service, and the rules for models.

Bodies are made beside the documents, so they are built where the rows are and sent by
runner.extract; nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Models whose documents are put into a cache of their own, and the reasoning effort by the beginning of a model's name.
CACHED_MODELS = ("gemini-2.5-flash-lite", "gemini-2.5-flash", "gemini-3-flash-preview", "gemini-3.1-flash-lite-preview", "gemini-3.1-pro-preview", "gemini-3-pro-preview", "gemini-3.5-flash")
LOW_EFFORT, LEAST_EFFORT = ("gpt-5.4", "gpt-5.5"), ("gpt-5", "o")


def quoted(text: Column) -> Column:
    """A text as JSON; null is an empty text."""
    q = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(q, F.lit(2), F.length(q) - 2)


def _json(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def prompt_cache_key(model: Column, system: Column, user: Column, base64: Column) -> Column:
    """SHA-256 of the four parts, a line each."""
    return F.sha2(F.concat(model, F.lit("\n"), system, F.lit("\n"), user, F.lit("\n"), base64), 256)


def document_cache_key(model: Column, system: Column, base64: Column) -> Column:
    """The key of a cached document: the model, and SHA-256 of the system prompt and the document."""
    return F.concat(model, F.lit(":"), F.sha2(F.concat(system, F.lit("\n"), base64), 256))


def reasoning_effort(model: Column) -> Column:
    """low, minimal or none (null), by the model's name in any case."""
    m = F.lower(model)
    begins = lambda names: F.lit(False) if not names else m.rlike("^(" + "|".join(n.replace(".", "[.]") for n in names) + ")")
    return F.when(begins(LOW_EFFORT), "low").when(begins(LEAST_EFFORT), "minimal")


def is_page_model(model: Column) -> Column:
    """Whether a model reads pages and has its own service."""
    return F.lower(model).startswith("mistral-ocr")


def temperature_refused(error: Column) -> Column:
    """Whether an error says that no temperature may be set any more, so the call is made again without."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return e.contains("temperature") & e.contains("deprecated")


def blocks_body(model: Column, system: Column, user: Column, base64: Column, tokens: Column, temperature: bool = True) -> Column:
    """A message of blocks, each marked for the service's own cache."""
    mark = ',"cache_control":{"type":"ephemeral"}}'
    return _json(
        '{"model":', quoted(model), ',"max_tokens":', tokens.cast("string"), ',"system":[{"type":"text","text":', quoted(system), mark, '],"messages":[{"role":"user","content":[{"type":"document","source":{"type":"base64","media_type":"application/pdf","data":"', base64, '"}', mark,
        ',{"type":"text","text":', quoted(user), mark, ']}],"metadata":{"user_id":"ocr-', F.left(prompt_cache_key(model, system, user, base64), F.lit(24)), '"}', ',"temperature":0}' if temperature else "}",
    )


def generate_body(model: Column, system: Column, user: Column, base64: Column, tokens: Column, cache: Column) -> Column:
    """Contents to generate from; ``cache``: the name of the document's cache entry, or null. Fast models do not think."""
    settings = _json('"generationConfig":{"maxOutputTokens":', tokens.cast("string"), ',"temperature":0', F.when(F.lower(model).contains("flash"), ',"thinkingConfig":{"thinkingBudget":0}').otherwise(""), "}}")
    named = F.when(model.isin(*CACHED_MODELS) & (F.coalesce(cache, F.lit("")) != ""), _json('{"cachedContent":', quoted(cache), ',"contents":[{"role":"user","parts":[{"text":', quoted(user), "}]}],", settings))
    whole = _json('{"systemInstruction":{"parts":[{"text":', quoted(system), '}]},"contents":[{"role":"user","parts":[{"inlineData":{"mimeType":"application/pdf","data":"', base64, '"}},{"text":', quoted(user), "}]}],", settings)
    return F.coalesce(named, whole)


def responses_body(model: Column, system: Column, user: Column, base64: Column, tokens: Column, file: Column) -> Column:
    """Input items with the document as a file, and the prompt's cache key."""
    effort = reasoning_effort(model)
    return _json(
        '{"model":', quoted(model), ',"max_output_tokens":', tokens.cast("string"), ',"input":[{"role":"system","content":[{"type":"input_text","text":', quoted(system), '}]},{"role":"user","content":[{"type":"input_file","filename":', quoted(F.coalesce(F.nullif(file, F.lit("")), F.lit("document.pdf"))),
        ',"file_data":"data:application/pdf;base64,', base64, '"},{"type":"input_text","text":', quoted(user), '}]}],"prompt_cache_key":"', prompt_cache_key(model, system, user, base64), '"', F.when(effort.isNotNull(), _json(',"reasoning":{"effort":"', effort, '"}')).otherwise(""), "}",
    )


def pages_body(model: Column, system: Column, user: Column, base64: Column, schema: str) -> Column:
    """A document for a page service, with the schema of its annotation (JSON)."""
    prompt = F.trim(F.concat(system, F.lit("\n\n"), user))
    return _json('{"model":', quoted(model), ',"document":{"type":"document_url","document_url":"data:application/pdf;base64,', base64, '"},"document_annotation_format":{"type":"json_schema","json_schema":{"name":"ocr_key_extraction","schema":', schema, '}},"document_annotation_prompt":', quoted(prompt), "}")
