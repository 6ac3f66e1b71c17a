"""The boundary to extraction services: one function a provider, over batches of requests.

Requests are dealt by provider, so a provider's batches are its lanes. A service that fails
gives a row with its error, never a failed job. Without services, ``stub`` answers from the
requested keys, so plans can be run and tested offline.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontree as J
from ..functions import records as R
from ..functions.responses import response_text, used_tokens

#: The shape of each provider's responses.
SHAPE_OF = {"anthropic": "blocks", "openai": "output", "google": "candidates", "mistral": "chat"}
RESULT = "task_key string, provider string, raw_output string, latency_ms long, input_tokens long, output_tokens long, error string"
Service = Callable[[str, str], str]


def stub(prompt: str, document: str) -> str:
    """An answer for each requested key, made from the document's text."""
    keys = [line[2:].split(" (")[0] for line in prompt.splitlines() if line.startswith("- ")]
    if not document:
        raise ValueError("empty document")
    words = document.split()
    return json.dumps({"pairs": [{"key": k, "value": words[i % len(words)] if words else "", "found": bool(words)} for i, k in enumerate(keys)]}, ensure_ascii=False)


def extract(requests: DataFrame, services: dict[str, Service] | None = None, lanes: int | None = None) -> DataFrame:
    """``requests``: task_key, provider, prompt, document. With ``lanes``, all requests of a provider are one
    lane, one after another by task; without, they run wherever they are."""
    of = services or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    out, error = of.get(r.provider, stub)(r.prompt, r.document or ""), None
                except Exception as x:  # noqa: BLE001 - a service may fail in any way
                    out, error = "", str(x) or "unknown error"
                rows.append((r.task_key, r.provider, out, 0, len(r.prompt.split()), len(out.split()), error))
            yield pd.DataFrame(rows, columns=["task_key", "provider", "raw_output", "latency_ms", "input_tokens", "output_tokens", "error"])

    dealt = requests.repartition(lanes, "provider").sortWithinPartitions("provider", "task_key") if lanes else requests
    return dealt.select("task_key", "provider", "prompt", "document").mapInPandas(run, RESULT)


REPLAYED = "task_key string, provider string, raw_output string, input_tokens long, output_tokens long, cached_tokens long, written_tokens long, error string"


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Answers out of recorded responses instead of calls. ``requests``: task_key, provider, key (see
    requests.prompt_cache_key); ``recorded``: key, response (JSON). One row a request, with the text and the
    tokens that its response names; a request without a response, one whose response is an error ({"error":
    {"message": ...}}) and one without text get an error. Of several responses to a key one counts, the
    greatest. Requests meet responses in one join; every response is read once."""
    one = recorded.groupBy("key").agg(F.max("response").alias("response"))
    message = J.let(J.parsed(F.col("response")), lambda n: R.get_string(R.get_record(n, "error"), "message"))
    of = lambda read, none: F.coalesce(*(F.when(F.col("provider") == p, read(F.col("response"), shape)) for p, shape in SHAPE_OF.items()), none)
    nothing = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in ("input_tokens", "output_tokens", "cached_tokens", "written_tokens")))
    j = requests.select("task_key", "provider", "key").join(one, "key", "left").withColumn("_e", message).withColumn("_t", of(response_text, F.lit(""))).withColumn("_u", of(used_tokens, nothing))
    error = F.when(F.col("response").isNull(), "no recorded response").when(F.col("_e").isNotNull(), F.col("_e")).when(F.col("_t") == "", "empty response")
    text = F.when(error.isNull(), F.col("_t")).otherwise("")
    return j.select("task_key", "provider", text.alias("raw_output"), *(F.when(error.isNull(), F.col(f"_u.{n}")).otherwise(0).alias(n) for n in ("input_tokens", "output_tokens", "cached_tokens", "written_tokens")), error.alias("error"))


def lane_count(providers: int, configured: int, by_provider: bool) -> int:
    """Lanes at once: one a provider at most if dealt by provider, else as configured; never less than one."""
    return max(1, min(configured, providers) if by_provider else configured)
