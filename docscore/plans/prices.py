"""Price list: USD per million tokens. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRICES = (
    ("claude-opus-4-8", 5.0, 25.0, None), ("claude-opus-4-7", 5.0, 25.0, None), ("claude-opus-4-6", 5.0, 25.0, None), ("claude-opus-4-5", 5.0, 25.0, None), ("claude-opus-4-1", 15.0, 75.0, None),
    ("claude-sonnet-4-6", 3.0, 15.0, None), ("claude-sonnet-4-5", 3.0, 15.0, None), ("claude-sonnet-4", 3.0, 15.0, None), ("claude-haiku-4-5", 1.0, 5.0, None), ("claude-haiku-3", 0.25, 1.25, None),
    ("gpt-5-2", 1.75, 14.0, None), ("gpt-5", 1.25, 10.0, None), ("gpt-5.4", 2.5, 15.0, None), ("gpt-5-mini", 0.25, 2.0, None), ("gpt-5-nano", 0.05, 0.4, None), ("gpt-5.4-mini", 0.75, 4.5, None),
    ("gpt-5.4-nano", 0.2, 1.25, None), ("gpt-5.5", 5.0, 30.0, None), ("gpt-5-pro", 15.0, 120.0, None), ("gpt-4.1", 2.0, 8.0, None), ("gpt-4.1-mini", 0.4, 1.6, None), ("gpt-4.1-nano", 0.1, 0.4, None),
    ("gpt-4o", 2.5, 10.0, None), ("gpt-4o-mini", 0.15, 0.6, None), ("o3", 2.0, 8.0, None), ("o4-mini", 1.1, 4.4, None), ("gemini-3.1-pro-preview", 2.0, 12.0, None), ("gemini-2.5-pro", 1.25, 10.0, None),
    ("gemini-2.5-flash", 0.3, 2.5, None), ("gemini-2.5-flash-lite", 0.1, 0.4, None), ("gemini-3.1-flash-lite-preview", 0.25, 1.5, 0.025), ("gemini-3-pro-preview", 2.0, 12.0, None),
    ("gemini-3-flash-preview", 0.5, 3.0, None), ("gemini-3.5-flash", 1.5, 9.0, None), ("mistral-small-latest", 0.1, 0.3, None), ("mistral-medium-latest", 0.4, 2.0, None), ("mistral-large-latest", 0.5, 1.5, None),
)


def prices(spark: SparkSession) -> DataFrame:
    """A dimension table of some forty rows, small enough to broadcast at any size of the facts."""
    return spark.createDataFrame(list(PRICES), "model_id string, price_in double, price_out double, price_cached double")
