"""Statistics with the engine's conventions for empty groups, and its rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half(x: Column, digits: int) -> Column:
    """Half away from zero on the binary value; round() would go through decimal text."""
    m = F.lit(float(10**digits))
    up = F.floor(F.abs(x) * m + 0.5).cast("double") / m
    return F.when(x < 0, -up).otherwise(up)


def round6(x: Column) -> Column:
    """Six decimals, ties to even."""
    return F.rint(x * 1e6) / 1e6


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its binary value, ties to even; null stays. (format_string() would round its decimal text.)"""
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))


def pct(part: Column, whole: Column) -> Column:
    """Percentage; 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def mean0(x: Column) -> Column:
    """Mean; 0 for an empty group."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def stddev0(x: Column) -> Column:
    """Population standard deviation; 0 for an empty group."""
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def variation(mean: Column, deviation: Column) -> Column:
    """Coefficient of variation in percent; 100 where the mean isn't positive."""
    return F.when(mean > 0, deviation / mean * 100).otherwise(F.lit(100.0))


def nearest_rank(column: str, p: int, where: str | None = None) -> Column:
    """Nearest-rank percentile; null for an empty group."""
    keep = f" FILTER (WHERE {where})" if where else ""
    return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column}){keep}").cast("double")


def nearest_rank0(column: str, p: int, where: str | None = None) -> Column:
    """Nearest-rank percentile; 0 for an empty group."""
    return F.coalesce(nearest_rank(column, p, where), F.lit(0.0))


def combinations(n: Column, k: int) -> Column:
    """n over k as a product of ratios; 0 where n < k."""
    product = F.aggregate(F.array(*(F.lit(float(i)) for i in range(1, k + 1))), F.lit(1.0), lambda a, i: a * (n - k + i) / i)
    return F.when(n >= k, product).otherwise(F.lit(0.0))


def within_tolerance(a: Column, b: Column) -> Column:
    """Equal, off by at most 1, or by at most a quarter of the larger magnitude."""
    off, top = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    return (off == 0) | (off <= 1.0) | F.when(top > 0, off / top <= 0.25).otherwise(False)


def drift(a: Column, b: Column) -> Column:
    """Signed relative change from a to b; 0 for no change, infinite from 0."""
    return F.when(a == b, F.lit(0.0)).when(a == 0, F.lit(float("inf"))).otherwise((b - a) / F.abs(a))


def retry_ceiling(tokens: Column, limit: int = 8000, step: int = 400) -> Column:
    """Output limit of a retry: doubled, by at least ``step``, never over ``limit``."""
    return F.least(F.lit(limit), F.greatest(tokens + step, tokens * 2))


def token_cost(inputs: Column, cached: Column, outputs: Column, price_in: Column, price_out: Column, price_cached: Column) -> Column:
    """USD for token counts at prices per million; cached tokens cost price_in where they have no price."""
    fresh = F.greatest(inputs - cached, F.lit(0))
    return (fresh * price_in + F.greatest(cached, F.lit(0)) * F.coalesce(price_cached, price_in) + F.greatest(outputs, F.lit(0)) * price_out) / 1e6


def page_cost(pages: Column, annotated: Column) -> Column:
    """USD for pages, plain or annotated; fewer than none cost nothing."""
    return F.greatest(pages, F.lit(0)) * F.when(annotated, F.lit(0.003)).otherwise(F.lit(0.002))
