"""Text normalisers as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Greek and Cyrillic letters that look like ASCII letters, and these letters.
LOOKALIKES = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαβεικμνοπρτυχАВЕКМНОРСТУХаекморстух"
ASCII_FORMS = "ABEZHIKMNOPTYXabeikmnoptyxABEKMHOPCTYXaekmopctyx"
#: What stands for a missing value, in compact form.
MISSING = ("na", "none", "null", "nil", "nill", "empty", "blank", "unknown", "nvd", "notavailable", "notapplicable", "notprovided", "notstated", "notspecified")

#: How the model names of one vendor begin.
MISTRAL = ("mistral", "ministral", "pixtral", "codestral", "devstral", "voxtral")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row, whatever is asked of it later: a filter on a plain new
    column is moved below it, with a copy of the value for each place that names it."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def fold(s: Column) -> Column:
    """Look-alike letters as ASCII."""
    return F.translate(s, LOOKALIKES, ASCII_FORMS)


#: White space that ASCII has.
_SPACES = " \t\n\x0b\x0c\r"


def strip(s: Column) -> Column:
    """Trim Unicode white space; null is empty. Plain ASCII needs no pattern."""
    return F.when(s.isNull(), "").when(F.length(s) == F.octet_length(s), F.btrim(s, F.lit(_SPACES))).otherwise(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining accents."""
    return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"), na_action="ignore")


def unaccented(s: Column) -> Column:
    """NFKD without accents; plain ASCII needs no Python."""
    return F.when(F.length(s) == F.octet_length(s), s).otherwise(_decomposed(F.when(F.length(s) != F.octet_length(s), s)))


def normalize_text(s: Column) -> Column:
    """Folded, lower-case, without accents; all but letters and digits is one space."""
    return F.trim(F.regexp_replace(unaccented(F.lower(strip(fold(F.coalesce(s, F.lit("")))))), "[^a-z0-9]+", " "))


def compact(s: Column) -> Column:
    """As normalize_text, without spaces."""
    return F.replace(normalize_text(s), F.lit(" "), F.lit(""))


def ascii_text(s: Column) -> Column:
    """normalize_text() of a string that has no accents left."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def key_name(s: Column) -> Column:
    """Key names: trimmed, lower-case, other characters as one space, which may stay at an end."""
    return F.regexp_replace(F.lower(strip(s)), "[^a-z0-9]+", " ")


def numeric(s: Column) -> Column:
    """A number out of text: a comma is a point, all but digits, points and minus goes; else null."""
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", ""), ",", "."), "[^0-9.-]", "")
    return kept.try_cast("double")


def missing(compacted: Column) -> Column:
    """Whether a compact() text is empty or a word for nothing."""
    return (compacted == "") | compacted.isin(*MISSING)


def missing_like(s: Column) -> Column:
    """Blank, without letters and digits, or a word for nothing."""
    return missing(compact(s))


def slug(s: Column, join: str = "-", most: int = 80) -> Column:
    """File-name form: no extension, other characters joined, trimmed, cut."""
    base = F.lower(F.regexp_replace(s, r"\.[^.]+$", ""))
    return F.left(F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", join), f"^{join}+|{join}+$" if join else "^$", ""), F.lit(most))


def looks_truncated(s: Column, parsed: Column) -> Column:
    """Not parsed as JSON, and ending in a comma or colon or with unbalanced brackets."""
    t = strip(s)
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    open_ = (count("{") > count("}")) | (count("[") > count("]"))
    return ~parsed & (t.endswith(",") | t.endswith(":") | open_) & (t != "")


def provider(model_id: Column) -> Column:
    """Vendor by the prefix of a model's name."""
    m = F.lower(model_id)
    by = F.when(m.startswith("claude"), "anthropic").when(m.startswith("gemini"), "google")
    return by.when(m.rlike("^(" + "|".join(MISTRAL) + ")"), "mistral").otherwise("openai")
