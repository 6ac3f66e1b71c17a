"""Normalisers of typed values: companies, units, currencies, dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, let, normalize_text, strip

#: Legal forms that end a company's name.
LEGAL_FORMS = ("inc", "incorporated", "corp", "corporation", "company", "co", "llc", "ltd", "limited", "plc", "bv", "nv", "sa", "sarl", "gmbh", "ag", "aps", "as", "oy", "ab", "pte")
#: Fixed values: "care of", its short form, and a legal form with a stroke; an ISO date or time.
_CARE_OF, _C_O, _A_S = r"(?iU)\bcare\s+of\b", r"(?iU)\bc\s*/?\s*o\b", r"(?iU)\ba\s*[/.]?\s*s\b"
_STAMP = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2}(?:[.]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"

#: Spellings of units of weight.
WEIGHT_UNITS = {
    "kg": ("kg", "kgs", "kilogram", "kilograms"),
    "g": ("g", "gram", "grams"),
    "lb": ("lb", "lbs", "pound", "pounds"),
    "tonne": ("ton", "tons", "tonne", "tonnes", "mt"),
}
#: Currency symbols in the order in which they are tried, and currency codes.
CURRENCY_SYMBOLS = (
    ("US$", "USD"), ("USD$", "USD"), ("C$", "CAD"), ("CA$", "CAD"), ("A$", "AUD"), ("AU$", "AUD"), ("HK$", "HKD"), ("SG$", "SGD"),
    ("MX$", "MXN"), ("NZ$", "NZD"), ("R$", "BRL"), ("CHF", "CHF"), ("NOK", "NOK"), ("DKK", "DKK"), ("$", "USD"), ("€", "EUR"),
    ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₩", "KRW"), ("₺", "TRY"), ("₽", "RUB"), ("kr", "SEK"), ("zł", "PLN"),
)
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "INR", "HKD", "SGD", "BRL", "KRW", "TRY", "RUB", "MXN", "NZD", "SEK", "NOK", "DKK", "PLN")


def company(s: Column) -> Column:
    """A company's name without "care of" and without legal forms at its end."""
    t = F.regexp_replace(s, _CARE_OF, " ")
    t = F.regexp_replace(t, _C_O, " ")
    t = F.regexp_replace(t, _A_S, "as")
    return F.trim(F.regexp_replace(normalize_text(t), f"((^| )({'|'.join(LEGAL_FORMS)}))+$", ""))


#: Words that do not count in terms, packages and modes.
FREIGHT_WORDS, PACKAGE_WORDS, TRANSPORT_WORDS = ("freight", "term", "terms"), ("stc",), ("freight",)


def words_without(norm: Column, *tokens: str) -> Column:
    """A normalised text without some words."""
    return F.array_join(F.filter(F.split(norm, " "), lambda t: (t != "") & ~t.isin(*tokens)), " ")


def freight_terms(s: Column) -> Column:
    return words_without(normalize_text(s), *FREIGHT_WORDS)


def package_type(s: Column) -> Column:
    return words_without(normalize_text(s), *PACKAGE_WORDS)


def transport_mode(s: Column) -> Column:
    return words_without(normalize_text(s), *TRANSPORT_WORDS)


def unit_of(compacted: Column) -> Column:
    """The unit of a compact() text: a known one's short name, other text as it is; null for none."""
    out = F.when(compacted == "", F.lit(None).cast("string"))
    for unit, spellings in WEIGHT_UNITS.items():
        out = out.when(compacted.isin(*spellings), unit)
    return out.otherwise(compacted)


def weight_unit(s: Column) -> Column:
    """A known unit's short name, other text in compact form; null for none."""
    return unit_of(compact(s))


def currency(s: Column) -> Column:
    """A currency's code: the code itself, a symbol itself, a code inside, a symbol inside; else null.

    Codes inside are tried in the order of CURRENCY_CODES."""
    t = strip(s)
    up = F.upper(t)
    out = F.when(t == "", F.lit(None).cast("string")).when(up.isin(*CURRENCY_CODES), up)
    for symbol, code in CURRENCY_SYMBOLS:
        out = out.when((t == symbol) | (up == symbol.upper()), code)
    for code in CURRENCY_CODES:
        out = out.when(up.contains(code), code)
    for symbol, code in CURRENCY_SYMBOLS:
        out = out.when(t.contains(symbol), code)
    return out


#: How days and times of day are found in text.
_YMD = r"([0-9]{4})[/.\-]([0-9]{1,2})[/.\-]([0-9]{1,2})"
_DMY = r"([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2,4})"
_TIME = r"(?i)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?U:\s*)([ap]\.?m\.?)?"


def iso_date(y: Column, m: Column, d: Column) -> Column:
    """yyyy-MM-dd of strings of digits, a year below 100 in this century; null if there is no such day."""
    year = y.try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when((year >= 1) & (m != "") & (d != ""), F.when(text.try_cast("date").isNotNull(), text))


def iso_timestamp_day(s: Column) -> Column:
    """The UTC day of an ISO date, compact date or date and time; null for other text."""
    t = F.regexp_replace(strip(s), "[zZ]$", "+00:00")
    dashed = F.regexp_replace(t, r"^([0-9]{4})([0-9]{2})([0-9]{2})(?=$|[T ])", "$1-$2-$3")
    is_iso = dashed.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?([+-][0-9]{2}:[0-9]{2})?)?$")
    return F.when(is_iso, F.date_format(dashed.try_cast("timestamp"), "yyyy-MM-dd"))


def dates(s: Column) -> Column:
    """All ISO days that a text may mean: year first, day first, month first, ISO. Each pattern is searched
    once, and texts without a digit are not searched."""

    def of(t: Column) -> Column:
        first = lambda pattern, body: let(F.split(F.regexp_extract(t, pattern, 0), r"[/.\-]"), lambda p: body(F.get(p, 0), F.get(p, 1), F.get(p, 2)))
        ymd = first(_YMD, lambda y, m, d: F.array(iso_date(y, m, d)))
        dmy = first(_DMY, lambda a, b, c: F.array(iso_date(c, b, a), iso_date(c, a, b)))
        return F.array_distinct(F.array_compact(F.concat(ymd, dmy, F.array(iso_timestamp_day(t)))))

    return F.when(F.coalesce(s, F.lit("")).rlike("[0-9]"), let(strip(s), of)).otherwise(F.array().cast("array<string>"))


def clock(s: Column) -> Column:
    """Struct h, m, s, has_s of the first time of day in a text; null without a valid one."""
    return F.when(F.contains(s, F.lit(":")), let(F.regexp_extract(strip(s), _TIME, 0), _clock))


def _clock(t: Column) -> Column:
    h, m, sec, half = (F.regexp_extract(t, _TIME, i) for i in (1, 2, 3, 4))
    half = F.replace(F.lower(half), F.lit("."), F.lit(""))
    hour = h.try_cast("int")
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    minute, second = m.try_cast("int"), F.coalesce(sec.try_cast("int"), F.lit(0))
    fine = (h != "") & minute.between(0, 59) & second.between(0, 59) & hour.between(0, 23)
    return F.when(fine, F.struct(hour.alias("h"), minute.alias("m"), second.alias("s"), (sec != "").alias("has_s")))


def same_clock(a: Column, b: Column) -> Column:
    """Hours and minutes equal, and seconds where both have them."""
    eq = (a["h"] == b["h"]) & (a["m"] == b["m"]) & (~(a["has_s"] & b["has_s"]) | (a["s"] == b["s"]))
    return F.coalesce(eq, F.lit(False))


def expiry_millis(s: Column, now_ms: Column, seconds: int = 600) -> Column:
    """Milliseconds since 1970 of an ISO date or time (without a zone: UTC); else ``seconds`` after ``now_ms``."""
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(s, _STAMP, i), F.lit("")), F.lit(default))
    at = F.concat(part(1, None), F.lit("T"), part(2, "00:00"), part(3, ":00"), part(4, "Z")).try_cast("timestamp")
    return F.coalesce(F.unix_millis(at), now_ms + seconds * 1000)
