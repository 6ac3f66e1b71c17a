"""Personal data by weak supervision, with DataFrame and SQL functions only.

Candidates are the matches of loose patterns: e-mail addresses, IP addresses, card-like runs
of digits, phone numbers, and also national numbers, phone numbers without a plus sign (with
brackets, dashes, points or blanks), and names of people after a title or a phrase that states
one ("my name is", and its like in four languages). Labelers vote on each candidate, for (1),
against (-1) or not at all (0): the strict form of the pattern, checksums, a gazetteer of
given names and words of the domain, and cues in the text before the candidate.

The votes of all candidates are counted by kind and pattern of votes, of which there are at
most KINDS x 3**LABELERS, whatever the data. On these counts expectation-maximisation (one
SQL expression over an array) estimates each labeler's reliability and the share of
true candidates by kind. The posterior of each candidate then is the label that trains the
final classifier, a naive Bayes model of span features (kind, shape, length, cue, votes),
by sums grouped by feature value (hashed into BUCKETS).

A candidate with a base form (see BASE) is personal data in any case; the others are if the
classifier says so. Positions come from what lies between the matches of a pattern: split()
gives the gaps and regexp_extract_all() the matches, and their lengths add up. All patterns
are possessive and start at run starts, so they take time in proportion to the text.

Defined cases: a null text counts as empty and has no spans; positions are code points, the
end is exclusive; other columns do not matter; rows that repeat an id each get their row; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole

BASE = ("email", "ip", "card", "phone")
EXTRA = ("id", "tel", "name")
KINDS = (*BASE, *EXTRA)
ROUNDS, BUCKETS, CUE = 25, 4096, 24  # steps of expectation-maximisation; feature buckets; characters of context

#: The contract's patterns. A possessive form that starts where a run starts
#: finds the same matches as the plain one and never goes back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "tel": r"(?=[(0-9])(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[\x20-])(?:\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|(?<![0-9][\x20])[0-9]{3}([-.\x20])[0-9]{3}\1[0-9]{4})(?![0-9A-Za-z-])(?![\x20.][0-9])",
    "name": r"(?=\p{Lu})(?:(?<!\p{L})(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?|Herr|Frau|Monsieur|Madame|Señora?)\x20|(?<=(?<!\p{L})(?i:my name is|i am called|mein name ist|ich hei(?:ß|ss)e|je m'appelle|mon nom est|me llamo|mi nombre es)\x20))\p{Lu}[\p{L}'-]{1,30}(?:\x20\p{Lu}[\p{L}'-]{1,30}){0,2}",
}
#: What a text must hold for a pattern to have a match; saves the search in most texts.
NEEDS = {"email": "@", "phone": "+", "id": "-"}
#: Gazetteer: given names in four languages, and words that make an address or number public.
NAMES = ("anna", "ben", "carlos", "claire", "david", "elena", "emma", "hans", "james", "jean", "john", "jose", "julia", "karl", "laura", "lucas", "maria", "marie", "michael", "paul", "peter", "pierre", "robert", "sarah", "sofia", "thomas")
PUBLIC = ("example", "test", "localhost", "noreply", "no-reply", "version", "isbn")
CUES = ("mail", "e-mail", "contact", "call", "phone", "tel", "fax", "mobile", "card", "visa", "account", "iban", "ip", "host", "ssn", "id", "name", "kontakt", "telefon", "appel", "llama", "reach", "write", "called", "heiße", "heisse", "appelle", "nom", "llamo", "nombre")


SPAN = "struct<kind:string,start:int,end:int,found:string,before:string>"


def _spans(text: Column, found: Column, kind: str) -> Column:
    """Array of (kind, start, end, found, before) of a pattern's matches ``found``, in order."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["found"].alias("found"), F.lower(F.right(x["gap"], F.lit(CUE))).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    gaps = F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("found")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step)["out"]).otherwise(zero["out"])


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits is right."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_base(kind: Column, found: Column) -> Column:
    """Whether a candidate has the contract's base form."""
    digits = _digits(found)
    n = F.length(digits)

    def small(part: Column) -> Column:
        short = F.ltrim(part, F.lit("0"))
        return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(F.split(found, r"\."), small))
        .when(kind == "card", n.between(16, 19) & _luhn(digits))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(False)
    )


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


LABELERS = ("form", "gazetteer", "cue", "structure", "mask")


def votes(kind: Column, found: Column, before: Column, base: Column) -> Column:
    """Array of the LABELERS' votes; each looks at one source of evidence."""
    low, n = F.lower(found), F.length(_digits(found))
    structure = (
        F.when(kind == "card", _vote(base, F.lit(True)))
        .when(kind == "phone", _vote(n.between(10, 13), n < 8))
        .when(kind == "id", _vote(~low.rlike("^(000|666|9)"), F.lit(True)))
        .when(kind == "tel", _vote(~low.rlike(r"^\(?[01]"), F.lit(False)))
        .when(kind == "name", _vote(low.rlike(r"\S\s\S"), F.lit(False)))
        .otherwise(0)
    )
    return F.array(
        _vote(base | kind.isin("id", "tel"), kind.isin(*BASE)),
        _vote(_any_of(low, NAMES), _any_of(low, ("localhost", "noreply", "no-reply"))),
        _vote(_any_of(before, CUES), _any_of(before, PUBLIC)),
        structure,
        _vote(F.lit(False), low.rlike(r"(.)\1{6}") | low.rlike(r"^0+\.0+\.0+\.0+$")),
    )


def features(kind: Column, found: Column, before: Column, v: Column) -> Column:
    """Numbers below BUCKETS of the span's features."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    cue = F.regexp_extract(before, r"([a-z]+)[^a-z]*$", 1)
    named = [("shape", F.left(shape, F.lit(24))), ("length", F.least(F.length(found), F.lit(30)).cast("string")), ("cue", cue)]
    named += [(name, v[i].cast("string")) for i, name in enumerate(LABELERS)]
    return F.array(*(F.pmod(F.xxhash64(kind, F.lit(name), value), F.lit(BUCKETS)).cast("int") for name, value in named))


def with_candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_spans``: kind, start, end, base, votes v and features f of every candidate."""
    text = whole(text_col)
    for k in KINDS:  # columns of their own, so that each pattern is searched once
        found = F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))
        if k == "tel":
            found = F.when(text.rlike(r"[0-9]{3}\)?[-.\x20]?[0-9]{3}[-.\x20][0-9]{4}"), found).otherwise(F.array().cast("array<string>"))
        if k == "card":
            found = F.when(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), found).otherwise(F.array().cast("array<string>"))
        docs = docs.withColumn(f"_found_{k}", F.when(F.contains(text, F.lit(NEEDS[k])), found).otherwise(F.array().cast("array<string>")) if k in NEEDS else found)
    every = [_spans(text, F.col(f"_found_{k}"), k) for k in KINDS]
    every[KINDS.index("card")] = F.filter(every[KINDS.index("card")], lambda x: F.length(_digits(x["found"])).between(13, 19))
    docs = docs.withColumn("_spans", F.concat(*every)).drop(*(f"_found_{k}" for k in KINDS))
    docs = docs.withColumn("_spans", F.transform("_spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), x["before"].alias("before"), is_base(x["kind"], x["found"]).alias("base"))))
    docs = docs.withColumn("_spans", F.transform("_spans", lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "found", "before", "base")), votes(x["kind"], x["found"], x["before"], x["base"]).alias("v"))))
    last = lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "base", "v")), features(x["kind"], x["found"], x["before"], x["v"]).alias("f"))
    return docs.withColumn("_spans", F.transform("_spans", last))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """Expectation-maximisation over (kind, v, n). One row m: share (map of kind to the share of true
    candidates), yes and no (of each labeler, the probabilities of -1, 0 and 1 for true and for
    false candidates). Labelers start as mildly right; counts are smoothed by one."""
    last = len(LABELERS) - 1
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    packed = patterns.agg(F.array_sort(F.collect_list(F.struct("kind", "v", F.col("n").cast("double").alias("n")))).alias("ps"))
    start = f"""struct(map_from_arrays(array({kinds}), array_repeat(0.7D, {len(KINDS)})) AS share,
        array_repeat(array(0.1D, 0.4D, 0.5D), {last + 1}) AS yes, array_repeat(array(0.5D, 0.4D, 0.1D), {last + 1}) AS no)"""
    weigh = f"transform(ps, p -> struct(p.kind AS kind, p.v AS v, p.n AS n, {posterior('m', 'p.kind', 'p.v')} AS g))"

    def total(where: str, value: str) -> str:
        return f"aggregate(filter(w, p -> {where}), 0D, (s, p) -> s + {value})"

    def table(g: str) -> str:
        seen = f"(1D + {total('p.v[i] = x', f'p.n * {g}')}) / (3D + {total('true', f'p.n * {g}')})"
        return f"transform(sequence(0, {last}), i -> transform(array(-1, 0, 1), x -> {seen}))"

    share = f"map_from_arrays(array({kinds}), transform(array({kinds}), k -> (1D + {total('p.kind = k', 'p.n * p.g')}) / (2D + {total('p.kind = k', 'p.n')})))"
    step = f"aggregate(array({weigh}), m, (z, w) -> struct({share} AS share, {table('p.g')} AS yes, {table('(1D - p.g)')} AS no))"
    return packed.selectExpr(f"aggregate(sequence(1, {ROUNDS}), {start}, (m, t) -> {step}) AS m")


def posterior(m: str, kind: str, v: str) -> str:
    """SQL for the probability that a candidate is true, given the model m."""

    def like(side: str) -> str:
        return f"aggregate(sequence(0, {len(LABELERS) - 1}), 1D, (q, i) -> q * {m}.{side}[i][{v}[i] + 1])"

    yes, no = f"({m}.share[{kind}] * {like('yes')})", f"((1D - {m}.share[{kind}]) * {like('no')})"
    return f"({yes} / ({yes} + {no}))"


def classifier(spans: DataFrame) -> DataFrame:
    """Naive Bayes from candidates (kind, v, f): one row, prior and weights (array of BUCKETS numbers)."""
    m = cut(reliabilities(spans.groupBy("kind", "v").agg(F.count("*").alias("n"))))
    soft = spans.withColumn("m", m.scalar()).withColumn("g", F.expr(posterior("m", "kind", "v")))
    # Votes and features repeat, so what is summed is small; sums are rounded to be the same in any order.
    sums = soft.select("g", F.explode("f").alias("b")).groupBy("b").agg(F.round(F.sum("g"), 6).alias("yes"), F.round(F.sum(1 - F.col("g")), 6).alias("no"))
    each = len(LABELERS) + 3  # features of a span
    packed = sums.agg(F.map_from_entries(F.collect_list(F.struct("b", F.struct("yes", "no")))).alias("of"), F.coalesce(F.sum("yes") / each, F.lit(0.0)).alias("ty"), F.coalesce(F.sum("no") / each, F.lit(0.0)).alias("tn"), (F.count("*") / each).alias("values"))
    # Half a count more for each of a feature's values, so that a class without any candidates has no likely value.
    weight = "coalesce(ln((of[b].yes + 0.5) / (ty + 0.5 * values)) - ln((of[b].no + 0.5) / (tn + 0.5 * values)), 0D)"
    return packed.selectExpr("ln((ty + 0.5) / (tn + 0.5)) AS prior", f"transform(sequence(0, {BUCKETS - 1}), b -> {weight}) AS weights")


def _ordered(spans: Column) -> Column:
    """By kind as listed, then start."""
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    keyed = F.transform(spans, lambda x: F.struct(F.element_at(rank, x["kind"]).alias("r"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(_ordered(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_pii(docs: DataFrame, text_col: str = "text", carry: bool = False) -> DataFrame:
    """``docs`` with base and found (in the place of its own columns of these names, if any):
    arrays of spans, ordered by kind as listed, then start.

    Without ``carry`` the text is not returned, and candidates are kept in the shared folder;
    with it they are searched twice, so that no text is written."""
    if carry:
        marked = with_candidates(docs, text_col)
    else:
        marked = cut(with_candidates(docs.withColumn("_text", F.col(text_col)).drop(text_col), "_text").drop("_text"))
    spans = marked.select(F.explode("_spans").alias("x")).select("x.kind", "x.v", "x.f")
    model = cut(classifier(cut(spans)))
    value = lambda x: F.col("_prior") + F.aggregate(x["f"], F.lit(0.0), lambda a, b: a + F.get(F.col("_weights"), b))
    out = marked.withColumn("_prior", model.select("prior").scalar()).withColumn("_weights", model.select("weights").scalar())
    out = out.withColumn("base", F.filter("_spans", lambda x: x["base"])).withColumn("found", F.filter("_spans", lambda x: x["base"] | (value(x) > 0)))
    return out.drop("_spans", "_prior", "_weights")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with [KIND] in the place of each span found; of overlapping spans the first, then the longest, counts."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))  # so no name clashes
    found = find_pii(packed, "text", carry=True)
    inorder = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.array(F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct((-x["end"]).alias("at"), F.concat(acc["out"], new).alias("out")))

    done = F.aggregate(inorder, zero, step)
    text = F.concat(F.array_join(done["out"], ""), F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    clean = F.when(F.size("found") > 0, text).otherwise(F.col("text"))
    return found.select(*(clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
