"""The model behind the spans that op10 adds: candidates, expectation-maximisation and the classifier against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docscore.llm import pii as P


def spans(df):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in df.collect()}


PEOPLE = ["Anna Schmidt", "Peter Müller", "Maria Keller", "James Brown", "Claire Dubois", "Élodie Martin", "Carlos García Pérez"]


def planted(n=260):
    """Rows with names, numbers and addresses that are personal, and look-alikes that are not."""
    rng = random.Random(4)
    words = lambda k: " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7))) for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        name = rng.choice(PEOPLE)
        person = [f"my name is {name}", f"Ich heiße {name}", f"je m'appelle {name}", f"me llamo {name}", f"contact Dr. {name}"][i % 5]
        number = [f"{rng.randint(200, 999)}-555-{rng.randint(1000, 9999)}", f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"{rng.randint(200, 899)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"][i % 3]
        text = f"{words(8)} {person}, {words(3)} {['phone', 'call', 'ssn'][i % 3]} {number} {words(4)}"
        rows.append((i, text))
        found = name if i % 5 < 4 else f"Dr. {name}"
        want[i] = {("name", text.index(found), text.index(found) + len(found)), (["tel", "tel", "id"][i % 3], text.index(number), text.index(number) + len(number))}
    for i in range(n, 2 * n):  # nothing personal
        rows.append((i, f"{words(6)} version {rng.randint(1, 9)}.{rng.randint(0, 9)} {rng.randint(1000, 9999)} of {rng.randint(10**15, 10**16 - 1)} or my name is not here. {words(5)} 1{rng.randint(10, 99)} {rng.randint(100, 999)} {rng.randint(1000, 9999)} 12"))
    return rows, want


def test_added_spans_on_planted_rows(spark):
    rows, want = planted()
    got = spans(P.find_pii(spark.createDataFrame(rows, "doc_id long, text string")))
    base = {r.doc_id: {(s.kind, s.start, s.end) for s in r.base} for r in P.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {(i, s) for i, found in got.items() for s in found if s not in base[i]}
    assert any(base.values()) and any(i >= len(want) for i in base)
    true = {(i, s) for i, found in want.items() for s in found}
    assert len(added & true) >= 0.9 * len(true)  # recall
    assert len(added & true) >= 0.95 * len(added)  # precision


@pytest.mark.parametrize(("text", "found"), [
    ("Hello, my name is Anna Schmidt.", "Anna Schmidt"), ("MY NAME IS Bo Li", "Bo Li"), ("ich heisse Jörg Groß und", "Jörg Groß"), ("mon nom est Zoé", "Zoé"), ("my name is not here", None), ("Frau Dr", "Frau Dr"), ("tommy name is Bob", None),
    ("call 212-555-0199 now", "212-555-0199"), ("call 212.555.0199 now", "212.555.0199"), ("call 212 555 0199 now", "212 555 0199"), ("call 212-555.0199", None), ("no 4 212 555 0199", None), ("v 212.555.0199.1", None), ("+1 (212) 555-0199", None), ("1212-555-0199", None),
])
def test_candidates(spark, text, found):
    r = P.with_candidates(spark.createDataFrame([(text,)], "text string"), "text").select("_spans").first()._spans
    extra = [text[s.start : s.end] for s in r if s.kind in ("tel", "name")]
    assert extra == ([found] if found else [])


def plain_em(counts, rounds):
    """The same steps, a number at a time."""
    k = len(P.LABELERS)
    share = dict.fromkeys(P.KINDS, 0.7)
    yes, no = [[0.1, 0.4, 0.5] for _ in range(k)], [[0.5, 0.4, 0.1] for _ in range(k)]
    for _ in range(rounds):
        g = []
        for kind, v, _n in counts:
            a, b = share[kind], 1 - share[kind]
            for i in range(k):
                a, b = a * yes[i][v[i] + 1], b * no[i][v[i] + 1]
            g.append(a / (a + b))
        share = {q: (1 + sum(n * x for (kind, _, n), x in zip(counts, g, strict=True) if kind == q)) / (2 + sum(n for kind, _, n in counts if kind == q)) for q in P.KINDS}
        table = lambda w, g=g: [[(1 + sum(n * w(x) for (_, v, n), x in zip(counts, g, strict=True) if v[i] == y)) / (3 + sum(n * w(x) for (_, _, n), x in zip(counts, g, strict=True))) for y in (-1, 0, 1)] for i in range(k)]
        yes, no = table(lambda x: x), table(lambda x: 1 - x)
    return share, yes, no


def test_expectation_maximisation_equals_a_plain_version(spark):
    rng = random.Random(6)
    counts = sorted({(rng.choice(P.KINDS), tuple(rng.choice((-1, 0, 1)) for _ in P.LABELERS)): rng.randint(1, 500) for _ in range(60)}.items())
    counts = [(kind, v, n) for (kind, v), n in counts]
    m = P.reliabilities(spark.createDataFrame([(k, list(v), n) for k, v, n in counts], "kind string, v array<int>, n long")).first().m
    share, yes, no = plain_em(counts, P.ROUNDS)
    assert m.share == pytest.approx(share)
    for got, want in ((m.yes, yes), (m.no, no)):
        assert [list(x) for x in got] == [pytest.approx(x) for x in want]
    post = spark.createDataFrame([("id", [1, 0, 0, -1, 0])], "kind string, v array<int>").withColumn("m", F.lit(None)).drop("m")
    model = P.reliabilities(spark.createDataFrame([(k, list(v), n) for k, v, n in counts], "kind string, v array<int>, n long"))
    p = post.crossJoin(F.broadcast(model)).select(F.expr(P.posterior("m", "kind", "v")).alias("p")).first().p
    a, b = share["id"], 1 - share["id"]
    for i, v in enumerate([1, 0, 0, -1, 0]):
        a, b = a * yes[i][v + 1], b * no[i][v + 1]
    assert p == pytest.approx(a / (a + b))


def test_classifier_equals_a_plain_version(spark):
    rng = random.Random(7)
    each = len(P.LABELERS) + 3
    rows = [(rng.choice(P.KINDS), [rng.choice((-1, 0, 1)) for _ in P.LABELERS], [rng.randrange(60) for _ in range(each)]) for _ in range(300)]
    counts: dict = {}
    for kind, v, _ in rows:
        counts[kind, tuple(v)] = counts.get((kind, tuple(v)), 0) + 1
    share, yes, no = plain_em([(k, v, n) for (k, v), n in sorted(counts.items())], P.ROUNDS)
    of = [[0.0, 0.0] for _ in range(P.BUCKETS)]
    for kind, v, f in rows:
        a, b = share[kind], 1 - share[kind]
        for i, x in enumerate(v):
            a, b = a * yes[i][x + 1], b * no[i][x + 1]
        for bucket in f:
            of[bucket][0] += a / (a + b)
            of[bucket][1] += 1 - a / (a + b)
    ty, tn = sum(x for x, _ in of) / each, sum(x for _, x in of) / each
    m = P.classifier(spark.createDataFrame(rows, "kind string, v array<int>, f array<int>")).first()
    assert m.prior == pytest.approx(math.log((ty + 0.5) / (tn + 0.5)), abs=1e-4)
    more = 0.5 * sum(x != [0, 0] for x in of) / each
    want = [math.log((a + 0.5) / (ty + more)) - math.log((b + 0.5) / (tn + more)) if (a, b) != (0, 0) else 0 for a, b in of]
    assert list(m.weights) == [pytest.approx(w, abs=1e-4) for w in want]


def test_redact_takes_the_added_spans_too(spark):
    rows, want = planted()
    out = {r.doc_id: r.text for r in P.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = sum("[NAME]" in out[i] and ("[TEL]" in out[i] or "[ID]" in out[i]) for i in want)
    assert gone >= 0.9 * len(want)
