"""Near-duplicate groups by circulant MinHash.

Signatures: every shingle of a document goes through one permutation (sigma: a 64-bit
bijection, folded to DOMAIN places). A second permutation (pi) of these places is shifted
circularly by k = 0, 1, ... to give the k-th coordinate, min over the set of
pi[(sigma(x) + k) mod DOMAIN]. The shifts of one place are a contiguous window of pi, so all
coordinates of a shingle are one slice.

Banding: COORDS coordinates in bands of ROWS. Documents with one shingle set are one class,
whose representative has the smallest id; only representatives go on. Two of them are
candidates when they share a band. A candidate is linked if its full shingle sets confirm it;
before that only the sizes of the sets may rule it out, which is exact.

No group emits all its pairs: first each representative is compared with its bands' leaders,
and components are formed. Then only bands whose members lie in several components are looked
at again, and there only pairs of different components; the test on full sets is the condition
of that join, which AQE can split, so only links come out of it. So every candidate pair lies
in one component or was compared.

A link of similarity T is missed with probability (1 - T**ROWS) ** (COORDS / ROWS): about
7e-9 for 0.85 and 3e-6 for 0.8, less for higher ones.

Defined cases: a null text counts as empty; a text without words has an empty set and is
linked with nothing; fewer words than a shingle has are one shingle; a row with a null id is
linked with nothing, has a null component and is kept; an id may repeat: its rows are linked
by their own sets, and near_dedup drops a row by its id and text; of a group's rows with the
smallest id it keeps one (that with the least hash of its set, then of its text). An empty
table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop_rows, held, key_bitmap, mix64, runs_of, slices, text_hash, trimmed, with_maybe, words_of

COORDS, ROWS = 160, 5
DOMAIN_BITS = 20
_SIGMA = np.uint64(0x5851F42D4C957F2D)


def _permutation() -> np.ndarray:
    pi = np.random.default_rng(20240501).permutation(1 << DOMAIN_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[:COORDS])), COORDS)


def _windows() -> np.ndarray:
    """Row p: pi at p, p + 1, ... p + COORDS - 1, circularly."""
    return held("pi", _permutation)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDS minima of a non-empty array of 64-bit shingles."""
    place = np.unique(mix64(shingles ^ _SIGMA) >> np.uint64(64 - DOMAIN_BITS)).astype(np.int64)
    rows = _windows()
    out = rows[place[:2048]].min(axis=0)
    for lo in range(2048, len(place), 2048):
        np.minimum(out, rows[place[lo : lo + 2048]].min(axis=0), out=out)
    return out


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; fewer words are one shingle."""
    for lo, hi in slices(texts):
        _, _, h, first = words_of(texts[lo:hi])
        runs = runs_of(h, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                yield runs_of(h[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def _sums(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that tell sets apart."""
    return tuple(int(mix64(x).sum(dtype=np.uint64).astype(np.int64)) for x in (shingles, shingles ^ _SIGMA))


_SALTS = mix64(np.arange(1, COORDS + 1, dtype=np.uint64))


def _profile(k: int):
    bands = COORDS // ROWS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for one in shingle_sets(f["text"].tolist(), k):
                if not len(one):
                    out.append((0, 0, 0, None))
                    continue
                sig = signature(one).astype(np.uint64)
                keys = mix64((mix64(sig + _SALTS)).reshape(bands, ROWS).sum(axis=1, dtype=np.uint64))
                out.append((len(one), *_sums(one), keys.view(np.int64)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pd.DataFrame({"doc_id": f["doc_id"], "t": f["t"], "n_shingles": pd.Series(cols[0], dtype="int64"), "set_a": pd.Series(cols[1], dtype="int64"), "set_b": pd.Series(cols[2], dtype="int64"), "bands": pd.Series(cols[3], dtype=object)})

    return run


def _sets(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = list(shingle_sets(f["text"].tolist(), k))
            sums = [_sums(x) for x in sets]
            yield pd.DataFrame({"id": f["doc_id"], "a": [x for x, _ in sums], "b": [x for _, x in sums], "sh": pd.Series([x.view(np.int64) for x in sets], dtype=object)})

    return run


def _sets_of(docs: DataFrame, nodes: DataFrame, special: DataFrame | None, k: int) -> DataFrame:
    """(id, sh) of the nodes (column id), one row each; only texts that may be among them are shuffled, as sets."""
    ids = nodes if special is None else nodes.unionByName(special.select(F.col("low").alias("id")))
    near = with_maybe(docs.select("doc_id", "text"), F.xxhash64("doc_id"), key_bitmap(ids.select(F.xxhash64("id").alias("h"))), "maybe").filter("maybe").select("doc_id", "text")
    sets = near.mapInPandas(trimmed(_sets(k)), "id long, a long, b long, sh array<long>")
    if special is not None:
        sets = sets.join(special, (sets["a"] == special["set_a"]) & (sets["b"] == special["set_b"]) & (sets["id"] == special["low"]), "left")
        sets = sets.select(F.coalesce("rep", "id").alias("id"), "sh")
    # With an exchange of its own, so that AQE can split the many members of one leader in the join.
    return cut(sets.select("id", "sh").join(nodes, "id", "left_semi").dropDuplicates(["id"]))


def _against_leaders(docs: DataFrame, pairs: DataFrame, special: DataFrame | None, k: int, percent: int) -> DataFrame:
    """``pairs``: rep, l. Adds missing (of the leader's shingles), added (to them) and linked, from the full sets."""
    ids = pairs.select(F.col("rep").alias("id")).distinct().unionByName(pairs.select(F.col("l").alias("id")).distinct()).distinct()
    sets = _sets_of(docs, ids, special, k)
    a, b = sets.select(F.col("id").alias("rep"), F.col("sh").alias("sa")), sets.select(F.col("id").alias("l"), F.col("sh").alias("sb"))
    both = pairs.join(a, "rep").join(b, "l").select("rep", "l", F.size("sb").alias("ln"), F.array_except("sb", "sa").alias("missing"), F.array_except("sa", "sb").alias("added"))
    shared = F.col("ln") - F.size("missing")
    return both.withColumn("linked", 100 * shared >= percent * (F.col("ln") + F.size("added")))


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of each row: doc_id, t (its text's hash), n_shingles, set_a, set_b (of its set), label (of its group; null alone), component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("t"))
    profile = cut(docs.mapInPandas(trimmed(_profile(k)), "doc_id long, t long, n_shingles long, set_a long, set_b long, bands array<long>"))
    linked = profile.filter("doc_id is not null and n_shingles > 0")
    # What is joined back to the rows it was made of is cut, so that AQE can split hot keys in the join.
    classes = cut(linked.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")).withColumn("rep", F.col("low")))
    # An id that stands for several sets names the first; the others are named by a hash.
    shared = classes.groupBy("low").agg(F.count("*").alias("c"), F.min(F.struct("set_a", "set_b")).alias("first")).filter("c > 1")
    named = classes.drop("rep").join(shared, "low").filter("first <> struct(set_a, set_b)")
    special = cut(named.select("set_a", "set_b", "low", F.xxhash64("set_a", "set_b").alias("rep")))
    if special.isEmpty():
        special = None
    else:
        other = special.select("set_a", "set_b", F.col("rep").alias("other"))
        classes = cut(classes.join(other, ["set_a", "set_b"], "left").select("set_a", "set_b", "low", "copies", F.coalesce("other", "rep").alias("rep")))
    reps = linked.join(classes, ["set_a", "set_b"]).filter("doc_id = low").dropDuplicates(["rep"])
    banded = cut(reps.select("rep", F.col("n_shingles").alias("n"), "bands")).select("rep", "n", F.explode("bands").alias("band"))  # kept before they are dealt out

    def alike(x: str, y: str):
        """What sets of a link's size must be."""
        n, m = F.col(f"{x}n"), F.col(f"{y}n")
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    # Round 1: each representative with its bands' leaders. A band's leader is
    # the member that has most company in its bands, so what a family was copied from leads it.
    sizes = cut(banded.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1"))
    full = cut(banded.join(sizes, "band"))
    company = cut(full.groupBy("rep").agg(F.sum("c").alias("company")))
    central = F.min(F.struct((-F.col("company")).alias("x"), F.col("rep").alias("l"), F.col("n").alias("ln")))
    leaders = cut(full.join(company, "rep").groupBy("band").agg(central.alias("z")).select("band", "z.*").drop("x"))
    led = full.join(leaders, "band").filter(F.col("rep") != F.col("l"))
    # (In bands of two, a pair that isn't alike is of no further use; larger bands need the differences below.)
    pairs = led.filter(alike("", "l") | (F.col("c") > 2)).select("rep", "l").distinct()
    told = cut(_against_leaders(docs, pairs, special, k, percent))
    stars = components(told.filter("linked").select(F.col("l").alias("a"), F.col("rep").alias("b")))

    # Round 2: in bands whose members lie in several components, pairs of different ones. Each
    # member is its difference from the leader, so a pair's intersection is exact and cheap:
    # the leader's shingles less those that either lacks, plus those that both add.
    placed = cut(full.filter("c > 2").join(stars, full["rep"] == stars["node"], "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component", "c"))
    parts = placed.groupBy("band", "comp").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("c", "comp")).alias("x"), F.count("*").alias("parts")).filter("parts > 1").select("band", F.col("x.comp").alias("home"))
    mixed = cut(mixed.join(leaders.select("band", "l", "ln"), "band"))
    rest = placed.join(mixed, "band").join(told.select("rep", "l", "missing", "added"), ["rep", "l"], "left")
    none = F.array().cast("array<long>")
    rest = cut(rest.withColumn("missing", F.coalesce("missing", none)).withColumn("added", F.coalesce("added", none)))
    # In each of these bands the members outside of its largest component meet all members.
    cols = ("rep", "n", "comp", "missing", "added")
    x = rest.filter("comp <> home").select("band", *(F.col(c).alias(f"x_{c}") for c in cols))
    y = rest.select("band", "home", "ln", *(F.col(c).alias(f"y_{c}") for c in cols))
    shared = F.col("ln") - F.size(F.array_union("x_missing", "y_missing")) + F.size(F.array_intersect("x_added", "y_added"))
    size = lambda c: F.size(f"x_{c}"), lambda c: F.size(f"y_{c}")
    most = F.col("ln") - F.greatest(*(s("missing") for s in size)) + F.least(*(s("added") for s in size))  # what they can share at most
    enough = lambda both: 100 * both >= percent * (F.col("x_n") + F.col("y_n") - both)
    meet = y.join(
        x,
        (y["band"] == x["band"]) & (F.col("x_comp") != F.col("y_comp")) & ((F.col("y_comp") == F.col("home")) | (F.col("x_rep") < F.col("y_rep")))
        & alike("x_", "y_") & enough(most) & enough(shared),
    )
    found = meet.select(F.col("x_comp").alias("a"), F.col("y_comp").alias("b")).distinct()
    joins = components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b").unionByName(found))

    if special is None:  # the least node of a group is its least id
        joins = joins.withColumn("least", F.col("component"))
    else:
        joins = cut(joins.join(special.select(F.col("rep").alias("node"), "low"), "node", "left").withColumn("id", F.coalesce("low", "node")).drop("low"))
        joins = joins.drop("id").join(joins.groupBy("component").agg(F.min("id").alias("least")), "component")
    whole = classes.join(joins, classes["rep"] == joins["node"], "left").filter("copies > 1 or component is not null")
    whole = whole.select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.coalesce("component", "rep").alias("label"), F.coalesce("least", "low").alias("comp"))
    out = profile.join(whole, (profile["set_a"] == whole["_a"]) & (profile["set_b"] == whole["_b"]) & (profile["n_shingles"] > 0), "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    label = F.when(F.col("doc_id").isNotNull(), F.col("label"))
    return out.select("doc_id", "t", "n_shingles", "set_a", "set_b", label.alias("label"), comp.alias("component_id"), (comp.isNull() | (F.col("doc_id") == comp)).alias("kept"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. Documents are linked
    if 100 * |intersection| >= percent * |union| of their sets of k-word shingles."""
    return _grouped(docs, k, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; all columns stay."""
    rows = cut(_grouped(docs, k, percent, id_col, text_col).filter("label is not null").select("doc_id", "t", "set_a", "set_b", "label", "kept"))
    # Several rows of a group have its least id only where ids repeat.
    first = rows.filter("kept").groupBy("label").agg(F.min(F.struct("set_a", "set_b", "t")).alias("x"), F.count("*").alias("c")).filter("c > 1").select("label", "x", "c")
    ties = cut(rows.filter("kept").join(first, "label").select("doc_id", "t", (F.struct("set_a", "set_b", "t") == F.col("x")).alias("wins")))
    lost = rows.filter("not kept").select("doc_id", "t").unionByName(ties.filter("not wins").select("doc_id", "t"))
    again = ties.filter("wins").groupBy("doc_id", "t").count().filter("count > 1")
    names = lambda d: d.select(F.col("doc_id").alias("id"), "t").distinct()
    return drop_rows(docs, id_col, text_col, names(lost), names(again))


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept FROM s JOIN c ON s.doc_id = c.a
"""
