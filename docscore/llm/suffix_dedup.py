"""Passages that repeat across documents, by a sparse suffix array.

A suffix of a document is kept only where its minimiser is: of each window of MATCH words, the
place among its first MATCH - PREFIX + 1 words whose next GRAM words have the least hash. It
depends on the window's words alone, so two equal windows keep suffixes at the same place of
theirs, and these share at least PREFIX words.

The kept suffixes of all documents are sorted by the hash of their first PREFIX words, then by
document, over ranges that a sample balances, so a passage that very many documents share is
dealt over many ranges. Neighbours with equal prefixes form a run; runs at the ends of a range
are joined with those of the next by a small aggregate. A run that holds two documents is a
repeat, which is extended left and right: each suffix stands for the windows that chose it,
and their words together are its reach. If all members of a run have one reach, it repeats as
a whole. Otherwise the windows of its members are compared one by one, by their hashes.

The result is exact (but for collisions of 64-bit hashes): a word is covered if and only if
it is in a window of MATCH words that occurs in two documents.

Words are what white space separates, with A-Z lower-cased. Defined cases: a null text counts
as empty; texts with fewer words than MATCH have no repeats; repeats inside one document only
do not count; rows with a null id are not compared; rows that repeat an id are one document;
other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P, _PINV, _power, cut, key_bitmap, mix64, runs_of, slices, with_maybe, words_of

MATCH, PREFIX, GRAM = 50, 18, 4
BITS = 1 << 25  # of the filters: 1024 rows of 4 KB at most


def suffixes(h: np.ndarray, match: int = MATCH, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's word hashes: kept places, and the first and the last window that chose each."""
    n = len(h) - match + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    width = match - prefix + 1
    order = runs_of(h, GRAM)[: n + width - 1]
    place = np.arange(n) + np.lib.stride_tricks.sliding_window_view(order, width).argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], first, np.concatenate((first[1:], [n])) - 1


def _documents(f: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    ids, texts = f["doc_id"].tolist(), f["text"].tolist()
    for lo, hi in slices(texts):
        _, _, h, at = words_of(texts[lo:hi])
        for i, a, b in zip(ids[lo:hi], at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield i, h[a:b]


def _kept(match: int, prefix: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, h in _documents(f):
                place, lo, hi = suffixes(h, match, prefix)
                if len(place):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _power(_P, len(h)), dtype=np.uint64)))
                    reach = mix64((total[hi + match] - total[lo]) * _power(_PINV, len(h))[lo] + (hi - lo).astype(np.uint64))
                    for c, x in zip(cols, (runs_of(h, prefix)[place].view(np.int64), reach.view(np.int64), np.full(len(place), i), lo, hi), strict=True):
                        c.append(x)
            yield pd.DataFrame({k: np.concatenate(c) if c else np.zeros(0, np.int64) for k, c in zip(("key", "reach", "doc_id", "lo", "hi"), cols, strict=True)})

    return run


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare neighbours of sorted suffixes. Rows are runs of equal prefixes with their least and
    greatest document and reach; runs of one document go, but for the first and the last."""
    open_: tuple | None = None
    names = ("key", "d0", "d1", "r0", "r1")
    first = True
    for f in frames:
        if not len(f):
            continue
        key, doc, reach = (f[c].to_numpy() for c in ("key", "doc_id", "reach"))
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        runs = [key[at], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at), np.minimum.reduceat(reach, at), np.maximum.reduceat(reach, at)]
        out = np.stack(runs)
        if open_ is not None:
            if open_[0] == out[0, 0]:
                o = np.array(open_)
                out[[1, 3], 0] = np.minimum(out[[1, 3], 0], o[[1, 3]])
                out[[2, 4], 0] = np.maximum(out[[2, 4], 0], o[[2, 4]])
            else:
                out = np.concatenate((np.array(open_)[:, None], out), axis=1)
        open_ = tuple(out[:, -1].tolist())
        done = out[:, :-1]
        keep = done[1] != done[2]
        if first and done.shape[1]:
            keep[0] = True
            first = False
        yield pd.DataFrame(dict(zip(names, done[:, keep], strict=True)))
    if open_ is not None:
        yield pd.DataFrame(dict(zip(names, ([x] for x in open_), strict=True)))


def _windows(match: int, prefix: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, h in _documents(f):
                place, lo, hi = suffixes(h, match, prefix)
                if len(place):
                    keys, every = runs_of(h, prefix)[place].view(np.int64), runs_of(h, match).view(np.int64)
                    rows += [(k, i, a, every[a : b + 1]) for k, a, b in zip(keys.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["key", "doc_id", "lo", "windows"])

    return run


def repeats(docs: DataFrame, match: int = MATCH, prefix: int = PREFIX, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, n_words of each maximal stretch of covered words."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    kept = cut(docs.mapInPandas(_kept(match, prefix), "key long, reach long, doc_id long, lo long, hi long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = kept.select("key", "doc_id", "reach").repartitionByRange(parts, "key", "doc_id", "reach").sortWithinPartitions("key", "doc_id", "reach")
    runs = ordered.mapInPandas(_runs, "key long, d0 long, d1 long, r0 long, r1 long")
    whole = runs.groupBy("key").agg(F.min("d0").alias("d0"), F.max("d1").alias("d1"), F.min("r0").alias("r0"), F.max("r1").alias("r1"))
    found = cut(whole.filter("d0 <> d1").select("key", (F.col("r0") != F.col("r1")).alias("mixed")))

    maybe = with_maybe(kept.drop("reach"), F.col("key"), key_bitmap(found.select(F.col("key").alias("h")), BITS), "maybe", BITS).filter("maybe").drop("maybe")
    shared = cut(maybe.join(found, "key"))
    plain = shared.filter("not mixed").select("doc_id", "lo", "hi")

    # Runs whose members reach differently: their windows, one by one.
    mixed = found.filter("mixed").select("key")
    again = with_maybe(docs, F.xxhash64("doc_id"), key_bitmap(shared.filter("mixed").select(F.xxhash64("doc_id").alias("h"))), "maybe").filter("maybe").select("doc_id", "text")
    members = again.mapInPandas(_windows(match, prefix), "key long, doc_id long, lo long, windows array<long>")
    members = with_maybe(members, F.col("key"), key_bitmap(mixed.select(F.col("key").alias("h")), BITS), "maybe", BITS).filter("maybe").join(mixed, "key")
    each = cut(members.select("doc_id", "lo", F.posexplode("windows").alias("i", "w")).select("doc_id", (F.col("lo") + F.col("i")).alias("lo"), "w"))
    twice = cut(each.groupBy("w").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).filter("d0 <> d1").select("w"))
    single = each.join(twice, "w", "left_semi").select("doc_id", "lo", F.col("lo").alias("hi"))

    spans = plain.unionByName(single).select("doc_id", F.col("lo").alias("a"), (F.col("hi") + match).alias("b"))
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("s"))  # bounded by a document's length
    merged = F.expr(
        """aggregate(s, array(s[0]), (m, x) -> CASE WHEN x.a <= element_at(m, -1).b
           THEN concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).a AS a, greatest(element_at(m, -1).b, x.b) AS b)))
           ELSE concat(m, array(x)) END)"""
    )
    out = per.select("doc_id", F.explode(merged).alias("m"))
    return out.select("doc_id", F.col("m.a").alias("start_word"), F.col("m.b").alias("end_word"), (F.col("m.b") - F.col("m.a")).alias("n_words"))


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
