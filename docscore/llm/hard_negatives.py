"""Hard negatives by product quantisation with stored residual norms.

Vectors are made whole numbers first, so scores are exact integers. A quantiser (codebooks of
2-dimensional parts, trained on a bounded sample of rows) codes every row: one byte a part, and
the norm of what each part's centroid leaves. For a block of anchors a table of scores by part
and centroid is made once; a row's score is the sum of its table entries, off by no more than
the sum over the parts of (norm of the anchor's part) x (residual norm of the row's). These bounds are
rigorous, so rows whose bound is under the best found so far, or outside a window, go without
their score being taken; all others are scored exactly in whole numbers.

Anchors are a stated query set against all rows. They are taken in waves of at most about
``Settings.wave`` (dealt by a hash of their id and place, so an id that many rows have is dealt
too), so what is sent to the tasks is bounded whatever
the data; in a wave each task goes through its own rows, block by block:

1. of the rows of an anchor's label the best ``positives`` of each task, then of all tasks;
2. for each positive, the best ``negatives`` of other labels whose score is inside its window,
   of each task, then of all tasks.

So only a few rows per anchor and task are ever moved; a label that a third of all rows have
stays where it is.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no
part; vectors shorter than the longest count as filled up with zeros; scaled components from 2**25
on raise an error, as scores might not fit; rows with a null id are candidates (last among equal
scores) but never anchors. Every row counts, also those that repeat an id, and each anchor row
gives its own rows; but rows with the anchor's own id are neither its positives nor negatives. An
anchor without positives, and a positive without negatives inside its window, give no row. Other
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spark_of, trimmed

#: Components of one part, and centroids of one part's codebook.
PART, CENTROIDS = 2, 256
_LARGE = 1 << 25
_LAST = (1 << 63) - 1  # stands for a null id, after all others


@dataclass(frozen=True)
class Settings:
    """Rows that the quantiser is trained on and its rounds; anchors of a wave; what is mined."""

    sample: int = 4096
    rounds: int = 8
    wave: int = 8192
    positives: int = 5
    negatives: int = 3
    low: int = 50  # per cent of the positive's score
    high: int = 95


DEFAULT = Settings()


def whole_vectors(rows: DataFrame, id_col: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """id, label and v: floor(scale * x) of each component; rows that take no part are left out."""
    large = F.raise_error(F.lit("a component is too large for exact scores")).cast("int")
    x = lambda c: F.floor(c.cast("double") * scale)
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    whole = F.transform(vector, lambda c: F.when(F.abs(c.cast("double") * scale) < _LARGE, x(c).cast("int")).otherwise(large))
    rows = rows.filter(label.isNotNull() & F.col(vector).isNotNull() & F.forall(vector, fine))
    return rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))


class Quantiser:
    """Codebooks of PART components each."""

    def __init__(self, sample: np.ndarray, rounds: int):
        parts = sample.shape[1] // PART
        x = sample.reshape(len(sample), parts, PART).astype(float)
        spread = np.lexsort((x[:, :, 1].T, x[:, :, 0].T), axis=-1)  # of each part: its rows in order
        at = np.linspace(0, max(len(x) - 1, 0), CENTROIDS).astype(int)
        self.books = np.stack([x[spread[p][at], p] for p in range(parts)]) if len(x) else np.zeros((parts, CENTROIDS, PART))
        for _ in range(rounds if len(x) else 0):
            for p in range(parts):
                near = self._near(x[:, p], p)
                n = np.bincount(near, minlength=CENTROIDS)
                total = np.stack([np.bincount(near, x[:, p, d], CENTROIDS) for d in range(PART)], 1)
                self.books[p][n > 0] = total[n > 0] / n[n > 0, None]

    def _near(self, x: np.ndarray, p: int) -> np.ndarray:
        book = self.books[p]
        return np.argmin((book**2).sum(1) - 2 * (x @ book.T), 1)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and norms of the residuals of each part."""
        x = v.reshape(len(v), -1, PART).astype(float)
        codes = np.stack([self._near(x[:, p], p) for p in range(len(self.books))], 1)
        left = x - self.books[np.arange(len(self.books)), codes]
        return codes.astype(np.uint8), np.sqrt((left**2).sum(2))


class Anchors:
    """A wave of anchors: their vectors, labels and tables of scores by part and centroid, made block by block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v

    def bounds(self, which: np.ndarray, q: Quantiser, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each coded row for each of these anchors."""
        a = self.v[which].reshape(len(which), -1, PART).astype(float)
        tables = np.einsum("apd,pkd->pak", a, q.books)
        score = np.zeros((len(which), len(codes)))
        for p in range(len(q.books)):
            score += tables[p][:, codes[:, p]]
        norms = np.sqrt((a**2).sum(2))
        # the last two terms are far above what rounding of doubles may change
        off = norms @ left.T + 0.5 + 1e-9 * norms.sum(1)[:, None] * (1 + np.abs(q.books).max(initial=0))
        return score - off, score + off


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each group by score, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(head, np.diff(np.concatenate((head, [len(g)]))))
    return order[rank < n]


_BLOCK_ROWS, _BLOCK_ANCHORS = 4096, 128


def _blocks(f: pd.DataFrame, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels, vectors, codes and residual norms of blocks of rows."""
    for lo in range(0, len(f), _BLOCK_ROWS):
        b = f.iloc[lo : lo + _BLOCK_ROWS]
        ids = b["id"].astype("Int64").fillna(_LAST).to_numpy(np.int64)
        v = np.frombuffer(b"".join(b["v"]), "<i4").reshape(len(b), -1)
        codes = np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), parts)
        yield ids, b["label"].to_numpy(np.int64), v, codes, np.frombuffer(b"".join(b["left"]), "<f8").reshape(len(b), parts)


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; minus infinity where there are fewer."""
    return -np.partition(-x, k - 1, 1)[:, k - 1] if x.shape[1] >= k else np.full(len(x), -np.inf)


_POSITIVE = "anchor int, id long, score long"


def _positives(anchors, quantiser, k: int):
    """Of each task's rows the best k of each anchor's own label."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, q = anchors.value, quantiser.value
        kept = tuple(np.zeros(0, np.int64) for _ in range(3))  # anchor, id, score
        floor = np.full(len(a.ids), -np.inf)
        for f in frames:
            for ids, labels, v, codes, left in _blocks(f, len(q.books)):
                for label in np.unique(labels).tolist():
                    mine, rows = np.flatnonzero(a.labels == label), np.flatnonzero(labels == label)
                    for lo in range(0, len(mine), _BLOCK_ANCHORS):
                        w = mine[lo : lo + _BLOCK_ANCHORS]
                        low, high = a.bounds(w, q, codes[rows], left[rows])
                        other = a.ids[w][:, None] != ids[rows][None, :]
                        least = np.maximum(floor[w], _kth(np.where(other, low, -np.inf), k))
                        x, y = np.nonzero(other & (high >= least[:, None]))
                        got = (w[x], ids[rows[y]], _scores(a.v[w[x]], v[rows[y]]))
                        kept = tuple(np.concatenate(z) for z in zip(kept, got, strict=True))
                best = _best(kept[0], kept[2], kept[1], k)
                kept = tuple(z[best] for z in kept)
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(floor)) >= k)
                worst = np.full(len(floor), np.inf)
                np.minimum.at(worst, kept[0], kept[2])
                floor[full] = worst[full]
        yield _frame(*kept, names=("anchor", "id", "score"))

    return trimmed(run)


def _frame(*columns: np.ndarray, names: tuple[str, ...]) -> pd.DataFrame:
    out = pd.DataFrame(dict(zip(names, columns, strict=True)))
    out["id"] = out["id"].astype("Int64").mask(out["id"] == _LAST)
    return out


_NEGATIVE = "place int, id long, score long"


def _negatives(anchors, quantiser, windows, k: int):
    """Of each task's rows, for each positive the best k of other labels inside its window. ``windows``:
    anchor, lowest and highest score of each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, q, (owner, lowest, highest) = anchors.value, quantiser.value, windows.value
        kept = tuple(np.zeros(0, np.int64) for _ in range(3))  # window, id, score
        floor = lowest.astype(float)
        asked = np.unique(owner)
        first = np.searchsorted(owner, np.arange(len(a.ids) + 1))
        for f in frames:
            for ids, labels, v, codes, left in _blocks(f, len(q.books)):
                for lo in range(0, len(asked), _BLOCK_ANCHORS):
                    w = asked[lo : lo + _BLOCK_ANCHORS]
                    low, high = a.bounds(w, q, codes, left)
                    other = (a.labels[w][:, None] != labels[None, :]) & (a.ids[w][:, None] != ids[None, :])
                    for n in range(int((first[w + 1] - first[w]).max(initial=0))):  # the n-th window of each
                        has = np.flatnonzero(first[w] + n < first[w + 1])
                        p = first[w[has]] + n
                        top, bottom = highest[p][:, None], floor[p][:, None]
                        own, hi, ok = low[has], high[has], other[has]
                        sure = np.where(ok & (own >= bottom) & (hi <= top), own, -np.inf)
                        least = np.maximum(bottom, _kth(sure, k)[:, None])
                        x, y = np.nonzero(ok & (hi >= least) & (own <= top))
                        score = _scores(a.v[w[has[x]]], v[y])
                        inside = (score >= lowest[p[x]]) & (score <= highest[p[x]])
                        got = (p[x[inside]], ids[y[inside]], score[inside])
                        kept = tuple(np.concatenate(z) for z in zip(kept, got, strict=True))
                best = _best(kept[0], kept[2], kept[1], k)
                kept = tuple(z[best] for z in kept)
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(floor)) >= k)
                worst = np.full(len(floor), np.inf)
                np.minimum.at(worst, kept[0], kept[2])
                floor[full] = worst[full]
        yield _frame(*kept, names=("place", "id", "score"))

    return trimmed(run)


def _first(rows: DataFrame, group: str, n: int) -> DataFrame:
    """The first n of each group by score, then id; those of one task are fewer than n already."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _coded(rows: DataFrame, q, width: int) -> DataFrame:
    """Rows with their vector, codes and residual norms as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantiser = q.value
        for f in frames:
            for lo in range(0, len(f), _BLOCK_ROWS):
                b = f.iloc[lo : lo + _BLOCK_ROWS]
                v = _matrix(b["v"], width)
                codes, left = quantiser.encode(v)
                yield pd.DataFrame({"id": b["id"].astype("Int64"), "label": b["label"], "v": [x.tobytes() for x in v.astype("<i4")], "codes": [x.tobytes() for x in codes], "left": [x.tobytes() for x in left]})

    return rows.mapInPandas(trimmed(run), "id long, label long, v binary, codes binary, left binary")


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor: Column, settings: Settings = DEFAULT) -> DataFrame:
    """``rows``: id, label, v (see whole_vectors). For each anchor and each of its best positives the best
    negatives inside the positive's window: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark, sc = spark_of(rows), spark_of(rows).sparkContext
    rows = cut(rows)
    width = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, PART)
    width += -width % PART
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(settings.sample).select("v").collect()  # bounded
    quantiser = sc.broadcast(Quantiser(_matrix([r["v"] for r in sample], width), settings.rounds))
    coded = cut(_coded(rows, quantiser, width).withColumn("place", F.monotonically_increasing_id()))
    asked = coded.filter(is_anchor & F.col("id").isNotNull())
    waves = -(-asked.count() // settings.wave)
    codes, out = coded.drop("place"), None
    for n in range(waves):
        wave = asked.filter(F.pmod(F.xxhash64("id", "place"), F.lit(waves)) == n).select("id", "label", "v").collect()  # about settings.wave rows
        if not wave:
            continue
        v = np.frombuffer(b"".join(bytes(r["v"]) for r in wave), "<i4").reshape(len(wave), -1)
        anchors = sc.broadcast(Anchors(np.array([r["id"] for r in wave], np.int64), np.array([r["label"] for r in wave], np.int64), v))
        near = _first(codes.mapInPandas(_positives(anchors, quantiser, settings.positives), _POSITIVE), "anchor", settings.positives)
        pairs = sorted((r["anchor"], r["rank"], r["id"], r["score"]) for r in near.collect())  # at most ``positives`` an anchor
        owner, score = (np.array([p[i] for p in pairs], np.int64) for i in (0, 3))
        low, high = -(-settings.low * score // 100), settings.high * score // 100  # whole scores inside the window
        windows = sc.broadcast((owner, low, high))
        found = _first(codes.mapInPandas(_negatives(anchors, quantiser, windows, settings.negatives), _NEGATIVE), "place", settings.negatives)
        names = spark.createDataFrame([(i, wave[p[0]]["id"], p[2], p[3]) for i, p in enumerate(pairs)], "place int, anchor_id long, positive_id long, positive_score long")
        mined = found.join(F.broadcast(names), "place").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        mined = cut(mined) if waves > 1 else mined
        out = mined if out is None else out.unionByName(mined)
    return out if out is not None else spark.createDataFrame([], MINED)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(whole_vectors(rows, "vec_id", "embedding", label), F.col("id") % 50 == 0)
