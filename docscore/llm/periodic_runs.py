"""Runs: stretches of words that repeat with a period, found by the Lyndon words that they hold.

A run of period q holds, under one of two orders of the words (one the other's reverse), a Lyndon
word of length q that starts at some place and is the longest Lyndon word to start there. For each
order a stack, filled from right to left, gives every place its longest Lyndon word: suffixes
that are greater than the one at hand are what the stack keeps, so the place below is where the
word ends. Suffixes are compared, and candidates extended to both sides, by the length of their
longest common extension: a binary search over rolling hashes of prefixes, whose answer is then
compared word by word (stretches of one distance that were compared before are not again), so a
clash of hashes cannot change a result. No suffix array is built.

Words are looked at only where a run can be. In a run of length max(6, 4q) or more every five
consecutive words come twice at least, and so do the five that would extend it; so a text is cut
at words that are in no repeated five, which loses nothing, and the stacks see what is left.
Repeated fives are found by hashes on the text's bytes; words that are left get numbers by their
bytes, so unequal words never count as equal.

Defined cases: a null or empty text, or one of white space alone, has no words and no run; other
columns do not matter; rows that repeat an id each get their row; a row with a null id is not
rewritten by op11; a text of one word repeated is one run and takes time in proportion to its
length, but for logarithms; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P, _PINV, _power, mix64, runs_of, slices, trimmed, words_of

#: A run counts from this length, and from this many periods.
LENGTH, PERIODS = 6, 4
#: Words that come twice, in a row, throughout any run that counts: LENGTH - (_FIVE - 1) >= 2 and PERIODS * q - (_FIVE - 1) >= 2 * q.
_FIVE = 5
_MASK = (1 << 64) - 1


class Extensions:
    """Longest common extensions of places in a list of numbers."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        h = mix64(np.array(words, np.uint64) + np.uint64(1))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _power(_P, self.n), dtype=np.uint64)))
        self.total = self.sums.tolist()
        self.powers = _power(_P, self.n + 1).tolist()
        self.compared: dict[int, tuple[int, int]] = {}  # of a distance: a stretch known to equal the one that far on

    def _alike(self, i: int, j: int, n: int) -> bool:
        """Whether the hashes of n words from i and from j, i < j, are equal."""
        t = self.total
        return ((t[i + n] - t[i]) * self.powers[j - i] - t[j + n] + t[j]) & _MASK == 0

    def _search(self, most: int, alike) -> int:
        """The greatest length up to ``most`` that is alike: doubling, then halving."""
        low, high = 0, 1
        while high <= most and alike(high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if alike(mid) else (low, mid)
        return low

    def _differ(self, i: int, j: int, n: int) -> int:
        """Where the n words from i and from j first differ, word by word; n if nowhere."""
        d, end, w = j - i, i + n, self.words
        low, high = self.compared.get(d, (0, 0))
        if low <= i and end <= high:
            return n
        part = low if i < low <= end <= high else end
        if w[i:part] != w[i + d : part + d]:
            return next(k for k in range(n) if w[i + k] != w[j + k])
        self.compared[d] = (min(low, i), max(high, end)) if low <= end and i <= high and high else (i, end)
        return n

    def right(self, i: int, j: int) -> int:
        """How many words from i and from j, i < j, are equal."""
        n = self._search(self.n - j, lambda x: self._alike(i, j, x))
        return n if not n else self._differ(i, j, n)

    def left(self, i: int, j: int) -> int:
        """How many words before i and before j, i < j, are equal."""
        n = self._search(i, lambda x: self._alike(i - x, j - x, x))
        w = self.words
        if n and w[i - n : i] != w[j - n : j]:
            return next(k for k in range(n) if w[i - 1 - k] != w[j - 1 - k])
        return n


def lyndon_ends(words: list[int], longest: Extensions, reverse: bool) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there; the end of the list is
    smaller than every word, under either order."""
    n = len(words)
    w = [-x for x in words] if reverse else words
    ends, stack = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        a = w[i]
        while (j := stack[-1]) < n:
            b = w[j]
            if b < a:
                break
            if a == b:
                same = longest.right(i, j)
                if j + same == n or w[j + same] < w[i + same]:
                    break
            stack.pop()
        ends[i] = j
        stack.append(i)
    return ends


def runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs that count, by start and period."""
    n = len(words)
    if n < LENGTH:
        return []
    longest, found = Extensions(words), set()
    at, t = np.arange(n), longest.sums
    for reverse in (False, True):
        p = np.array(lyndon_ends(words, longest, reverse)) - at
        i = at[2 * p <= n - at]  # at least one place of a run of three periods or more has its word twice
        q = p[i]
        i, q = (x[(t[i + q] - t[i]) * _power(_P, n + 1)[q] == t[i + 2 * q] - t[i + q]] for x in (i, q))
        covered = (0, 0, 0)
        for k in np.lexsort((i, q)).tolist():
            s, period = int(i[k]), int(q[k])
            if covered[0] == period and s + 2 * period <= covered[2]:
                continue  # in the run found last
            end = s + period + longest.right(s, s + period)
            start = s - longest.left(s, s + period)
            if end - start < 2 * period:
                continue  # its hashes clashed
            covered = (period, start, end)
            if end - start >= max(LENGTH, PERIODS * period):
                found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _hot(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the words of several texts (hashes; first word of each text), those in five consecutive ones that their text has twice."""
    out = np.zeros(len(h) + 1, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    five = runs_of(h, _FIVE)
    at = np.flatnonzero(text[: len(five)] == text[_FIVE - 1 :]) if len(five) else five
    if len(at):
        key = five[at] ^ mix64(text[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        np.add.at(out, twice, 1)
        np.add.at(out, twice + _FIVE, -1)
    return np.cumsum(out)[:-1] > 0


def rewritten(n: int, doc_id: int | None) -> np.ndarray | None:
    """The word that stands at each place of a text of n words, where op11's rule repeats some of it; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def text_runs(texts: list[str | None], order: list[np.ndarray | None] | None = None) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """For each text its runs (start, length, period) and the words that no run drops. ``order``: the
    original number of the word that stands at each place, for texts that are to be read so."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts, ends, hashes, first = words_of(texts, lower=False)
    order = order or [None] * len(texts)
    for k, o in enumerate(order):
        if o is not None:
            lo, hi = first[k], first[k + 1]
            for a in (starts, ends, hashes):
                a[lo:hi] = a[lo:hi][o]
    hot = _hot(hashes, first)
    for k, b in enumerate(raw):
        lo, hi = int(first[k]), int(first[k + 1])
        s, e = starts[lo:hi], ends[lo:hi]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hot[lo:hi], [False])).view(np.int8))).tolist()
        found: list[tuple[int, int, int]] = []
        for x, y in zip(edge[::2], edge[1::2], strict=True):
            number: dict[bytes, int] = {}
            part = [number.setdefault(b[p:q], len(number)) for p, q in zip(s[x:y].tolist(), e[x:y].tolist(), strict=True)]
            found += [(x + start, length, period) for start, length, period in runs(part)]
        found.sort(key=lambda r: (r[0], r[2]))
        if order[k] is None and not found:
            yield found, b.split()  # bytes are split at the same white space
            continue
        kept = np.ones(hi - lo, bool)
        for start, length, period in found:
            kept[start + period : start + length] = False
        yield found, [b[p:q] for p, q in zip(s[kept].tolist(), e[kept].tolist(), strict=True)]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; ties by start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(rule):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = [None if pd.isna(i) else int(i) for i in f["doc_id"].tolist()]
            texts, rows = f["text"].tolist(), []
            for lo, hi in slices(texts):
                part = texts[lo:hi]
                order = [rule(len((t or "").encode("utf-8", "surrogatepass").split()), i) if i is not None and zlib.crc32(str(i).encode()) % 10 == 0 else None for t, i in zip(part, ids[lo:hi], strict=True)] if rule else None
                for i, (found, kept) in zip(ids[lo:hi], text_runs(part, order), strict=True):
                    best = strongest(found)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
                    rows.append((i, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
            yield out.astype(dict.fromkeys(("doc_id", "start", "length", "period", "exponent_milli"), "Int64"))

    return trimmed(run)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length and period (in words) of every run, one row each, and the words of its first period."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, ids, rows = f["text"].tolist(), f["doc_id"].tolist(), []
            for lo, hi in slices(texts):
                for i, t, (found, _) in zip(ids[lo:hi], texts[lo:hi], text_runs(texts[lo:hi]), strict=True):
                    words = (t or "").encode("utf-8", "surrogatepass").split() if found else []
                    rows += [(i, s, n, p, b" ".join(words[s : s + p]).decode("utf-8", "replace")) for s, n, p in found]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "period", "words"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(trimmed(run), "doc_id long, start long, length long, period long, words string")


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the words of each text that repeat a run's first period left out, and one space between words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, out = f[text_col].tolist(), []
            for lo, hi in slices(texts):
                out += [b" ".join(kept).decode("utf-8", "replace") for _, kept in text_runs(texts[lo:hi])]
            f[text_col] = [None if t is None else x for t, x in zip(texts, out, strict=True)]
            yield f

    return docs.mapInPandas(trimmed(run), docs.schema)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInPandas(_digests(rewritten), SCHEMA)
