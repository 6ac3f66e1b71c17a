"""Sequence packing by non-negative least squares over a length histogram.

Each document becomes ids plus an end id; it is cut at every multiple of the window, so what
is left of it is one piece shorter than a window. Only (length, count) of all pieces goes to
the driver: at most WINDOW rows, whatever the data. There

1. shallow combinations of up to DEPTH length classes (UNIT tokens wide, a piece taking its
   class's upper bound) that exactly fill a window are enumerated,
2. their repeat counts are solved against the histogram by non-negative least squares,
   rounded down and limited to the pieces there are, and
3. what is left is packed greedily by exact lengths: the longest piece first, then again and
   again the longest that fits, each pattern repeated as often as its pieces last.

The result is a table of segments: of the pieces of one length, those of rank lo to hi - 1 go
to these sequences and slots. Its size is bounded by the number of lengths and patterns (some
ten thousand rows), so it is broadcast. A piece's rank among those of its length is its
number within a salt (a hash of its document) plus the counts of the salts before, so a
length that a third of all rows have is ranked by many tasks.

Defined cases: a null or empty text is its end id alone; rows that repeat an id are packed
each by itself; a null id stays null; other columns do not matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, held, trimmed

WINDOW, UNIT, DEPTH, END_ID = 4096, 16, 3, 2
CACHE_WORDS = 450_000

_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: Characters for which lower() and re act like the tokenizer's own normaliser and pattern.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ňŊ-ſ‐-‧‰-‸€]*")
_CONTROL = re.compile("[\x1c-\x1f]")  # white space for Python alone
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordIds:
    """Ids of texts as little-endian 32-bit bytes; distinct words are encoded once by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the workers are parallel already
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # of the ids that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}  # of words that never stand alone
        self.chunks: dict[str, bytes] = {}  # of what white space separates

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        get = self.chunks.get
        out: list[bytes | None] = []
        open_: list[tuple[int, list[str], list[bytes | None], list[int]]] = []  # texts with chunks that are new
        for t in texts:
            if (t.isascii() or _PLAIN.fullmatch(t)) and not (_CONTROL.search(t) or "<|" in t and _SPECIAL.search(t)):
                c = t.lower().split()  # no word of the pattern holds white space
                found = [*map(get, c)]
                if None in found:
                    open_.append((len(out), c, found, [i for i, x in enumerate(found) if x is None]))
                    out.append(None)
                else:
                    out.append(b"".join(found))
            else:
                out.append(self._whole(t))
        new = list({c[i] for _, c, _, at in open_ for i in at})
        if new:
            words = {c: ws for c in new if not c.isalpha() and len(ws := _WORD.findall(c)) != 1}  # letters alone are one word
            self._learn([c for c in new if c not in words], self.chunks)  # a word by itself is kept once
            self._learn(list({w for ws in words.values() for w in ws if w not in self.known and w not in self.chunks}), self.known)
            self.chunks.update([(c, b"".join([self.known[w] if w in self.known else self.chunks[w] for w in ws])) for c, ws in words.items()])
        for k, c, found, at in open_:
            for i in at:
                found[i] = self.chunks[c[i]]
            out[k] = b"".join(found)
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str], into: dict[str, bytes]) -> None:
        """Each word is a pre-token of its own, so many are encoded in one call and told apart by the ids that end words."""
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            b = ids.tobytes()
            if len(at) != len(part) + 1 or at[-1] != len(b):  # not one pre-token each
                into.update((w, self._whole(w)) for w in part)
            else:
                into.update(zip(part, (b[x:y] for x, y in pairwise(at)), strict=True))


def batches(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts (null: empty) of about ``most`` characters, so that memory is bounded."""
    out, size = [], 0
    for t in texts:
        out.append(t or "")
        size += len(out[-1])
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _pieces(tokenizer: str, window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = held(("ids", tokenizer), lambda: WordIds(tokenizer))
        end = np.array([END_ID], "<u4").tobytes()
        for f in frames:
            rows, ids = [], iter(f["doc_id"].tolist())
            for texts in batches(f["text"].tolist()):
                for b in encoder.encode(texts):
                    b += end
                    n, i = len(b) // 4, next(ids)
                    for at in range(0, n, window):
                        part = b[4 * at : 4 * (at + window)]
                        rows.append((i, at, len(part) // 4, zlib.crc32(part), n))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


# --- the plan, from the histogram alone ----------------------------------------------


def nnls(columns: list[dict[int, int]], target: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, by active sets; a column is {row: coefficient}."""
    n, m = len(columns), len(target)
    if not n or not target.any():
        return np.zeros(n)
    a = np.zeros((m, n), np.float32)
    for j, c in enumerate(columns):
        for i, v in c.items():
            a[i, j] = v
    scale = float(target.max())
    b = target / scale
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = a.T @ (b - a[:, active] @ x[active])
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-7:
            break
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, idx].astype(float), b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[idx] = z
                break
            low = z <= 1e-12
            step = x[idx][low] / np.maximum(x[idx][low] - z[low], 1e-300)
            x[idx] += step.min() * (z - x[idx])
            gone = idx[low & (x[idx] <= 1e-12)]
            if not len(gone):
                gone = idx[low][[int(np.argmin(step))]]
            x[gone] = 0
            active[gone] = False
    return x * scale


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of 2 to ``depth`` classes 1..bins whose sum is ``bins``, largest first."""
    out: list[tuple[int, ...]] = []

    def grow(part: tuple[int, ...], rest: int) -> None:
        if not rest:
            out.append(part)
        elif len(part) < depth:
            for q in range(min(rest, part[-1] if part else bins - 1), 0, -1):
                if q * (depth - len(part)) >= rest:
                    grow((*part, q), rest - q)

    grow((), bins)
    return out


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, lo, hi, sequence, repeats, slot): the piece of rank r of a length, lo <= r < hi,
    goes to sequence + (r - lo) % repeats, at slot + (r - lo) // repeats."""
    left, used, out, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0

    def take(length: int, n: int, first: int, repeats: int, slot: int) -> None:
        lo = used[length]
        out.append((length, lo, lo + n, first, repeats, slot))
        used[length] += n
        left[length] -= n

    if left.get(window):
        n = left[window]
        take(window, n, 0, n, 0)
        sequence = n
    bins = window // unit
    inside: dict[int, list[int]] = {}
    for length in sorted(left, reverse=True):
        if left[length]:
            inside.setdefault(-(-length // unit), []).append(length)
    have = np.zeros(bins + 1)
    for q, ls in inside.items():
        have[q] = sum(left[x] for x in ls)
    ways = [c for c in combinations(bins, depth) if all(have[q] for q in c)]
    x = nnls([{q: c.count(q) for q in set(c)} for c in ways], have)
    for j in np.argsort(-x, kind="stable"):
        c = ways[j]
        m = int(min(np.floor(x[j] + 1e-6), *(have[q] // c.count(q) for q in set(c))))
        if m < 1:
            continue
        for slot, q in enumerate(c):
            have[q] -= m
            done = 0
            while done < m:
                length = inside[q][0]
                n = min(m - done, left[length])
                take(length, n, sequence + done, n, slot)
                done += n
                if not left[length]:
                    inside[q].pop(0)
        sequence += m
    lengths = sorted(n for n in left if left[n])
    while lengths:
        room, pattern, at = window, [], len(lengths)
        while room and at:
            at = int(np.searchsorted(lengths[:at], room, "right"))
            if at:
                length = lengths[at - 1]
                pattern.append((length, min(left[length], room // length)))
                room -= length * pattern[-1][1]
                at -= 1
        m, slot = min(left[length] // n for length, n in pattern), 0
        for length, n in pattern:
            take(length, m * n, sequence, m, slot)
            slot += n
        sequence += m
        lengths = [n for n in lengths if left[n]]
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = cut(
        docs.mapInPandas(trimmed(_pieces(tokenizer, window)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    )
    counts = cut(pieces.groupBy("length", "salt").agg(F.count("*").alias("c")))
    histogram = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most ``window`` rows
    before = counts.select("length", "salt", (F.sum("c").over(Window.partitionBy("length").orderBy("salt")) - F.col("c")).alias("before"))
    segments = spark.createDataFrame(plan(histogram, window), "length long, lo long, hi long, first long, repeats long, slot long")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("before")).drop("within", "before", "salt")
    s = F.broadcast(segments.withColumnRenamed("length", "l"))
    placed = ranked.join(s, (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    r = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("first") + r % F.col("repeats")).withColumn("place", F.col("slot") + F.floor(r / F.col("repeats")))
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place")) - F.col("length")
    return placed.withColumn("offset", offset).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_nnls_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
