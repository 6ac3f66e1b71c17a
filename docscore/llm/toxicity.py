"""Toxicity by a support vector machine on a subsequence string kernel, with Nystrom landmarks.

A text is read as characters in CLASSES classes: a-z, the letters from U+00E0 to U+00FF (one
class each, upper case with lower), all other letters by code point modulo 32 (those above U+FFFF
that stand for a plain letter, as mathematical ones do, as that letter), digits, and all
that stands between words, of which a run counts as one. It is cut into sentences at stops and
line ends (but not after a single letter, as in "i. d. i."). A sentence is scored by its worst
part: a part is a word, or neighbouring words of JOINED letters or fewer together, so
that an insult with blanks or marks put in is one part too; words of over LONGEST letters are
read in overlapping parts.

The kernel of two parts compares their common subsequences of three characters, gaps allowed:
one that spans s characters counts DECAY**s, with spans up to SPAN. So characters that were
put in between cost a factor and do not hide an insult. It is scaled by the parts' lengths.

Training, on sentences of at most ``max_labelled`` labelled documents:
1. sequences of FRAGMENT characters that occur in toxic documents far above chance give each
   part a first score;
2. of each document the ``sentences`` sentences that score highest are labelled: those of
   clean documents clean, those of toxic ones toxic if they score over zero. Each stands for
   itself by its worst part. Clean documents also give ``others`` parts chosen by a hash;
3. landmarks are chosen among these parts, farthest first; the kernel to the landmarks,
   times the inverse root of their own kernel matrix, maps parts to vectors, and a linear
   machine with squared hinge loss is trained there, also on variants of toxic parts that
   have characters put in;
4. 2. and 3. are repeated, with the machine's scores and with all clean parts kept so far;
5. a logistic curve turns a document's two worst parts (in different places, with different
   scores) into its score: one part may be an insult by chance of spelling. It weighs the worst
   part's score, and how far both are over zero.

Since there are finitely many subsequences, landmarks and machine collapse into one weight a
subsequence: CLASSES**3 numbers, sent with the scoring task, which reads whole texts.

The sample's bounds are those of ``Settings``; nothing else is bounded. Scores are sums of
integers, so the model depends neither on batches nor on partitions.

Defined cases: a null text counts as empty; a text without words has the score of a sentence
like none of the landmarks; without toxic or without clean labelled rows, or without any
telling sequence, every score is 0; labels that are null are not used; a labelled id that
repeats counts once for each label and row; other columns do not matter; texts of over PIECE
characters are read in pieces that overlap by OVERLAP / 2 characters or more, after runs of
one repeated mark have become two of it, so only a part that other marks stretch over more
than that is not seen.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, trim, trimmed, unused

DECAY, SPAN, CLASSES = 0.6, 7, 64
JOINED, LONGEST = 10, 24
WIDEST = LONGEST + 2  # characters of a part, with what stands before and after it
FRAGMENT, RIDGE, BIAS = 6, 1e-6, -1.0
PIECE, OVERLAP = 1 << 17, 2048
_END, _BETWEEN, _DIGIT, _LETTER = 0, 1, 3, 4
_STOP, _LINE = 62, 63  # while a text is cut into sentences
_RUN = re.compile(r"(\W)\1+")


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample that the classifier is fitted on."""

    max_labelled: int = 8_000  # documents, in the order of a hash of their ids
    max_fragments: int = 3_000  # telling sequences, the most telling first
    sentences: int = 5  # of a document, those that score highest
    others: int = 6  # parts of a clean document that a hash chooses
    max_parts: int = 16_000  # clean parts; those that were met most often come first
    pool: int = 2_000  # parts among which landmarks are chosen
    landmarks: int = 600
    rounds: int = 7  # of choosing parts and landmarks anew


def _class(c: str) -> int:
    if c in ".!?":
        return _STOP
    if c in "\n\r\x0b\x0c\x85  ":
        return _LINE
    low = c.lower()[0]
    if "a" <= low <= "z":
        return _LETTER + ord(low) - 97
    if c.isdigit():
        return _DIGIT
    return 30 + ord(low) % 32 if c.isalpha() else _BETWEEN


_table: list[np.ndarray] = []
_space: list[np.ndarray] = []


def _classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all characters, with _END between sentences, and where each text begins (and the end)."""
    if not _table:
        _space.append(np.array([chr(i).isspace() for i in range(0x10000)]))
        _table.append(np.array([_class(chr(i)) for i in range(0x10000)], np.uint8))
    raw = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.cumsum([0, *(len(t) + 1 for t in texts)])  # the line end before each text, and the last one
    c = _table[0][np.minimum(raw, 0xFFFF)]
    high = np.flatnonzero(raw > 0xFFFF)
    if len(high):
        kinds, of = np.unique(raw[high], return_inverse=True)
        c[high] = np.array([_class(unicodedata.normalize("NFKD", chr(k))[0]) for k in kinds.tolist()], np.uint8)[of]
    word = (c >= _DIGIT) & (c < _STOP)
    single = np.zeros(len(c), bool)  # after a word of one character
    single[1:] = word[:-1]
    single[2:] &= ~word[:-2]
    after = np.append(c[1:], _LINE)
    space = _space[0][np.minimum(raw, 0xFFFF)]
    ends = ((c == _LINE) | (c == _STOP) & ((after == _STOP) | np.append(space[1:], True))) & ~single
    c = np.where(ends, _END, np.where(c >= _STOP, _BETWEEN, c)).astype(np.uint8)
    c[edge] = _END
    between = c <= _BETWEEN
    keep = np.ones(len(c), bool)
    keep[1:] = ~(between[1:] & between[:-1])
    at = np.flatnonzero(keep)
    return np.minimum.reduceat(c, at), (np.cumsum(keep) - 1)[edge]


def streams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(classes, where each text begins and the end, the texts' numbers) of about PIECE characters
    at a time. A long text comes in several."""
    batch: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            t = _RUN.sub(r"\1\1", t)
            for lo in range(0, len(t), PIECE):
                lo = max(0, lo - OVERLAP)
                lo += max(0, t.find(" ", lo, lo + OVERLAP // 2)) - lo if lo and " " in t[lo : lo + OVERLAP // 2] else 0
                yield *_classes([t[lo : lo + PIECE + OVERLAP]]), [i]
            continue
        if batch and size + len(t) > PIECE:
            yield *_classes([texts[j] for j in batch]), batch
            batch, size = [], 0
        batch.append(i)
        size += len(t)
    if batch:
        yield *_classes([texts[j] for j in batch]), batch


def parts_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each part of a stream: its words, and short neighbours of one sentence together."""
    edge = np.diff((c >= _DIGIT).astype(np.int8))
    a, b = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    size = b - a
    short = size <= LONGEST
    starts, ends = [a[short] - 1], [b[short] + 1]
    for i, j in zip(a[~short].tolist(), b[~short].tolist(), strict=True):
        at = np.arange(i, j - LONGEST // 2, LONGEST // 2)
        starts.append(at - (at == i))
        ends.append(np.minimum(at + LONGEST, j) + (at + LONGEST >= j))
    letters = np.concatenate(([0], np.cumsum(size)))
    sentence = np.cumsum(c == _END)[a]
    for m in range(1, JOINED):
        n = len(a) - m
        some = np.flatnonzero((letters[m + 1 :] - letters[:n] <= JOINED) & (sentence[m:] == sentence[:n])) if n > 0 else []
        if not len(some):
            break
        starts.append(a[some] - 1)
        ends.append(b[some + m] + 1)
    return np.concatenate(starts), np.concatenate(ends)


# --- the kernel ---------------------------------------------------------------------------

_PAIRS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]  # the second and third character of a subsequence
_SCALE = 1 << 20
#: By a part's length, what makes the weights of its places have norm 1.
_NORM = np.array([0.0] * 3 + [sum(max(0, n - k) * DECAY ** (2 * (k + 1)) for _, k in _PAIRS) ** -0.5 for n in range(3, WIDEST + 1)])


def subsequences(parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (the parts' numbers, of each the numbers of its subsequences, the weight of each place)."""
    by: dict[int, list[int]] = {}
    for i, p in enumerate(parts):
        by.setdefault(len(p), []).append(i)
    out = []
    for n, which in sorted(by.items()):
        c = np.frombuffer(b"".join([parts[i] for i in which]), np.uint8).reshape(-1, n).astype(np.int32)
        f = [(c[:, : n - k] * CLASSES + c[:, j : n - k + j]) * CLASSES + c[:, k:] for j, k in _PAIRS if n > k]
        w = [np.full(n - k, _NORM[n] * DECAY ** (k + 1), np.float32) for _, k in _PAIRS if n > k]
        out.append((np.array(which), np.concatenate(f, 1), np.concatenate(w)))
    return out


def kernel(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], landmark: bytes, n: int) -> np.ndarray:
    """The kernel of each of n parts (as their subsequences) with a landmark."""
    dense, out = np.zeros(CLASSES**3, np.float32), np.zeros(n, np.float32)
    for _, f, w in subsequences([landmark]):
        np.add.at(dense, f[0], w)
    for which, f, w in rows:
        out[which] = dense[f] @ w
    return out


def part_scores(c: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The score, less the bias, of each part of a stream of classes, from sums of integers."""
    f = np.maximum(c, _BETWEEN).astype(np.int32)
    total = np.zeros(len(start), np.int64)
    n = len(f)
    first, second = f * (CLASSES * CLASSES), f * CLASSES
    for k in range(2, SPAN):
        m = n - k
        if m <= 0:
            break
        value = np.zeros(m, np.float32)
        for lo in range(0, m, 1 << 15):
            hi = min(m, lo + (1 << 15))
            base = first[lo:hi] + f[lo + k : hi + k]
            for j in range(1, k):
                value[lo:hi] += weights[base + second[lo + j : hi + j]]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.rint(value * np.float32(DECAY ** (k + 1) * _SCALE)).astype(np.int64))))
        total += upto[np.minimum(np.maximum(end - k, start), m)] - upto[np.minimum(start, m)]
    return total * (_NORM[end - start] / _SCALE)


@dataclass
class Model:
    weights: np.ndarray  # of each subsequence
    bias: float = BIAS
    curve: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)  # of evidence()

    def tops(self, texts: list[str]) -> np.ndarray:
        """Of each text the highest score of a part, and the highest of another part elsewhere with a lower one (the bias if there is none)."""
        out = np.full((len(texts), 2), self.bias)
        for c, at, which in streams(texts):
            start, end = parts_of(c)
            s = part_scores(c, start, end, self.weights) + self.bias
            some = np.flatnonzero(s > self.bias)
            start, end, s = start[some], end[some], s[some]
            n = len(which)
            text = np.searchsorted(at, start, "right") - 1
            best = np.full(n, self.bias)
            np.maximum.at(best, text, s)
            first = np.full(n, len(c))  # where the first of the best parts begins
            is_best = s == best[text]
            np.minimum.at(first, text[is_best], start[is_best])
            until = np.zeros(n, np.int64)
            mine = is_best & (start == first[text])
            np.maximum.at(until, text[mine], end[mine])
            apart = ((start >= until[text] - 1) | (end <= first[text] + 1)) & (s < best[text])
            second = np.full(n, self.bias)
            np.maximum.at(second, text[apart], s[apart])
            if n > 1 or (out[which[0]] == self.bias).all():
                out[which] = np.stack((best, second), 1)
            else:  # another piece of a long text
                every = np.unique([*out[which[0]], best[0], second[0]])
                out[which[0]] = every[-1], every[-2] if len(every) > 1 else self.bias
        return out

    def score(self, tops: np.ndarray) -> np.ndarray:
        x = evidence(tops)
        total = sum((x[:, i] * c for i, c in enumerate(self.curve)), np.zeros(len(x)))  # in one order, however many rows there are
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def evidence(tops: np.ndarray) -> np.ndarray:
    """What the logistic curve weighs: the highest score, how far it and the second are over zero, and one. Under zero
    a second part says nothing, so one insult alone can be enough."""
    return np.column_stack((tops[:, 0], np.maximum(tops, 0), np.ones(len(tops))))


# --- the machine ---------------------------------------------------------------------------


def train_machine(toxic: Counter, clean: Counter, settings: Settings) -> Model:
    """``toxic`` and ``clean``: parts (bytes of classes) and how often they were met."""
    bad = sorted(toxic, key=lambda w: (-toxic[w], w))
    good = sorted(clean, key=lambda w: (-clean[w], w))[: settings.max_parts]
    parts = bad + good
    rows = subsequences(parts)
    y = np.where(np.arange(len(parts)) < len(bad), 1.0, -1.0)
    often = np.sqrt([toxic[w] for w in bad] + [clean[w] for w in good])
    weight = np.where(y > 0, 0.3 * often / often[y > 0].sum(), 0.7 * often / max(1e-9, often[y < 0].sum()))
    half = settings.pool // 2
    pool = [*range(min(half, len(bad))), *range(len(bad), len(bad) + min(half, len(good)))]
    own = np.concatenate([kernel(subsequences([parts[i]]), parts[i], 1) for i in pool])
    chosen: list[int] = []
    x = np.empty((len(parts), min(settings.landmarks, len(pool))), np.float32)  # the kernel of each part and landmark
    far = np.where(own > 0, 1.0, 0.0)
    while len(chosen) < x.shape[1]:  # farthest first
        p = int(np.argmax(far))
        if far[p] <= 1e-3:
            break
        one = x[:, len(chosen)] = kernel(rows, parts[pool[p]], len(parts))
        chosen.append(pool[p])
        far = np.minimum(far, 1 - one[pool] / np.sqrt(np.maximum(own * own[p], 1e-12)))
    del rows  # large, and so is what follows
    x = x if len(chosen) == x.shape[1] else np.ascontiguousarray(x[:, : len(chosen)])
    v, u = np.linalg.eigh(x[chosen].astype(float))
    root = (u / np.sqrt(np.maximum(v, 1e-4))) @ u.T
    back = root @ _fit(x, root, y, weight)
    weights = np.zeros(CLASSES**3)
    for i, b in zip(chosen, back, strict=True):
        for _, f, w in subsequences([parts[i]]):
            np.add.at(weights, f[0], b * w)
    return Model(weights.astype(np.float32))


def _fit(kernels: np.ndarray, root: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps for the squared hinge loss of kernels @ root (which takes the place of ``kernels``), halved until
    they help. The bias is fixed: a part like none of the landmarks is clean."""
    x = kernels
    for i in range(0, len(x), 2048):
        x[i : i + 2048] = x[i : i + 2048] @ root
    beta, target = np.zeros(x.shape[1]), y - BIAS

    def margins(b: np.ndarray) -> np.ndarray:
        return y * (x @ b.astype(np.float32) + BIAS)

    def loss(b: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - margins(b)) ** 2).sum() + RIDGE * (b * b).sum())

    now = loss(beta)
    for _ in range(15):
        inside = np.flatnonzero(margins(beta) < 1)
        square, side = RIDGE * np.eye(len(beta)), -RIDGE * beta
        for i in range(0, len(inside), 2048):
            part = inside[i : i + 2048]
            xs = x[part].astype(float)
            xw = xs * weight[part, None]
            square += xw.T @ xs
            side += xw.T @ (target[part] - xs @ beta)
        step, size = np.linalg.solve(square, side), 1.0
        while size > 1e-4 and loss(beta + size * step) > now:
            size /= 2
        new = loss(beta + size * step)
        if not new < now * (1 - 1e-5):
            break
        beta, now = beta + size * step, new
    return beta


def _logistic(a: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """The curve of evidence() by Newton steps, with targets drawn in a little (Platt)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.eye(a.shape[1])[0]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(len(beta)), a.T @ (t - p) - 1e-6 * beta)
        size = np.abs(step).max()
        beta = beta + step / max(1, size)
        if size < 1e-8:
            break
    return tuple(beta.tolist())


def varied(part: bytes, rng: random.Random) -> list[bytes]:
    """The part with a mark between its characters, with a blank and with a letter put in, as far as it stays a part."""
    inner = part[1:-1] if part[0] == part[-1] == _BETWEEN else part
    i, k = rng.randrange(1, max(2, len(inner))), rng.randrange(1, max(2, len(inner)))
    mark = bytes((_BETWEEN,))
    out = [mark.join(inner[n : n + 1] for n in range(len(inner))), inner[:i] + mark + inner[i:], inner[:k] + bytes((rng.randrange(_LETTER, _LETTER + 26),)) + inner[k:]]
    return [mark + v + mark for v in (re.sub(b"\x01+", b"\x01", x) for x in out) if len(v) <= LONGEST]


def with_variants(toxic: Counter) -> Counter:
    """Toxic parts and variants of them, each as often as its part by a third."""
    out = Counter(toxic)
    for w in sorted(toxic):
        for v in varied(w, random.Random(zlib.crc32(w))):
            out[v] += max(1, toxic[w] // 3)
    return out


# --- the sample ------------------------------------------------------------------------------


def _fragments(c: np.ndarray) -> np.ndarray:
    """The number of the FRAGMENT characters at each place; -1 with less than four letters."""
    n = max(0, len(c) - FRAGMENT + 1)
    code, letters = np.zeros(n, np.int64), np.zeros(n, np.int8)
    for i in range(FRAGMENT):
        code = code * CLASSES + np.maximum(c[i : i + n], _BETWEEN)
        letters += c[i : i + n] >= _LETTER
    return np.where(letters >= 4, code, -1)


def _documents_with(only: np.ndarray | None):
    """In how many documents each fragment occurs (of ``only``, sorted, or all), summed by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for f in frames:
            found: list[np.ndarray] = []
            for t in f["text"]:
                mine = np.unique(np.concatenate([_fragments(c) for c, _, _ in streams([t or ""])]))
                found.append(mine[np.isin(mine, only, assume_unique=True)] if only is not None else mine[mine >= 0])
            code, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pd.DataFrame({"fragment": code, "n": n.astype(np.int64)})

    return run


def _told(model: Model | None, fragments: dict[int, float], settings: Settings):
    """Of each document, best first, its sentences' scores and worst parts; of clean ones also parts by a hash."""
    keys = np.array(sorted(fragments), np.int64)
    values = np.rint(np.array([fragments[k] for k in keys.tolist()]) * _SCALE).astype(np.int64)

    def first_scores(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        code = _fragments(c)
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        upto = np.concatenate(([0], np.cumsum(np.where(keys[at] == code, values[at], 0))))
        return (upto[np.minimum(np.maximum(end - FRAGMENT + 1, start), len(code))] - upto[np.minimum(start, len(code))]) / _SCALE

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text, label in zip(f["text"], f["toxic"], strict=True):
                best: dict[tuple[int, int], tuple[float, bytes]] = {}
                other: set[tuple[int, bytes]] = set()
                for piece, (c, _, _) in enumerate(streams([text or ""])):
                    start, end = parts_of(c)
                    if not len(start):
                        continue
                    s = first_scores(c, start, end) if model is None else part_scores(c, start, end, model.weights) + model.bias
                    sentence = np.cumsum(c == _END)[start]
                    raw = np.maximum(c, _BETWEEN).tobytes()
                    for i in np.argsort(-s, kind="stable").tolist():  # until there are enough sentences
                        key, one = (piece, int(sentence[i])), (-float(s[i]), raw[start[i] : end[i]])
                        if key in best:
                            best[key] = min(best[key], one)
                        elif len([1 for k in best if k[0] == piece]) < settings.sentences:
                            best[key] = one
                        else:
                            break
                    if not label and model is None:
                        words = {raw[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)}
                        other = set(sorted(other | {(zlib.crc32(x), x) for x in words})[: settings.others])
                top = sorted(best.values())[: settings.sentences]
                rows.append((label, [-x for x, _ in top], [w for _, w in top], [w for _, w in sorted(other)]))
            yield pd.DataFrame(rows, columns=["toxic", "scores", "parts", "others"])

    return run


def _topped(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tops = model.tops([t or "" for t in f["text"]])
            yield pd.DataFrame({"toxic": f["toxic"], "first": tops[:, 0], "second": tops[:, 1]})

    return run


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic. What comes to the driver is bounded by ``settings``."""
    chosen = labels.filter("toxic is not null and doc_id is not null").select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(settings.max_labelled)
    parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = cut(docs.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")).repartition(parts))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return None

    def counts(label: int, only: np.ndarray | None) -> DataFrame:
        return sample.filter(F.col("toxic") == label).select("text").mapInPandas(trimmed(_documents_with(only)), "fragment long, n long").groupBy("fragment").agg(F.sum("n").alias("n"))

    often = {r["fragment"]: r["n"] for r in counts(1, None).filter("n >= 4").collect()}
    if not often:
        return None
    rare = {r["fragment"]: r["n"] for r in counts(0, np.array(sorted(often), np.int64)).collect()}
    fragments = _telling(often, rare, n1, n0, settings.max_fragments)
    if not fragments:
        return None

    def told(model: Model | None) -> list:
        return sample.mapInPandas(trimmed(_told(model, fragments, settings)), "toxic int, scores array<double>, parts array<binary>, others array<binary>").collect()

    model, clean = None, Counter()
    for _ in range(settings.rounds):
        toxic: Counter = Counter()
        for r in told(model):
            some = [bytes(w) for w, s in zip(r["parts"], r["scores"], strict=True) if s > (0 if r["toxic"] or model is None else -0.5)]
            if r["toxic"]:
                toxic.update(some)
            else:
                clean.update(some)
                clean.update(bytes(w) for w in r["others"])
        toxic = Counter({w: n for w, n in toxic.items() if clean[w] * n1 < n * n0})
        if not toxic:
            return None
        negative = Counter({w: n for w, n in clean.items() if w not in toxic})
        model = train_machine(with_variants(toxic), negative, settings)
        trim()
    rows = sorted(sample.mapInPandas(trimmed(_topped(model)), "toxic int, first double, second double").collect())  # max_labelled rows, in one order
    model.curve = _logistic(evidence(np.array([[r["first"], r["second"]] for r in rows])), np.array([r["toxic"] for r in rows]))
    return model


def _telling(toxic: dict[int, int], clean: dict[int, int], n1: int, n0: int, most: int) -> dict[int, float]:
    """Fragments at least five times as frequent in toxic documents, with the log of that ratio, by the likelihood ratio of both shares."""
    found = []
    for k, t in toxic.items():
        c = clean.get(k, 0)
        ratio = (t + 0.1) / n1 / ((c + 0.5) / n0)
        p = (t + c) / (n1 + n0)
        g = 2 * (t * np.log(t / n1 / p) + (c * np.log(c / n0 / p) if c else 0))
        if ratio >= 5 and g > 12:
            found.append((-g, k, float(np.log(ratio))))
    return {k: v for _, k, v in sorted(found)[:most]}


# --- scoring -----------------------------------------------------------------------------------


def _scores(model: Model | None, texts: pd.Series) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    out = model.score(model.tops([t or "" for t in texts]))
    release()
    return out


def _scored(model: Model | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64").to_numpy(), "score": _scores(model, f["text"])})

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score, 0 to 1, of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(trimmed(_scored(model)), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score the threshold or more; all columns stay."""
    score_of = F.pandas_udf(lambda texts: pd.Series(_scores(model, texts), dtype="float64"), "double")
    name = unused(docs, "score")
    return docs.withColumn(name, score_of(F.coalesce("text", F.lit("")))).filter(F.col(name) < threshold).drop(name)


def train_on_held_in(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Train on labels of rows with crc32(doc_id as text) mod 3 other than 1."""
    return train(docs.select("doc_id", "text"), labels.filter(~_held_out()), settings)


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_on_held_in(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", _held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))
