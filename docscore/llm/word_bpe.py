"""Byte-pair encoding with word ends, and its decoding, by speculating and verifying.

A new word is first cut greedily: at each place the longest token that fits. All words of a
batch are then verified together. A sequence of tokens is what merging would give exactly if
every token is what its own text merges to and every pair of neighbours is compatible, that is,
merging the pair's joined text keeps both. A pair is tested without merging: going back through
the merges that made its two tokens, the newer first, the symbols at the seam are looked up; a
merge of theirs that came before the merge that took one of them away would have joined them.
numpy walks all distinct pairs of a batch at once, one step back a round. Only words with a pair
that fails are merged exactly, lowest rank first and leftmost among equals, with a heap.

Words come from the text as the tokenizer's settings say: its special tokens are cut out first,
then NFC, white space as blanks and lower case, then letters, single digits, some endings and
runs of marks. Parts with characters on whose class Unicode's versions might differ (outside of
PLAIN) are normalised and cut by the library's own rules. Distinct words, and distinct stretches
between white space, are remembered up to CACHE_WORDS.

Defined cases: a null text counts as empty; an empty text, or one of white space alone, has no
ids and decodes to an empty text; other columns do not matter; rows that repeat an id, or have a
null one, each get their row; a very long word is merged in time in proportion to its length,
but for the heap's logarithm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, trimmed
from .packing import _PLAIN as PLAIN
from .packing import batches

CACHE_WORDS = 250_000
END = "</w>"
_NONE = np.int64(1) << 40
#: Fixed value: how the vocabulary's tokenizer finds words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies: itself if it is
    printable Latin-1, else the next letter from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCodec:
    """Encodes and decodes like the tokenizers library, for a vocabulary file of lower-case words with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        rules = Tokenizer.from_file(path)
        self.normal, self.cutter = rules.normalizer, rules.pre_tokenizer  # nothing else of it is used
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        model = settings["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix")) or settings["decoder"]:
            raise ValueError("not a plain BPE vocabulary with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in settings["added_tokens"]}
        self.letters = byte_letters()
        self.byte_of = byte_of = {c: b for b, c in self.letters.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.shown = [b""] * size  # what decoding writes for an id
        for t, i in (vocab | self.special).items():
            self.shown[i] = t.encode()
        self.merge_of = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ", 1) for x in model["merges"])}
        self.made = [0] * len(self.merge_of)
        for (a, b), r in self.merge_of.items():
            self.made[r] = vocab[(self.shown[a] + self.shown[b]).decode()]
        self.first = {b: vocab[c] for b, c in self.letters.items()}  # of a byte inside of a word
        self.last = {b: vocab[c + END] for b, c in self.letters.items()}  # of a word's last byte
        self._tables(size)
        #: Tokens by their bytes: within a word, and those that end one.
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for t, i in vocab.items():
            if self.sound[i]:
                ends = t.endswith(END) and len(t) > len(END)
                (self.final if ends else self.inner)[bytes(byte_of[c] for c in (t.removesuffix(END) if ends else t))] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.stretches: dict[str, tuple[bytes, bytes]] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.exact = 0  # words that were merged exactly

    def _tables(self, size: int) -> None:
        """For each token the merge that makes it, and whether its own text merges to it."""
        pairs = np.array(list(self.merge_of), np.int64).reshape(-1, 2)
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys)
        self.size, self.keys, self.ranks = size, keys[order], order.astype(np.int64)
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        made = np.array(self.made, np.int64)
        for r in range(len(made) - 1, -1, -1):  # of several merges to one text the first counts; see below
            self.rank[made[r]], self.left[made[r]], self.right[made[r]] = r, pairs[r, 0], pairs[r, 1]
        if len(made) and (np.maximum(self.rank[pairs[:, 0]], self.rank[pairs[:, 1]]) >= np.arange(len(made))).any():
            raise ValueError("a merge of this vocabulary comes before those that make its parts")
        self.sound = np.ones(size, bool)
        own = self.compatible(self.left[made], self.right[made], top=False) & (self.rank[made] == np.arange(len(made)))
        for r, t in enumerate(self.made):
            a, b = pairs[r]
            if self.rank[t] == r:
                self.sound[t] = own[r] and self.sound[a] and self.sound[b]
        again = made[self.rank[made] != np.arange(len(made))]
        for t in np.unique(again).tolist():  # a text with several merges is settled by merging it
            if self.merged(self._symbols(t)) != [t]:
                self.sound[t] = False
            elif not self.sound[t]:
                raise ValueError("a token of this vocabulary is made by a later one of its merges")

    def _symbols(self, t: int) -> list[int]:
        """The first symbols of a token, by its merges."""
        out, todo = [], [t]
        while todo:
            x = todo.pop()
            if self.rank[x] < 0:
                out.append(x)
            else:
                todo += [int(self.right[x]), int(self.left[x])]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray, top: bool = True) -> np.ndarray:
        """For pairs of tokens, whether merging their joined text keeps both. Without ``top`` a merge of
        the two whole tokens does not count."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        before = np.full(len(x), _NONE)  # a merge at the seam counts if its rank is below
        good, live, start = np.ones(len(x), bool), np.arange(len(x)), not top
        while len(live):
            if not start:
                key = x * self.size + y
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(key), np.int64)
                found = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
                joins = found & (np.where(found, self.ranks[at], _NONE) < before)
                good[live[joins]] = False
            else:
                joins = np.zeros(len(live), bool)
            start = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~joins & (np.maximum(rx, ry) >= 0)
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            newer = ry >= rx  # of equal merges the left one came first
            before = np.where(newer, ry + 1, rx)
            x, y = np.where(newer, x, self.right[x]), np.where(newer, self.left[y], y)
        return good

    def merged(self, symbols: list[int]) -> list[int]:
        """Merge by definition: lowest rank first, leftmost among equals. Candidates wait in a heap."""
        parts: list[int] = list(symbols)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.merge_of.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue  # one of the two was merged since
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Tokens by longest match from the left; the last one must end a word."""
        out, at, n = [], 0, len(word)
        while at < n:
            whole = self.final.get(word[at:]) if n - at <= self.longest else None
            if whole is not None:
                out.append(whole)
                break
            for size in range(min(self.longest, n - at - 1), 0, -1):
                token = self.inner.get(word[at : at + size])
                if token is not None:
                    out.append(token)
                    at += size
                    break
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are not remembered: propose, verify all neighbours at once, merge what fails."""
        new = list(dict.fromkeys(words))
        raw = [w.encode("utf-8", "replace") for w in new]
        tokens = [self.proposed(b) for b in raw]
        sizes = np.array([len(t) for t in tokens], np.int64)
        flat = np.fromiter((t for ts in tokens for t in ts), np.int64, int(sizes.sum()))
        if len(flat) > 1:
            word = np.repeat(np.arange(len(new)), sizes)
            inside = word[1:] == word[:-1]
            pair, back = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
            fails = ~self.compatible(pair // self.size, pair % self.size)
            for i in np.unique(word[:-1][inside][fails[back]]).tolist():
                b = raw[i]
                tokens[i] = self.merged([*(self.first[x] for x in b[:-1]), self.last[b[-1]]])
                self.exact += 1
        for w, ids in zip(new, tokens, strict=True):
            self.words[w] = (np.array(ids, "<u4").tobytes(), b" ".join([self.shown[i] for i in ids]))

    def _stretches(self, part: str) -> list[str]:
        """What white space separates, normalised."""
        if PLAIN.fullmatch(part):
            return part.lower().split()
        return [s for s in self.normal.normalize_str(part).split(" ") if s]

    def _words(self, stretch: str) -> list[str]:
        if PLAIN.fullmatch(stretch):
            return WORD.findall(stretch)
        return [bytes(self.byte_of[c] for c in w).decode() for w, _ in self.cutter.pre_tokenize_str(stretch)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, their decoded text in UTF-8) of each text."""
        if len(self.stretches) > CACHE_WORDS:
            self.stretches.clear()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        cut: list[list[str | int]] = []
        missing: dict[str, None] = {}
        for t in texts:
            parts: list[str | int] = []
            for s in self.split.split(t) if self.split and "<|" in t else (t,):
                if s in self.special:
                    parts.append(self.special[s])
                else:
                    parts += self._stretches(s)
            missing.update((p, None) for p in parts if p.__class__ is str and p not in self.stretches)
            cut.append(parts)
        words = {p: self._words(p) for p in missing}
        self.learn(w for ws in words.values() for w in ws if w not in self.words)
        for p, ws in words.items():
            found = [self.words[w] for w in ws]
            self.stretches[p] = found[0] if len(found) == 1 else (b"".join([x[0] for x in found]), b" ".join([x[1] for x in found]))
        out = []
        for parts in cut:
            found = [self.stretches[p] if p.__class__ is str else (np.array([p], "<u4").tobytes(), self.shown[p]) for p in parts]
            out.append((b"".join([x[0] for x in found]), b" ".join([x[1] for x in found if x[0]])))
        return out


def codec(path: str) -> WordCodec:
    return held(("words", path), lambda: WordCodec(path))


def _rows(path: str, digests: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for f in frames:
            rows: list[tuple] = []
            for texts in batches(f["text"].tolist()):
                for ids, text in c.encode(texts):
                    if digests:
                        rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
                    else:
                        rows.append((np.frombuffer(ids, "<u4").astype(np.int32).tolist(), text.decode("utf-8", "replace")))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64").to_numpy())
            yield out

    return trimmed(run)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text that they decode to."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(_rows(tokenizer, False), "doc_id long, ids array<int>, decoded string")


def op12_word_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInPandas(_rows(public_tokenizers.path("word_bpe_49k.json"), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
