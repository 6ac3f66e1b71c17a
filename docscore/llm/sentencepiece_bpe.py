"""Merge-type (BPE) SentencePiece encoding and decoding by a table of prefixes.

For a merge vocabulary every prefix of a string has one last token: the token that ends there
and is compatible with the last token of the prefix before it. An automaton over all pieces
lists the tokens that end at each place; a pair of tokens is compatible when merging their
joined text gives these two tokens again (tests are remembered). Ids are then recovered
backwards from the end.

A text is cut where no piece can cross: before the mark that starts a word (no piece has the
mark after another character), and around characters that no piece holds, which become their
UTF-8 bytes' ids. Runs of marks, whose pieces share one score so that no table holds, are merged by definition. Distinct
parts are encoded once and remembered, up to CACHE_PARTS.

Defined cases: a null text counts as empty; an empty text is the end id alone; other columns
do not matter; rows that repeat an id each get their row.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held
from .packing import batches

MARK = "▁"
CACHE_PARTS = 500_000
_PARTS = re.compile(f"{MARK}+[^{MARK}]*")


class MergeCodec:
    """Encodes and decodes like the sentencepiece library, for a model without own normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece as spm

        p = spm.SentencePieceProcessor(model_file=path)
        self.pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.score = [p.get_score(i) for i in range(len(self.pieces))]
        self.end = p.eos_id()
        self.byte_of = {i: int(s[3:5], 16) for i, s in enumerate(self.pieces) if p.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        silent = {i for i in range(len(self.pieces)) if p.is_control(i) or p.is_unknown(i)}
        self.silent = {i for i in silent if p.is_control(i)}
        self.id_of = {s: i for i, s in enumerate(self.pieces) if i not in silent and i not in self.byte_of}
        self.characters = {c for s in self.id_of for c in s}
        if any(MARK in s.lstrip(MARK) for s in self.id_of):
            raise ValueError("a piece of this model crosses words, so texts can't be cut at words")
        self.automaton = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def merged(self, s: str) -> list[str]:
        """Merge neighbours by definition: best score first, then leftmost. Pairs wait in a heap, so
        a string takes time in proportion to its length, but for the heap's logarithm."""
        parts: list[str | None] = list(s)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (k := self.id_of.get(text := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, j, text))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, text = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or parts[j] is None or len(parts[i]) + len(parts[j]) != len(text):
                continue  # one of the two was merged since
            parts[i], parts[j] = text, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 4 * CACHE_PARTS:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            ok = self.pairs[key] = self.merged(x + y) == [x, y]
        return ok

    def _alone(self, i: int) -> bool:
        """Whether merging a piece's own text gives the piece."""
        key = (-1, i)
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs[key] = self.merged(self.pieces[i]) == [self.pieces[i]]
        return ok

    def table(self, s: str) -> list[int]:
        """Ids of a string of known characters, by the last token of each prefix."""
        last = [-1] * (len(s) + 1)
        done = [False] * (len(s) + 1)
        for end, (n, i) in self.automaton.iter(s):
            at = end + 1 - n
            if not done[end + 1] and (self._alone(i) if at == 0 else last[at] >= 0 and self.compatible(last[at], i)):
                last[end + 1], done[end + 1] = i, True
        out, at = [], len(s)
        while at:
            i = last[at]
            out.append(i)
            at -= len(self.pieces[i])
        return out[::-1]

    def ids(self, part: str) -> list[int]:
        """Ids of a part that starts with its mark or marks."""
        out: list[int] = []
        marks = len(part) - len(part.lstrip(MARK))
        run = ""
        for c in [*part, None]:
            if c is not None and c in self.characters:
                run += c
                continue
            if run:
                out += self.table(run) if marks < 2 or not run.startswith(MARK) else [self.id_of[x] for x in self.merged(run)]
                run = ""
            if c is not None:
                out += [self.byte_id[b] for b in c.encode()]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Text of ids, in UTF-8, with every mark as a space."""
        out = []
        for i in ids:
            b = self.byte_of.get(i)
            out.append(bytes([b]) if b is not None else b"" if i in self.silent else self.pieces[i].replace(MARK, " ").encode())
        return b"".join(out)

    def part(self, key: str) -> tuple[bytes, bytes]:
        """(ids, text) of a part; key: the part without its single mark."""
        found = self.known.get(key)
        if found is None:
            if len(self.known) > CACHE_PARTS:
                self.known.clear()
            ids = self.ids(key if key[:1] == MARK else MARK + key)
            found = self.known[key] = (" ".join(map(str, ids)).encode(), self.decode(ids))
        return found

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        """Decimal ids joined by spaces, and the UTF-8 text that they decode to."""
        if not text:
            return str(self.end).encode(), b""
        s = MARK + text.replace(" ", MARK)
        keys = s[1:].split(MARK) if MARK * 2 not in s and s[-1] != MARK else [x[1:] if x[1:2] not in (MARK, "") else x for x in _PARTS.findall(s)]
        if keys[-1] == "":
            keys[-1] = MARK
        try:
            found = [self.known[k] for k in keys]
        except KeyError:
            found = [self.part(k) for k in keys]
        ids = b" ".join([x[0] for x in found]) + b" %d" % self.end
        out = b"".join([x[1] for x in found])
        return ids, out[1:]  # without the mark that stands before every text


def codec(path: str) -> MergeCodec:
    return held(("pieces", path), lambda: MergeCodec(path))


def _digests(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for f in frames:
            rows = []
            for texts in batches(f["text"].tolist()):
                for t in texts:
                    ids, text = c.round_trip(t)
                    rows.append((ids.count(b" ") + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64").to_numpy())
            yield out

    return run


def _encoded(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for f in frames:
            both = [c.round_trip(t or "") for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "ids": pd.Series([list(map(int, x[0].split())) for x in both], dtype=object), "decoded": [x[1].decode("utf-8", "replace") for x in both]})

    return run


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with the end id) and the text they decode to."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(_encoded(model), "doc_id long, ids array<int>, decoded string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInPandas(_digests(public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
