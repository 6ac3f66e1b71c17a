"""Secret scanning through nested encodings.

Three kinds of spans are found in every text: assignments of a named secret, access keys and
long hexadecimal strings. Then a worklist of layers is followed until nothing new appears:
lines with URL escapes, Unicode escapes or escaped line breaks and marks (as in JSON strings) are
unwrapped, together with neighbouring lines that have such escapes too or hold nothing but one
word (wrapped base64 need not have an escape on every line); and so is a base64 string whose
content is text or gzip, zlib, bzip2 or xz streams (16 characters or more: the shortest secret has 12 bytes); runs on lines that follow one another count as one
string, as base64 is often wrapped, and each for itself unless it holds a part of a longer
stream. Every layer is scanned and searched for
further layers; a layer whose content was seen before in the same place is not followed
again, so cycles end. Each character of a layer knows the span of the text it comes from
(base64: its group of four; compressed data: the whole string), and a span found in a layer
is reported as the span of the text that holds it.

Streams are inflated to their end and read in pieces of about PIECE bytes, cut at characters
that no span and no layer contains. A stretch of over HELD characters without such a one is read
in windows that overlap by OVERLAP characters, so memory is bounded whatever a stream inflates
to. All spans of a stream are reported as the string that holds it, so windows give the same
ones; only a nested string longer than HELD, or a span with more than OVERLAP blanks in it, is
not seen whole.

Defined cases: a null text counts as empty and has no spans; positions are code points, the
end is exclusive; spans that several layers give are reported once; other columns do not
matter; rows that repeat an id each get their row.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Generator, Iterator, Sequence
from itertools import chain, repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
PIECE, HELD, OVERLAP = 4 << 20, 16 << 20, 1 << 16
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_ASSIGN = re.compile(rf"(?:{'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "api")
_URL = re.compile("%[0-9A-Fa-f]{2}")
_UNICODE = re.compile(r"\\u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]{1,6}\})")
_JSON = re.compile(r'\\[nrt/"]')
_PURE = re.compile(r'[\x20\t"]*(?:[A-Za-z0-9+/_-]|%[0-9A-Fa-f]{2}|\\[nrt/"])*+={0,2}[\x20\t",]*[\r\n]*')
_BASE64 = re.compile("[A-Za-z0-9+/_-]{16,}={0,2}")
_RUN = re.compile("[A-Za-z0-9+/_-]++={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\t\x20]*+(?:\r\n|\r|\n)[\t\x20]*+[A-Za-z0-9+/_-]++)++={0,2}")
_APART = re.compile(r"""[^A-Za-z0-9+/_.=\-"'\x20:%\\{}\t\r\n]""")
_TEXT = bytes([*range(32, 127), 9, 10, 13])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three patterns, by start and then by kind as listed."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


class _Same(Sequence):
    """One place for each of n characters."""

    def __init__(self, place: int, n: int):
        self.place, self.n = place, n

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[int]:
        return repeat(self.place, self.n)

    def __getitem__(self, i):
        return _Same(self.place, len(range(self.n)[i])) if isinstance(i, slice) else self.place


Layer = tuple[str, Sequence[int], Sequence[int]]  # the text, and of each character the start and end in the document


def _escapes(line: str, starts: Sequence[int], ends: Sequence[int], pattern: re.Pattern) -> Layer | None:
    out, s, e, at = [], array("q"), array("q"), 0
    for m in pattern.finditer(line):
        i, j = m.span()
        if i < at:
            continue
        if pattern is _JSON:
            chars, where = {"n": "\n", "r": "\r", "t": "\t"}.get(m[0][1], m[0][1]), [(i, j)]
        elif pattern is _URL:  # a run of escapes is one string of UTF-8 bytes
            raw = bytearray()
            while _URL.match(line, i + 3 * len(raw)):
                k = i + 3 * len(raw)
                raw.append(int(line[k + 1 : k + 3], 16))
            j = i + 3 * len(raw)
            chars, k, where = raw.decode("utf-8", "replace"), 0, []
            if len(chars.encode("utf-8")) == len(raw):
                for c in chars:
                    n = len(c.encode("utf-8"))
                    where.append((i + 3 * k, i + 3 * (k + n)))
                    k += n
            else:
                where = [(i, j)] * len(chars)
        else:
            code = int(m[0][2:].strip("{}"), 16)
            if 0xD800 <= code < 0xDC00 and (low := _UNICODE.match(line, j)) and 0xDC00 <= (n := int(low[0][2:].strip("{}"), 16)) < 0xE000:
                code, j = 0x10000 + ((code - 0xD800) << 10) + (n - 0xDC00), low.end()
            if 0xD800 <= code < 0xE000 or code > 0x10FFFF:
                code = 0xFFFD
            chars, where = chr(code), [(i, j)]
        out.append(line[at:i])
        s.extend(starts[at:i])
        e.extend(ends[at:i])
        out.append(chars)
        s.extend(starts[a] for a, _ in where)
        e.extend(ends[b - 1] for _, b in where)
        at = j
    if not out:
        return None
    s.extend(starts[at:])
    e.extend(ends[at:])
    return "".join(out) + line[at:], s, e


class _Zlib:
    """A zlib object with the interface of the other two."""

    def __init__(self, bits: int):
        self.z, self.rest = zlib.decompressobj(bits), b""

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.z.decompress(self.rest + data, most)
        self.rest = self.z.unconsumed_tail
        return out

    eof = property(lambda self: self.z.eof)
    unused_data = property(lambda self: self.z.unused_data)


def _opener(raw: bytes):
    """What reads the gzip, zlib, bzip2 or xz stream that begins here, if one does. (Raw deflate data have no mark to begin with.)"""
    if raw[:2] == b"\x1f\x8b":
        return _Zlib(31)
    if len(raw) > 2 and raw[0] == 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return _Zlib(15)
    if raw[:3] == b"BZh" and raw[4:10] == b"1AY&SY":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if raw[:6] == b"\xfd7zXZ\0" else None


def _streams(raw: bytes) -> Generator[bytes, None, int]:
    """The bytes of the streams that follow one another, in pieces; returns how many of ``raw`` they take."""
    used = 0
    while z := _opener(rest := raw[used:]):
        try:
            while not z.eof and (data := z.decompress(rest, PIECE)):
                rest = b""
                yield data
        except (zlib.error, OSError, lzma.LZMAError):
            return used
        used = len(raw) - len(z.unused_data.lstrip(b"\0"))
        if not z.eof:
            break
    return used


def _used(raw: bytes) -> int:
    streams = _streams(raw)
    while True:
        try:
            next(streams)
        except StopIteration as x:
            return x.value


def _inflated(raw: bytes) -> Iterator[str]:
    """The text of the streams, in pieces that end where no span or layer goes on."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    held: list[str] = []
    size = 0
    for data in _streams(raw):
        s = decoder.decode(data)
        if apart := _APART.search(s[::-1]):
            cut = len(s) - apart.start()
            yield "".join([*held, s[:cut]])
            held, s, size = [], s[cut:], 0
        held.append(s)
        size += len(s)
        if size > HELD:
            s = "".join(held)
            yield s
            size = OVERLAP + (len(s) - OVERLAP) % 4  # so that base64 goes on at a group of four
            held = [s[-size:]]
    yield "".join(held) + decoder.decode(b"", True)


def _is_text(raw: bytes) -> bool:
    if not raw.translate(None, _TEXT):
        return True
    try:
        s = raw.decode()
    except UnicodeDecodeError:
        return False
    return all(c.isprintable() or c in "\t\n\r" for c in s)


def _base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    head = binascii.a2b_base64(body[:16])
    if not (head.isascii() or head[:2] == b"\x1f\x8b" or head[:6] == b"\xfd7zXZ\0" or head[:3] == b"BZh" or head[0] == 0x78 or _may_be_utf8(head)):
        return None
    if len(body) % 4 == 1:
        body = body[:-1]
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


def _may_be_utf8(head: bytes) -> bool:
    try:
        head.decode()
    except UnicodeDecodeError as x:
        return x.reason == "unexpected end of data"
    return True


def _children(layer: Layer) -> Iterator[Layer]:
    text, starts, ends = layer
    for pattern, mark in ((_URL, "%"), (_UNICODE, "\\u"), (_JSON, "\\")):
        if mark in text and pattern.search(text):
            for i, j in _blocks(text, mark, pattern):
                if child := _escapes(text[i:j], starts[i:j], ends[i:j], pattern):
                    yield child
    read: set[int] = set()  # where the lines begin that were read in a block
    streamed: set[int] = set()  # and those of them that hold a part of a stream, so are nothing alone
    for lines in _strings(text):
        known = read if len(lines) > 1 else streamed
        if lines[0].start in known and lines[-1].start in known:
            continue
        raw = _base64("".join([text[x.start : x.stop] for x in lines]))
        if not raw:
            continue
        at = lines[0] if len(lines) == 1 else [*chain(*lines)]
        used, last = _used(raw), at[-1]
        if used:
            if len(lines) > 1:
                last = at[min(len(at), (used + 2) // 3 * 4) - 1] if used < len(raw) else last
            for s in _inflated(raw[:used]):
                yield s, _Same(starts[at[0]], len(s)), _Same(ends[last], len(s))
        elif _is_text(raw):
            s = raw.decode()
            a, b, k = array("q"), array("q"), 0
            for c in s:
                n = len(c.encode())
                a.append(starts[at[k // 3 * 4]])
                k += n
                b.append(ends[at[min(len(at), (k + 2) // 3 * 4) - 1]])
            yield s, a, b
        else:
            continue
        if len(lines) > 1:
            some = {x.start for x in lines if x.start <= last}
            read |= some
            streamed |= some if used else set()


def _blocks(text: str, mark: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end of lines with escapes: neighbours together, with lines of one word between, before and after them."""
    begin = end = at = 0
    marked = False
    for line in text.splitlines(keepends=True):
        own = mark in line and pattern.search(line) is not None
        if not own and not _PURE.fullmatch(line):
            if marked:
                yield begin, end
            begin, marked = at + len(line), False
        elif own:
            marked = True
        at += len(line)
        end = at
    if marked:
        yield begin, end


def _strings(text: str) -> Iterator[list[range]]:
    """Base64 as the places of its lines: blocks of lines, all and without a word at an end, then
    their stretches of one width with a shorter last line, then single runs."""
    if "\n" in text or "\r" in text:
        for m in _WRAPPED.finditer(text):
            lines = [range(*x.span()) for x in _RUN.finditer(text, *m.span())]
            n, at = len(lines), 0
            pieces = [(0, n), (1, n), (0, n - 1), (1, n - 1)]
            while at < n:
                end = at + 1
                while end < n and len(lines[end]) == len(lines[at]):
                    end += 1
                if end < n and len(lines[end]) < len(lines[at]):
                    pieces.append((at, end + 1))
                pieces.append((at, end))
                at = end
            for i, j in dict.fromkeys(pieces):
                if j - i > 1 and sum(map(len, lines[i:j])) >= 16:
                    yield lines[i:j]
    for m in _BASE64.finditer(text):
        yield [range(*m.span())]


def all_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``base`` and the spans of all nested layers."""
    if "%" not in text and "\\" not in text and not any(_base64("".join([text[x.start : x.stop] for x in lines])) for lines in _strings(text)):
        return base
    found = set(base)
    work: list[Iterator[Layer]] = [_children((text, range(len(text)), range(1, len(text) + 1)))]
    seen = set()
    while work:  # depth first, so of each stream one piece is held
        if (child := next(work[-1], None)) is None:
            work.pop()
            continue
        content, starts, ends = child
        if not content:
            continue
        key = (hashlib.sha256(content.encode("utf-8", "surrogatepass")).digest(), starts[0], ends[-1])
        if key in seen:
            continue
        seen.add(key)
        found.update((kind, min(starts[i:j]), max(ends[i:j])) for kind, i, j in base_spans(content))
        work.append(_children(child))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{i}:{j}" for k, i, j in spans])


def _scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for t in f["text"]:
            base = base_spans(t or "")
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), joined(base), joined(all_spans(t or "", base))))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "spans"])
        out.insert(0, "doc_id", f["doc_id"].astype("Int64").to_numpy())
        yield out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base (all base spans) and spans (those and the nested ones)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInPandas(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
