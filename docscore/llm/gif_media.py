"""Media columns: GIF files made from bytes, and decoded into timed frames.

Writing: bytes become rows of WIDTH 8-bit samples, cut into frames of at most ROWS rows under a
grey palette, each compressed by LZW with code widths of 9 to 12 bits.

Reading takes any GIF: global and local palettes, interlacing, graphic control (delay,
disposal, transparency) and LZW streams of any sample size, with a full table kept until its
clear code. Each frame is drawn on the canvas by its rules and stored with its time and a
histogram of colours.

Code streams are read with numpy, a table's worth of codes at once, since a code's width
depends only on its number since the last clear code. A code's string is a slice of what was
written before: entry j is the string of code j and the first sample of the next one.

Defined cases: a null text counts as empty; an empty text is one row of zeros; a damaged file
raises ValueError; other columns do not matter; rows that repeat an id each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WIDTH, ROWS, DELAY = 64, 1024, 10  # samples a row, rows a frame, hundredths of a second a frame
BINS = 16
_CODES = 1 << 12
_BITS = np.arange(12, dtype=np.uint16)


def _widths(sample_bits: int, n: int) -> np.ndarray:
    """Width of the code of each number since the clear code: it grows with the reader's table."""
    size = (1 << sample_bits) + 2 + np.maximum(0, np.arange(n) - 1)
    return np.minimum(12, np.maximum(sample_bits + 1, np.floor(np.log2(size)).astype(int) + 1))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(sample_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths, and bit offsets after the clear code, of 2 * _CODES codes."""
    if sample_bits not in _tables:
        w = _widths(sample_bits, 2 * _CODES)
        _tables[sample_bits] = w, np.concatenate(([0], np.cumsum(w)))
    return _tables[sample_bits]


def lzw_encode(data: bytes) -> bytes:
    """LZW code stream of 8-bit samples, with a clear code whenever the table is full."""
    codes: list[int] = [256]
    runs: list[int] = []  # codes up to each clear code
    if data:
        put = codes.append
        table: dict[int, int] = {}
        get = table.get
        free, w = 258, data[0]
        for c in memoryview(data)[1:]:
            k = w << 8 | c
            n = get(k)
            if n is not None:
                w = n
                continue
            put(w)
            w = c
            if free < _CODES:
                table[k] = free
                free += 1
            else:
                runs.append(len(codes))
                put(256)
                table.clear()
                free = 258
        put(w)
    codes.append(257)
    number = np.arange(len(codes)) - 1  # since the last clear code
    for at, last in zip(runs, [0, *runs], strict=False):
        number[at + 1 :] -= at - last
    width = _layout(8)[0][np.maximum(number, 0)]
    width[0] = 9
    bits = (np.array(codes, np.uint16)[:, None] >> _BITS & 1).astype(np.uint8)
    return np.packbits(bits[_BITS < width[:, None]], bitorder="little").tobytes()


def _codes_at(raw: np.ndarray, spot: np.ndarray, width: np.ndarray) -> np.ndarray:
    byte = spot >> 3
    return (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (spot & 7).astype(np.uint32) & ((1 << width[: len(spot)]) - 1).astype(np.uint32)


def lzw_decode(stream: bytes, sample_bits: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream."""
    clear = 1 << sample_bits
    first, entries = clear + 2, _CODES - clear - 2
    short = _layout(sample_bits)
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total, at, out, at_clear = 8 * len(stream), 0, bytearray(), True
    while at + sample_bits < total and len(out) < most:
        width, offset = short
        while True:  # with a deferred clear code, as many codes of full width as there are
            spot = at + offset[:-1]
            code = _codes_at(raw, spot[spot + width <= total], width)
            stop = np.flatnonzero((code == clear) | (code == clear + 1))
            if len(stop) or len(code) < len(width):
                break
            width = np.concatenate((width, np.full(len(width), 12, width.dtype)))
            offset = np.concatenate(([0], np.cumsum(width)))
        n = int(stop[0]) if len(stop) else len(code)
        starts: list[int] = []
        mark, size = starts.append, len(out)
        for c in code[:n].tolist():
            mark(size)
            if c < clear:
                out.append(c)
                size += 1
                continue
            j = c - first
            if j >= len(starts) - 1 or j >= entries:
                raise ValueError("a code before its entry")
            s, e = starts[j], starts[j + 1] + 1
            part = out[s:e]
            if e > size:
                part.append(out[s])
            out += part
            size += e - s
        if not len(stop) or code[n] == clear + 1:
            break
        at += int(offset[n]) + int(width[n])
    return bytes(out[:most])


def _blocks(data: bytes) -> bytes:
    out = b"".join(bytes((len(part := data[i : i + 255]),)) + part for i in range(0, len(data), 255))
    return out + b"\0"


_GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode_gif(samples: bytes) -> bytes:
    """``samples``: a positive multiple of WIDTH bytes."""
    rows = len(samples) // WIDTH
    screen = min(rows, ROWS)
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), screen.to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for top in range(0, rows, ROWS):
        part = samples[top * WIDTH : (top + ROWS) * WIDTH]
        out += [b"\x21\xf9\x04\x04", DELAY.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", WIDTH.to_bytes(2, "little"), (len(part) // WIDTH).to_bytes(2, "little"), b"\0\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


@dataclass
class GifFrame:
    left: int
    top: int
    width: int
    height: int
    delay: int  # hundredths of a second
    disposal: int
    start: int  # of the frame, in hundredths of a second
    samples: np.ndarray  # palette indices, height x width
    canvas: np.ndarray  # what is shown, screen height x width x (red, green, blue, alpha)

    def histogram(self) -> list[int]:
        """Opaque pixels shown, by luma in BINS classes."""
        shown = self.canvas.reshape(-1, 4)
        shown = shown[shown[:, 3] > 0].astype(np.uint32)
        luma = (shown[:, 0] * 299 + shown[:, 1] * 587 + shown[:, 2] * 114) // 1000
        return np.bincount(luma * BINS // 256, minlength=BINS).tolist()


def decode_gif(data: bytes) -> list[GifFrame]:
    """All frames, each as it is shown."""
    return list(frames_of(data))


def frames_of(data: bytes) -> Iterator[GifFrame]:
    """The frames one by one, so that one canvas is held at a time."""
    try:
        yield from _frames(data)
    except IndexError:
        raise ValueError("the file ends too early") from None


def _frames(data: bytes) -> Iterator[GifFrame]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    number = lambda i: int.from_bytes(data[i : i + 2], "little")
    width, height, flags, at = number(6), number(8), data[10], 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 3 << (flags & 7) + 1
        p = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
        at += n
        return p

    def chain() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    common = palette(flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear, now = 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = chain()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, f = number(at), number(at + 2), number(at + 4), number(at + 6), data[at + 8]
        at += 9
        colours = palette(f)
        colours = common if colours is None else colours
        bits = data[at]
        at += 1
        if colours is None or not 1 <= bits <= 8:
            raise ValueError("no palette, or a wrong sample size")
        got = np.frombuffer(lzw_decode(chain(), bits, w * h), np.uint8)
        if len(got) < w * h:
            raise ValueError("samples are missing")
        samples = got.reshape(h, w)
        if f & 0x40:
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = samples[: area.shape[0], : area.shape[1]]
        drawn = np.ones(seen.shape, bool) if clear is None else seen != clear
        table = np.zeros((256, 4), np.uint8)
        table[: len(colours), :3], table[:, 3] = colours, 255
        area[drawn] = table[seen[drawn]]
        yield GifFrame(left, top, w, h, delay, disposal, now, samples, canvas.copy())
        now += delay
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear = 0, 0, None
    if at >= len(data):
        raise ValueError("the file ends too early")


def _stored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for lo, hi in slices(f["text"].tolist()):
            part = f.iloc[lo:hi]
            raw = [(t or "").encode() for t in part["text"]]
            media = [encode_gif(b + b"\0" * (max(WIDTH, -(-len(b) // WIDTH) * WIDTH) - len(b))) for b in raw]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "n_bytes": [len(b) for b in raw], "media": media})


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for lo, hi in slices(f["media"].tolist(), 1 << 21):
            part = f.iloc[lo:hi]
            rows = []
            for media in part["media"]:
                samples, shown = [], []
                for x in frames_of(media):
                    samples.append(x.canvas[: x.height, : x.width, 0].tobytes())
                    shown.append({"start_ms": 10 * x.start, "delay_ms": 10 * x.delay, "disposal": x.disposal, "width": x.width, "height": x.height, "histogram": x.histogram()})
                rows.append((b"".join(samples), shown))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "n_bytes": part["n_bytes"].to_numpy(), "media": part["media"].to_numpy(), "samples": [r[0] for r in rows], "frames": pd.Series([r[1] for r in rows], dtype=object)})


FRAMES = "array<struct<start_ms long, delay_ms long, disposal int, width int, height int, histogram array<long>>>"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, padded by zeros, as a GIF."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInPandas(_stored, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, samples (of all frames, in order) and frames with their time and histogram."""
    return stored.mapInPandas(_read, f"doc_id long, n_bytes long, media binary, samples binary, frames {FRAMES}")


def op3_gif_media(spark, sf_dir: str) -> DataFrame:
    r = read_media(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    total = F.expr("aggregate(frames, array_repeat(0L, 16), (a, f) -> zip_with(a, f.histogram, (x, y) -> x + y))")
    last = F.element_at("frames", -1)
    feature = F.concat_ws(";", F.size("frames"), last["start_ms"] + last["delay_ms"], F.array_join(total, ","))
    return r.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
