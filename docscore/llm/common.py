"""What the operators of this subpackage share: reliable checkpoints, a bounded
key filter, hashing of words on numpy buffers, and connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that every contract of this subpackage means: space, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names in spark.checkpoint.dir."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "docscore-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` reliably to the shared checkpoint folder and read it from there from now on."""
    ensure_checkpoint_dir(spark_of(df))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, base: str, *others: DataFrame) -> str:
    """A column name like ``base`` that none of the tables has."""
    have = {c.lower() for d in (df, *others) for c in d.columns}
    name = f"_{base}"
    while name.lower() in have:
        name += "_"
    return name


def slices(texts: list[str | None], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) of runs of texts of about ``most`` characters, so that memory is bounded."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def whole(text: str | Column) -> Column:
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without_spaces(text: Column) -> Column:
    """Delete SPACES. Six byte searches are faster than a regular expression or translate()."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


_held: dict[object, object] = {}


def held(name: object, make):
    """A Python worker's one large cache: asking for another lets this one go, so workers that
    are used again do not keep the caches of earlier stages."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Let a worker's cache go, and give back what was freed."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def trimmed(run):
    """``run`` (of frames to frames), which gives freed memory back after each frame: workers live on
    between stages, and what they keep counts against their executor."""

    def then_trim(frames: Iterator) -> Iterator:
        for out in run(frames):
            yield out
            del out
            trim()

    return then_trim


# --- a key filter of bounded size -------------------------------------------------

_WORD = 32768  # bits of one row of bitmap_construct_agg
FILTER_BITS = 1 << 22  # 128 rows of 4 KB, whatever the data


def key_bitmap(hashes: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``hashes``: one long column ``h``. At most bits/32768 rows (bucket, bitmap) of 4 KB,
    so that it can be broadcast at any size of the data (512 KB by default)."""
    at = F.pmod(F.col("h"), F.lit(bits))
    return (
        hashes.select(F.floor(at / _WORD).cast("int").alias("_bucket"), (at % _WORD).alias("_bit"))
        .groupBy("_bucket")
        .agg(F.expr("bitmap_construct_agg(_bit)").alias("_bitmap"))
    )


def with_maybe(df: DataFrame, h: Column, bitmap: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """Add ``name``: false only where ``h`` is in no row that made ``bitmap``. No other column changes."""
    place, key, value = unused(df, "place"), unused(df, "bucket"), unused(df, "bitmap")
    df = df.withColumn(place, F.pmod(h, F.lit(bits)))
    bucket, bit = F.floor(F.col(place) / _WORD).cast("int"), (F.col(place) % _WORD).cast("int")
    named = bitmap.select(F.col("_bucket").alias(key), F.col("_bitmap").alias(value))
    joined = df.join(F.broadcast(named), F.coalesce(bucket, F.lit(-1)) == F.col(key), "left")
    byte = F.conv(F.hex(F.substring(F.col(value), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.expr("1") == (F.call_function("shiftright", byte, bit % 8) % 2), F.lit(False))
    return joined.withColumn(name, set_).drop(place, key, value)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(whole(text_col))


def drop_rows(df: DataFrame, id_col: str, text_col: str, lost: DataFrame, repeated: DataFrame) -> DataFrame:
    """``df`` without the rows in ``lost``, and with one of the rows that are equal in id and text
    for those in ``repeated``; both have columns id and t (text_hash), without repeats.

    Only rows that the bounded filter can't clear go through a shuffle; the others pass where
    they are. Ids may be null and may repeat: a row goes by its id and its text."""
    told = lost.select("id", "t", F.lit(True).alias("gone")).unionByName(repeated.select("id", "t", F.lit(False).alias("gone")))
    maybe, h, i, t, gone = (unused(df, x) for x in ("maybe", "h", "id", "t", "gone"))
    key = F.xxhash64(F.col(id_col).cast("long"), text_hash(text_col))
    marked = with_maybe(df, key, key_bitmap(told.select(F.xxhash64("id", "t").alias("h"))), maybe)
    stay = marked.filter(~F.col(maybe)).drop(maybe)
    asked = marked.filter(F.col(maybe)).drop(maybe).withColumn(h, key)
    named = told.select(F.xxhash64("id", "t").alias(h + "k"), F.col("id").alias(i), F.col("t").alias(t), F.col("gone").alias(gone))
    same = (F.col(h) == F.col(h + "k")) & F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (text_hash(text_col) == F.col(t))
    answered = asked.join(named, same, "left")
    other = answered.filter(F.col(gone).isNull()).select(*df.columns)
    once = answered.filter(~F.col(gone)).select(*df.columns).dropDuplicates([id_col, text_col])
    return stay.unionByName(other).unionByName(once)


# --- words and their hashes, on numpy buffers -------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(f"{base}")
    if have is None or len(have) < n:
        x = np.full(max(n, _BLOCK) + 1, base, np.uint64)
        x[0] = 1
        have = _powers[f"{base}"] = np.cumprod(x, dtype=np.uint64)
    return have[:n]


def _hash_block(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(b, np.uint8)
    inside = ~_IS_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    s, e = edge[::2], edge[1::2]
    if not len(s):
        return s, e, np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * _power(_P, len(a)), dtype=np.uint64)))
    h = (total[e] - total[s]) * _power(_PINV, len(a) + 1)[s]
    return s, e, mix64(h)


def words_of(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: word starts, ends (bytes in its own UTF-8 text), 64-bit hashes,
    and first word of each text (one more at the end). A-Z are lower-cased, nothing else."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first, n = [0], 0
    batch: list[bytes] = []

    def flush() -> None:
        nonlocal n
        if not batch:
            return
        s, e, h = _hash_block(b"\n".join(batch))
        begin = np.cumsum([0, *(len(x) + 1 for x in batch)])
        at = np.searchsorted(s, begin[1:])
        shift = np.repeat(begin[:-1], np.diff(np.concatenate(([0], at))))
        parts.append((s - shift, e - shift, h))
        first.extend((n + at).tolist())
        n += len(s)
        batch.clear()

    size = 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        b = b.lower() if lower else b
        if len(b) > _BLOCK:  # a very long text: in blocks cut at white space
            flush()
            size = lo = 0
            while lo < len(b):
                hi = lo + _BLOCK
                while hi < len(b) and not _IS_SPACE[b[hi]]:
                    hi += 1
                s, e, h = _hash_block(b[lo:hi])
                parts.append((s + lo, e + lo, h))
                n += len(s)
                lo = hi
            first.append(n)
            continue
        if size + len(b) > _BLOCK:
            flush()
            size = 0
        batch.append(b)
        size += len(b) + 1
    flush()
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.array(first)
    s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return s, e, h, np.array(first)


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words, in order, whatever its place."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _power(_P, len(h)), dtype=np.uint64)))
    return mix64((total[k:] - total[:-k]) * _power(_PINV, n) + np.uint64(k))


# --- connected components ----------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``edges``: longs a, b. Returns (node, component) for every node of an edge, with the
    smallest node reachable, by alternating large-star and small-star steps; the number of
    rounds grows with the logarithm of a component's diameter. Every step is a
    pre-aggregated minimum and a join that AQE can split; each round is checkpointed."""
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    said = None
    while True:
        now = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == said or not now[0]:
            break
        said = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        # small star: u's smaller neighbours and u itself all point to the smallest of them
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
