"""Runs of words, word pieces and hard negatives against brute force and the library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def docs(spark, rows):
    """Rows of (doc_id, text) with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, start int, n_runs string, length int")


def plain_runs(w):
    """All runs by definition: of each period the stretches that keep it, without those of a smaller one."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(s, s + n - p)) for p in range(1, q)):
                found.append((s, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_op11(doc_id, text):
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    found = plain_runs(w)
    drop = {x for s, n, q in found for x in range(s + q, s + n)}
    best = (None,) * 4
    for s, n, q in found:  # greatest n / q first seen, by start, then period
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, 1000 * n // q)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, sha(listed.encode()), sha(" ".join(x for i, x in enumerate(w) if i not in drop).encode()))


def test_runs_equal_brute_force():
    from docscore.llm.periodic_runs import runs, text_runs

    rng = random.Random(3)
    texts = []
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
            w += (p * 7)[: rng.randint(0, 40)] + [rng.randrange(k) for _ in range(rng.randint(0, 6))]
        assert runs(w) == plain_runs(w), w
        texts.append(" ".join(f"é{x}" for x in w))
    for t, (found, kept) in zip(texts, text_runs(texts), strict=True):
        w = WORDS.findall(t)
        assert found == plain_runs(w)
        drop = {x for s, n, q in found for x in range(s + q, s + n)}
        assert [x.decode() for x in kept] == [x for i, x in enumerate(w) if i not in drop]


def test_runs_do_not_trust_hashes(monkeypatch):
    """With hashes that call half of all stretches equal, the comparison of words still gives the runs."""
    from docscore.llm import periodic_runs as P

    rng = random.Random(4)
    texts = [[rng.randrange(2) for _ in range(40)] + [0, 1] * rng.randint(0, 6) for _ in range(200)]
    alike = P.Extensions._alike
    monkeypatch.setattr(P.Extensions, "_alike", lambda self, i, j, n: alike(self, i, j, n) or (i * 7 + n * 13) % 2 == 0)
    for w in texts:
        x = P.Extensions(w)
        for i in range(0, len(w), 3):
            for j in range(i + 1, len(w), 2):
                n = next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)
                m = next((k for k in range(i) if w[i - 1 - k] != w[j - 1 - k]), i)
                assert (x.right(i, j), x.left(i, j)) == (n, m)
        assert P.runs(w) == plain_runs(w)


def test_runs_of_long_texts_take_little_time():
    from docscore.llm.periodic_runs import text_runs

    n = 120_000
    (found, kept), (none, all_) = text_runs(["aa " * n, " ".join(map(str, range(n)))])
    assert found == [(0, n, 1)] and kept == [b"aa"]
    assert none == [] and len(all_) == n


@pytest.fixture(scope="module")
def odd():
    """Repeats, ties, nulls, empty texts, other white space, repeated rows, ids that are rewritten."""
    again = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rng = random.Random(9)
    prose = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 90))) for _ in range(12)]
    rows = list(zip(again, prose, strict=True)) + [(again[0], None), (again[1], ""), (again[2], "one")]
    rows += [(1001, "a b " * 5 + "c"), (1002, "a b\tc a\x0bb c a b c a b c"), (1003, "x " * 6 + "y " * 6), (1003, "x " * 6 + "y " * 6), (1004, None), (1005, " \n\r"), (1006, "a\x1cb a\x85b\xa0 " * 4), (1007, "A a A a A a A a"), (None, "q " * 9), (None, None), (1008, "x " * 5)]
    return rows


def test_op11_equals_brute_force(spark, odd, tmp_path):
    from docscore.llm.periodic_runs import collapse_runs, op11_periodic_runs, periodic_runs

    key = lambda r: tuple((x is not None, x) for x in r)
    docs(spark, odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_op11(*r) for r in odd), key=key)
    listed = sorted((tuple(r) for r in periodic_runs(docs(spark, odd)).collect()), key=key)
    want = [(i, s, n, q, " ".join(WORDS.findall(t)[s : s + q])) for i, t in odd for s, n, q in plain_runs(WORDS.findall(t or ""))]
    assert listed == sorted(want, key=key)
    collapsed = collapse_runs(docs(spark, odd))
    assert collapsed.columns == docs(spark, odd).columns
    assert {r.text for r in collapsed.filter("doc_id = 1001").collect()} == {"a b c"} and collapsed.filter("doc_id = 1004").first().text is None
    assert periodic_runs(docs(spark, [])).count() == 0


def test_op11_on_documents(spark):
    from docscore.llm.periodic_runs import op11_periodic_runs

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in rows if len(r.text or "") < 4000}
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in short.items():
        assert got[i] == plain_op11(i, t)


# --- word pieces ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def both(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)

    return both


@pytest.fixture(scope="module")
def words():
    import public_tokenizers

    from docscore.llm.word_bpe import WordCodec

    return WordCodec(public_tokenizers.path("word_bpe_49k.json"))


def test_words_equal_the_library(library, words):
    rng = random.Random(1)
    letters = "abcdeéstng'0 1<|>\n\tΣσßİ-_.,中ก́\x1c\x85\xa0"
    texts = ["", " \n", "<|endoftext|>", "a<|startoftext|>B<|ENDOFTEXT|>", "don't we'll it's 's", "é", "x" * 5000, "ΟΔΟΣ ΣΑΣ", "12 ³ ½ 𝟘"]
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        texts.append(t + "<|endoftext|>" + t[:5] if rng.random() < 0.1 else t)
    got = words.encode(texts)
    for t, (ids, text) in zip(texts, got, strict=True):
        assert (ids, text.decode()) == library(t), t
    assert words.exact  # some proposals failed and were merged


def test_words_of_every_kind_of_character(library, words):
    texts = [f"a{chr(c)}b 1{chr(c)}" for c in [*range(0x0, 0xD800, 7), *range(0xE000, 0x1FFFF, 31)]]
    for t, (ids, text) in zip(texts, words.encode(texts), strict=True):
        assert (ids, text.decode()) == library(t), t


def test_neighbours_are_tested_like_merging(words):
    """The test of pairs without merging, against merging their joined symbols; and every token is sound."""
    rng = np.random.default_rng(2)
    inner = np.array(sorted(words.inner.values()))
    ends = np.array(sorted([*words.inner.values(), *words.final.values()]))
    a, b = rng.choice(inner, 4000), rng.choice(ends, 4000)
    want = [words.merged(words._symbols(int(x)) + words._symbols(int(y))) == [x, y] for x, y in zip(a, b, strict=True)]
    got = words.compatible(a, b)
    assert got.tolist() == want and 0 < sum(want) < len(want)
    for t in rng.choice(ends, 500).tolist():
        assert (words.merged(words._symbols(t)) == [t]) == bool(words.sound[t])


def test_op12_query_and_operator(spark, library, tmp_path):
    import public_tokenizers

    from docscore.llm.word_bpe import encode_decode, op12_word_bpe

    rows = [(1, "Hello hello WORLD"), (1, "Hello hello WORLD"), (2, None), (3, ""), (None, "x"), (4, "naïve Σίσυφος 日本 " * 400), (5, "ab" * 20_000)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((str(i), len(library(t)[0]) // 4, sha(library(t)[0]), sha(library(t)[1].encode())) for i, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in op12_word_bpe(spark, str(tmp_path)).collect()) == want
    out = encode_decode(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((str(r.doc_id), np.array(r.ids, "<u4").tobytes(), r.decoded) for r in out) == sorted((str(i), *library(t)) for i, t in rows)
    assert encode_decode(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_op12_on_documents(spark, library):
    from docscore.llm.word_bpe import op12_word_bpe

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len(library(r.text)[0]) // 4, sha(library(r.text)[0]), sha(library(r.text)[1].encode())) for r in rows)
    assert sorted(map(tuple, op12_word_bpe(spark, SF).collect())) == want


# --- hard negatives ------------------------------------------------------------------


def plain_mine(table, width):
    """By definition, a row at a time."""
    rows = []
    for i, x, label in table:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * c) for c in x]
        rows.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, np.array(v + [0] * (width - len(v)))))
    last = lambda i: (i is None, i or 0)
    out = []
    for i, label, v in rows:
        if i is None or i % 50:
            continue
        ranked = sorted(((-int(v @ w), last(j), j, other) for j, other, w in rows if j != i), key=lambda r: r[:2])
        for s, _, j, _ in [r for r in ranked if r[3] == label][:5]:
            window = [(k, -t) for t, _, k, other in ranked if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, n, k, -s, t) for n, (k, t) in enumerate(window, 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    """Clusters, ties, repeated rows and ids, negative scores, nulls, short and empty vectors."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(10, 7))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 10] * rng.uniform(0, 1) + rng.normal(size=7) * 0.4], int(i % 10 if i % 3 else 4)) for i in range(900)]
    rows += [(50, rows[50][1], 4), (50, rows[50][1], rows[50][2]), (77, rows[10][1], 3), (77, rows[10][1], 3), (1000, [0.0] * 7, 1), (1001, rows[100][1], 5), (None, rows[100][1], 5), (None, rows[100][1], None)]
    return rows + [(1050, None, 1), (1100, [1.0, None] + [0.0] * 5, 2), (1150, [float("nan")] * 7, 2), (1200, [float("inf")] * 7, 2), (1250, [0.5, -0.5], 3), (1300, [], 3), (1350, [-2.0] * 7, 9)]


def test_op13_equals_brute_force(spark, vectors, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from docscore.llm import hard_negatives as H

    schema = "vec_id long, embedding array<float>, label int, rank int, id string"
    spark.createDataFrame([(*r, 1, "x") for r in vectors], schema).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = plain_mine(vectors, 8)
    got = H.op13_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    # small blocks, several waves and a quantiser that saw few rows give the same
    monkeypatch.setattr(H, "_BLOCK_ROWS", 17)
    monkeypatch.setattr(H, "_BLOCK_ANCHORS", 3)
    rows = H.whole_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    small = H.mine(rows, F.col("id") % 50 == 0, H.Settings(sample=20, rounds=2, wave=6))
    assert sorted(map(tuple, small.collect()), key=str) == want
    assert H.mine(rows.limit(0), F.col("id") % 50 == 0).count() == 0


def test_bounds_hold_every_score():
    from docscore.llm.hard_negatives import Anchors, Quantiser

    rng = np.random.default_rng(3)
    v = rng.integers(-3000, 3000, (500, 16))
    q = Quantiser(v[:60], 3)
    codes, left = q.encode(v)
    low, high = Anchors(np.arange(20), np.zeros(20, int), v[:20]).bounds(np.arange(20), q, codes, left)
    exact = v[:20] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low < np.abs(exact).max()).mean() > 0.9  # and they are of use


def test_large_components_are_an_error(spark):
    from pyspark.sql import functions as F

    from docscore.llm.hard_negatives import whole_vectors

    with pytest.raises(Exception, match="too large"):
        whole_vectors(spark.createDataFrame([(1, [1e9], 1)], "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", F.col("label")).collect()
