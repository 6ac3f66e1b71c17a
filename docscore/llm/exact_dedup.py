"""Exact deduplication by progressive refinement, with DataFrame functions only.

Rows are grouped by normalised length, then by length and a hash of the first characters,
and only rows of groups with two or more members after both steps get a full hash. What
passes from one step to the next is a bitmap of bounded size (see common.key_bitmap), so
texts are never shuffled: each step is one scan and a pre-aggregated count.

Two texts are equal when they are identical without the characters of ``SPACES``. Of equal
texts the one with the most code points stays, then the smallest id.

Defined cases: a null text counts as empty; empty texts are equal to one another; a null
id comes after all others, so a row with a null id stays only if it has the most code points
or all ids of its group are null; an id may repeat, and its rows go by their texts. Of rows that
are equal in id and code points, groups_of_equal names them all as kept, since it names rows by
id; exact_dedup keeps one: that with the least text hash, and of rows with one id and one text
any. An empty table gives an empty result; other columns are untouched, whatever their names.

The filter between the steps grows with the number of groups (see ``filter_bits``), so that it
stays selective; it never takes more than 32 MB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, cut, drop_rows, key_bitmap, text_hash, whole, with_maybe, without_spaces

PREFIX = 64  # code points of the prefix hash


def filter_bits(keys: int) -> int:
    """Bits of the filter for so many keys: sixteen a key, from 512 KB to 32 MB."""
    return max(FILTER_BITS, min(1 << 28, 1 << max(0, 16 * keys - 1).bit_length()))


def _groups(docs: DataFrame, id_col: str, text_col: str, prefix: int, digest_all: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, n, len, survives, sha256), and of each sha256 with several rows the best (n, id, t) and the size."""
    text = whole(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("t"), F.length(text).alias("n"), without_spaces(text).alias("norm"))
    sized = base.withColumn("len", F.length("norm"))
    lengths = sized.groupBy("len").agg(F.count("*").alias("c")).filter("c > 1")
    sized = with_maybe(sized, F.xxhash64("len"), key_bitmap(lengths.select(F.xxhash64("len").alias("h"))), "same_length")
    prefixed = sized.withColumn("head", F.when(F.col("same_length"), F.xxhash64("len", F.substring("norm", 1, prefix))))
    heads = cut(prefixed.filter("same_length").groupBy("head").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("head").alias("h")))
    bits = filter_bits(heads.count())
    marked = with_maybe(prefixed, F.col("head"), key_bitmap(heads, bits), "survives", bits)
    full = F.sha2(F.col("norm"), 256)
    hashed = cut(marked.select("doc_id", "t", "n", "len", "survives", (full if digest_all else F.when(F.col("survives"), full)).alias("sha256")))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("t").alias("t")))
    equal = cut(  # with an exchange of its own, so that AQE can split a hot group's rows in the join
        hashed.filter("survives").groupBy(F.col("sha256").alias("_sha"), F.col("len").alias("_len"))
        .agg(best.alias("b"), F.count("*").alias("size"))
        .filter("size > 1")
        .select("_sha", "_len", (-F.col("b.n")).alias("best_n"), F.col("b.id").alias("best_id"), F.col("b.t").alias("best_t"), "size")
    )
    return hashed, equal


def groups_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, sha256.

    sha256 is the hex digest of the normalised text where the text had to be hashed, else
    null; with ``digest_all`` it is there for every row."""
    hashed, equal = _groups(docs, id_col, text_col, prefix, digest_all)
    survivors = hashed.filter("survives")
    joined = survivors.join(equal, (survivors["sha256"] == equal["_sha"]) & (survivors["len"] == equal["_len"]), "left").select(
        "doc_id", "n", "best_n", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), "sha256"
    )
    alone = hashed.filter("not survives").select("doc_id", "n", F.lit(None).cast("int").alias("best_n"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha256")
    out = alone.unionByName(joined)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("n") == F.col("best_n"), F.lit(True))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text equals that of a better row; all columns stay."""
    hashed, equal = _groups(docs, id_col, text_col, PREFIX, False)
    survivors = hashed.filter("survives")
    both = survivors.join(equal, (survivors["sha256"] == equal["_sha"]) & (survivors["len"] == equal["_len"]))
    wins = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("t") == F.col("best_t"))
    told = cut(both.groupBy(F.col("doc_id").alias("id"), "t").agg(F.max(wins).alias("wins"), F.count("*").alias("c")).filter("not wins or c > 1"))
    return drop_rows(docs, id_col, text_col, told.filter("not wins"), told.filter("wins"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups_of_equal(docs, digest_all=True).withColumnRenamed("sha256", "text_sha256")


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
