"""Readers and writers of JSON documents, JSON lines and files as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MANY = 100_000  # paths of one read


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and json: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Lines of text files: file, position (a struct that sorts a file's lines as they are written) and value.

    Files are read in splits, so one may be of any size: a line's position is the start of its split
    and its place in the task that reads it. With ``numbered`` also line, its number in the file from
    0: the lines of each split are counted first, and the sums of the counts before added."""
    m = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    rows = spark.read.text(path).select(*m, F.monotonically_increasing_id().alias("at"), "value")
    out = rows.select("file", F.struct("block", "at").alias("position"), "value")
    if not numbered:
        return out
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", F.col("block").alias("b"), "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return out.join(before, (out["file"] == before["file"]) & (F.col("position.block") == F.col("b"))).select(out["file"], "position", (F.col("before") + F.col("position.at") - F.col("first")).alias("line"), "value")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, numbered: bool = True) -> DataFrame:
    """Rows of JSON lines with file, position, line number (see lines) and the line itself. Blank and malformed
    lines go; with ``strict`` they raise."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    some = lines(spark, path, numbered).filter(F.trim("value") != "").withColumnRenamed("value", "_raw")
    parsed = some.withColumn("r", F.from_json("_raw", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    kept = ["file", "position", *(["line"] if numbered else []), "_raw"]
    return parsed.filter("r is not null and r._bad is null and trim(_raw) like '{%}'").select(*kept, "r.*").drop("_bad")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A log of one file or of several, in the order of their names: ordinal (file and position) and value."""
    return lines(spark, path).select(F.struct("file", "position").alias("ordinal"), "value")


def relative_to(spark: SparkSession, path: Column, folder: str) -> Column:
    """A file's path from ``folder`` on, decoded."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    same = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/+", "$1:/")  # noqa: E731 - one or three strokes
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substring(same(decoded), F.length(same(F.lit(base))) + 2, F.length(decoded))


def selected_files(spark: SparkSession, folder: str, selected: DataFrame, name: str) -> DataFrame:
    """name and text of the whole files below ``folder`` that ``selected`` names in column ``name`` (a file's
    path from there, or its folder's); no other file is listed or opened. There are as many names as
    files that are read, which the driver lists in any case. A name without a file fails the job."""
    names = sorted({r[0] for r in selected.select(name).filter(F.col(name).isNotNull()).distinct().collect()})
    out = spark.createDataFrame([], "name string, text string")
    for lo in range(0, len(names), _MANY):
        part = names[lo : lo + _MANY]
        files = spark.read.text([f"{folder}/{n}" for n in part], wholetext=True)
        rel = relative_to(spark, F.col("_metadata.file_path"), folder)
        each = files.select(F.explode(F.array(rel, F.regexp_replace(rel, "/[^/]*$", ""))).alias("name"), F.col("value").alias("text"))
        out = out.unionByName(each.join(spark.createDataFrame([(n,) for n in part], "name string"), "name").select("name", "text"))
    return out


def binary_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modified and the content in base64."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return f.select("path", F.col("modificationTime").alias("modified"), F.replace(F.base64("content"), F.lit("\r\n"), F.lit("")).alias("base64"))


def newest(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """The path that was modified last; ties by path."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return f.select(F.struct("modificationTime", "path").alias("x")).agg(F.max("x").alias("x")).select("x.path")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, null members included; appending adds files, so a log grows without rewriting."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_document(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The one row of ``df`` as a JSON document."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode(mode).text(path)
