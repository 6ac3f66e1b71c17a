"""Snapshots: several outputs that appear together or not at all.

A snapshot's parts are written by Spark to a folder that nothing reads. Only when all are there
the folder is renamed to its name, in one step, and then the file that names the newest
snapshot is replaced, in one step too. A write that fails leaves nothing but what was there
before. Paths may be in any file system that Spark can write to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "latest"


class Snapshots:
    """The snapshots of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def _replace(self, old: str, new: str) -> None:
        """Rename a file over another one, in one step."""
        context = self._hadoop.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(self._path(old), self._path(new), options)

    def names(self) -> list[str]:
        """All snapshots, by name."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isDirectory())
        return sorted(n for n in found if not n.startswith("_"))

    def latest(self) -> str | None:
        """The name of the newest snapshot that is whole."""
        pointer = self._path(f"{self.folder}/{POINTER}")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode("utf-8").strip()
        finally:
            stream.close()

    def write(self, name: str, parts: dict[str, DataFrame]) -> str:
        """Write ``parts`` (each a table of one text column, ``value``) as the snapshot ``name`` and point to it. An
        existing name is an error, also for parts that take long while another write gets there first."""
        if name.startswith("_") or "/" in name or name == POINTER:
            raise ValueError(f"no name for a snapshot: {name}")
        target = f"{self.folder}/{name}"
        if self._fs.exists(self._path(target)):
            raise FileExistsError(target)
        staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"
        try:
            self._fs.mkdirs(self._path(staging))
            for part, rows in parts.items():
                rows.select("value").write.text(f"{staging}/{part}")
            if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(staging), self._path(target)):
                raise FileExistsError(target)
        except BaseException:
            self._fs.delete(self._path(staging), True)
            raise
        self.point_to(name)
        return target

    def point_to(self, name: str) -> None:
        """Make a snapshot that is there the newest."""
        if name not in self.names():
            raise FileNotFoundError(f"{self.folder}/{name}")
        new = f"{self.folder}/_{POINTER}-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(new), True)
        try:
            out.write(bytearray(name, "utf-8"))
        finally:
            out.close()
        self._replace(new, f"{self.folder}/{POINTER}")

    def read(self, part: str, name: str | None = None, whole: bool = False) -> DataFrame:
        """A part's lines (column value) of the newest snapshot, or of a named one; with ``whole`` one row a file."""
        name = name or self.latest()
        if name is None:
            raise FileNotFoundError(f"no snapshot in {self.folder}")
        return self.spark.read.text(f"{self.folder}/{name}/{part}", wholetext=whole)
