"""Numbered commits below a folder: each is created once, whole, and the last one is what readers see.

A commit is written under a name of its own and renamed without overwriting, as Structured
Streaming's metadata logs are. Where two writers meet at one number, one of them gets ``Conflict``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """The commit of this number was made by another writer."""


def path_of(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def filesystem(spark: SparkSession, folder: str):
    return path_of(spark, folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = filesystem(spark, self.folder)
        self._path = lambda name="": path_of(spark, f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path()):
            return []
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(self._path())]
        return sorted(int(n) for n in names if n.isdigit())

    def last(self) -> int:
        """The last commit's number; -1 where there is none."""
        return max(self.numbers(), default=-1)

    def text(self, number: int) -> str:
        """What commit ``number`` says."""
        stream = self._fs.open(self._path(f"{number:012d}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, number: int, text: str) -> None:
        """Make commit ``number``, or raise Conflict and leave nothing."""
        sc = self.spark.sparkContext
        temp, final = self._path(f"_{uuid.uuid4().hex}"), self._path(f"{number:012d}")
        out = self._fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), sc._jsc.hadoopConfiguration())
        plain = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(temp), context.makeQualified(final), plain)
        except Exception as e:
            self._fs.delete(temp, False)
            if self._fs.exists(final):
                raise Conflict(f"commit {number} of {self.folder} was made by another writer") from e
            raise

    def forget(self, before: int) -> None:
        """Delete the commits below a number."""
        for n in self.numbers():
            if n < before:
                self._fs.delete(self._path(f"{n:012d}"), False)
