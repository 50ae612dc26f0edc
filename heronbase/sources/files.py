"""Files of any store that Spark reaches, through its file-system layer on the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")

    def path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def url(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def mkdirs(self, *parts: str) -> None:
        self.fs.mkdirs(self.path(*parts))

    def delete(self, *parts: str) -> bool:
        return self.fs.delete(self.path(*parts), True)

    def read(self, *parts: str) -> bytes:
        stream = self.fs.open(self.path(*parts))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, data: bytes, *parts: str) -> None:
        """Whole or not at all: written beside, then renamed."""
        aside = self.path(*parts[:-1], f".{parts[-1]}.new")
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        target = self.path(*parts)
        if not self.fs.rename(aside, target):  # stores that don't replace
            self.fs.delete(target, False)
            self.fs.rename(aside, target)

    def claim(self, data: bytes, *parts: str) -> bool:
        """Writes a file that must not exist yet, whole; False if someone else was first.

        Local files are linked into place and HDFS refuses to rename onto a file, so one of
        two writers loses; on an object store this rests on its conditional rename or put.
        """
        if self.exists(*parts):
            return False
        aside, target = self.path(*parts[:-1], f".{uuid.uuid4().hex}"), self.path(*parts)
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        try:
            if target.toUri().getScheme() in (None, "file"):
                nio = self._jvm.java.nio.file.Files
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    nio.createLink(local(target), local(aside))
                    return True
                except Py4JJavaError:
                    if self.exists(*parts):
                        return False
                    raise
            return bool(self.fs.rename(aside, target))
        finally:
            self.fs.delete(aside, False)

    def files(self, *parts: str) -> list[tuple[str, int]]:
        """Relative name and size of all files below, in order of name."""
        top = self.path(*parts)
        if not self.fs.exists(top):
            return []
        prefix = self.fs.makeQualified(top).toString() + "/"
        found, out = self.fs.listFiles(top, True), []
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString().removeprefix(prefix), f.getLen()))
        return sorted(out)
