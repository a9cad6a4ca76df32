"""The few Hadoop FileSystem calls the engine needs on the driver.

Going through Hadoop keeps every path scheme Spark can read (`file:`, `hdfs:`, `s3a:`,
`gs:`) usable for archives. Only directory names and single small files pass here.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def qualified(self, path: str) -> str:
        """The path with scheme and absolute directories."""
        fs, target = self._at(path)
        return fs.makeQualified(target).toString()

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def _paths(self, statuses) -> list[str]:
        """The paths of a listing, brought over in one call however many there are."""
        if statuses is None or not len(statuses):
            return []
        paths = self._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses)
        text = self._jvm.org.apache.commons.lang3.ArrayUtils.toString(paths)[1:-1]
        # "{a,b}": every path begins with the scheme of the first one
        scheme = text.split(":", 1)[0]
        return re.split(f",(?={re.escape(scheme)}:/)", text)

    def names(self, path: str) -> list[str]:
        """Names of all entries of a directory, sorted; empty when the path does not exist."""
        fs, target = self._at(path)
        return sorted(p.rsplit("/", 1)[1] for p in self._paths(fs.listStatus(target))) if fs.exists(target) else []

    def directories(self, path: str) -> list[str]:
        """Names of the sub-directories, sorted; empty when the path does not exist."""
        fs, target = self._at(path)
        if not fs.exists(target):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory())

    def glob(self, pattern: str) -> list[str]:
        """Full paths of what matches a glob pattern, sorted."""
        fs, target = self._at(pattern)
        return sorted(self._paths(fs.globStatus(target)))

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """(name, length, modification time in ms) of the plain files in one directory."""
        fs, target = self._at(path)
        if not fs.exists(target):
            return []
        return sorted(
            (s.getPath().getName(), s.getLen(), s.getModificationTime())
            for s in fs.listStatus(target)
            if s.isFile()
        )

    def rename(self, source: str, target: str) -> None:
        """Move a file or directory to a path that must not exist yet."""
        fs, src = self._at(source)
        dst = self._jvm.org.apache.hadoop.fs.Path(target)
        if fs.exists(dst):
            raise FileExistsError(target)
        fs.mkdirs(dst.getParent())
        if not fs.rename(src, dst):
            raise OSError(f"could not move {source} to {target}")

    def make_directory(self, path: str) -> None:
        fs, target = self._at(path)
        fs.mkdirs(target)

    def delete(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.delete(target, True)

    def write_text(self, path: str, text: str, overwrite: bool = False) -> None:
        fs, target = self._at(path)
        out = fs.create(target, overwrite)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_bytes(self, path: str) -> bytes:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, path: str, data: bytes) -> None:
        """Small files only: the bytes pass through the driver."""
        fs, target = self._at(path)
        out = fs.create(target, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
