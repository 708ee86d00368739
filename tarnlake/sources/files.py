"""Small files and folders through Hadoop's file systems, so that a path may have any scheme that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Reads, writes, renames and deletes under any path."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _of(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._of(path)
        return fs.exists(at)

    def read(self, path: str) -> str:
        fs, at = self._of(path)
        stream = fs.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces a file: written beside it, then renamed, so a crash leaves the old or the new one."""
        beside = f"{path}.{uuid.uuid4().hex}"
        fs, at = self._of(beside)
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        _, final = self._of(path)
        if fs.exists(final):
            fs.delete(final, False)
        fs.rename(at, final)

    def newest(self, path: str) -> str | None:
        """The path, or a file written beside it that a crash kept from its name; None without either."""
        if self.exists(path):
            return path
        fs, at = self._of(f"{path}.*")
        found = sorted(fs.globStatus(at) or [], key=lambda s: s.getModificationTime())
        return found[-1].getPath().toString() if found else None

    def delete(self, path: str) -> None:
        fs, at = self._of(path)
        fs.delete(at, True)
