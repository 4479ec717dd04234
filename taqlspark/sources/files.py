"""Small files through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str) -> tuple[Any, Any]:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return bool(fs.exists(p))

    def is_dir(self, path: str) -> bool:
        fs, p = self._path(path)
        return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())

    def delete(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    def make_dir(self, path: str) -> None:
        fs, p = self._path(path)
        fs.mkdirs(p)

    def children(self, path: str) -> list[str]:
        fs, p = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def read(self, path: str) -> bytes:
        fs, p = self._path(path)
        with_length = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        try:
            return bytes(stream.readNBytes(int(with_length)))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Write under a passing name and move it, so a reader sees the old file or the new one."""
        fs, p = self._path(path)
        passing = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(passing, True)
        out.write(bytearray(data))
        out.close()
        if not fs.rename(passing, p):
            fs.delete(p, False)
            fs.rename(passing, p)

    def copy(self, source: str, target: str) -> None:
        a, p = self._path(source)
        b, q = self._path(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, self.conf)
