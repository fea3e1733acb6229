"""Files of any Hadoop file system, by URI or local path."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def names(self, path: str) -> list[str]:
        """Of the entries of a folder, sorted; none if it doesn't exist."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def walk(self, path: str) -> list[tuple[str, int]]:
        """(path below it, size) of all files under a folder, sorted."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        top, out = fs.makeQualified(p).toUri().getPath().rstrip("/"), []
        it = fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toUri().getPath()[len(top) + 1 :], s.getLen()))
        return sorted(out)

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_json(self, path: str):
        return json.loads(self.read(path).decode())

    def write(self, path: str, data: bytes, overwrite: bool = True) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def replace(self, path: str, data: bytes) -> None:
        """Puts a file in place in one step: readers see the old or the new one."""
        temp = f"{path}.new"
        self.write(temp, data)
        fs, p = self._at(path)
        _, t = self._at(temp)
        if not fs.rename(t, p):
            fs.delete(p, False)  # file systems that don't rename onto an existing file
            if not fs.rename(t, p):
                raise OSError(f"can't write {path}")

    def copy(self, source: str, target: str) -> None:
        (a, x), (b, y) = self._at(source), self._at(target)
        b.mkdirs(y.getParent())
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, True, self.conf)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)
