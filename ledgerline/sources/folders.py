"""Small files and renames on any file system that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Files below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def numbers(self, folder: str) -> list[int]:
        return sorted(int(n) for n in self.names(folder) if n.isdigit())

    def delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def put(self, name: str, text: str) -> None:
        """A small file, complete or not there."""
        part, fs = self._path(f"_part-{uuid.uuid4().hex}")
        stream = fs.create(part)
        stream.write(bytearray(text.encode()))
        stream.close()
        final, _ = self._path(name)
        fs.mkdirs(final.getParent())
        fs.delete(final, False)
        fs.rename(part, final)

    def get(self, name: str) -> str:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move(self, name: str, to: str) -> None:
        """Rename, unless there is something by the new name already."""
        path, fs = self._path(name)
        final, _ = self._path(to)
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(path, final):
            fs.delete(path, True)
