"""Small files and folders of the table store, through the file system of Spark's own paths.

Any store that Spark can write is reached (HDFS, object stores, shared mounts). These are metadata calls of
the driver: pointer files of some hundred bytes and the list of a table's versions; no table data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class StoreFiles:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._system(path).exists(self._path(path))

    def read(self, path: str) -> str | None:
        """Text of a small file; None where there is none."""
        system = self._system(path)
        if not system.exists(self._path(path)):
            return None
        stream = system.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """``path`` holds ``text`` afterwards, and its old text until then: a rename replaces it."""
        new = self._path(f"{path}.{uuid.uuid4().hex}")
        stream = self._system(path).create(new, True)
        try:
            stream.write(text.encode("utf-8"))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(context.makeQualified(new), context.makeQualified(self._path(path)), options)

    def folders(self, path: str) -> list[tuple[str, float]]:
        """(name, time of last change in seconds) of the folders in ``path``."""
        system = self._system(path)
        if not system.exists(self._path(path)):
            return []
        found = system.listStatus(self._path(path))
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in found if s.isDirectory()]

    def remove(self, path: str) -> None:
        """Remove a folder with all it holds."""
        self._system(path).delete(self._path(path), True)
