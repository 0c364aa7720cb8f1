"""Objects under one folder of any file system that Spark reaches: put, get, delete, list."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Blobs:
    """Small objects (attachments, manifests) by key; tables go through Spark's own writers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, key: str = ""):
        if key.startswith("/") or ".." in key.split("/"):
            raise ValueError(f"bad key {key}")
        return self.hadoop.fs.Path(f"{self.folder}/{key}" if key else self.folder)

    def put(self, key: str, data: bytes) -> None:
        """Writes an object as a whole: it is renamed into place when it is complete."""
        stage = self._path(f"{key}.part")
        out = self.fs.create(stage, True)
        out.write(bytearray(data))
        out.close()
        self.fs.delete(self._path(key), False)
        self.fs.rename(stage, self._path(key))

    def get(self, key: str) -> bytes | None:
        if not self.fs.exists(self._path(key)):
            return None
        stream = self.fs.open(self._path(key))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, key: str) -> bool:
        return self.fs.delete(self._path(key), False)

    def list(self, prefix: str = "") -> list[str]:
        """The keys that begin with ``prefix``, in order."""
        if not self.fs.exists(self._path()):
            return []
        files, out = self.fs.listFiles(self._path(), True), []
        base = self.fs.makeQualified(self._path()).toUri().getPath() + "/"
        while files.hasNext():
            key = files.next().getPath().toUri().getPath().removeprefix(base)
            if key.startswith(prefix) and not key.rsplit("/", 1)[-1].startswith("."):
                out.append(key)
        return sorted(out)
