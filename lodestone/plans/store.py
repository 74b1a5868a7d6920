"""Small files and folders of an index on whatever file system Spark knows, local or shared."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def index_folder(spark: SparkSession) -> str:
    """A fresh folder for derived tables that all executors see: below ``spark.checkpoint.dir``; without that only for a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/index-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    _LOCAL.append(tempfile.mkdtemp(prefix=f"index-{os.getpid()}-"))
    return f"file://{_LOCAL[-1]}"


@atexit.register
def _forget_local() -> None:
    for path in _LOCAL:
        shutil.rmtree(path, ignore_errors=True)


class Store:
    """A folder, by Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.root)

    def names(self) -> list[str]:
        """Names in the folder; none if it is not there."""
        folder = self._path("")
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file under another name and then rename it, so that it is there whole or not at all; it must not be there yet."""
        hidden = self._path(f".{name}.tmp")
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(hidden, self._path(name)):
            raise FileExistsError(f"another writer was first: {self.at(name)}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def stat(self) -> list[tuple[str, int, int]]:
        """Path, length and modification time of the folder's files, or of the file that the path is."""
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self._fs.listStatus(self._path("")))
