"""A folder in any store that Hadoop reaches."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Only with a local master that names none, a folder of this machine is used."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docquire-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def __truediv__(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def make(self) -> None:
        self._fs.mkdirs(self._at())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folders: bool | None = None) -> list[str]:
        """What is in the folder, sorted; nothing if it doesn't exist."""
        if not self.exists():
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at()) if folders is None or s.isDirectory() == folders)

    def stamp(self, name: str) -> tuple[int, int]:
        """When a file was changed, in milliseconds, and how long it is."""
        status = self._fs.getFileStatus(self._at(name))
        return status.getModificationTime(), status.getLen()

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self.stamp(name)[0] / 1000

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def publish(self, name: str, data: bytes) -> bool:
        """Write a file under a name that nobody has taken: whole or not at all. False if it is taken."""
        if self.exists(name):
            return False
        draft = f".draft-{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(draft), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        done = self._fs.rename(self._at(draft), self._at(name))
        if not done:
            self._fs.delete(self._at(draft), False)
        return done

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)
