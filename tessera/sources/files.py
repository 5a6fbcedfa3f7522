"""Small files in any store that Spark can reach, and a shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_fallback: list[str] = []
OBJECT_STORES = {"s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cosn", "obs"}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and
    all of Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _fallback[0], True)
    return _fallback[0]


class Files:
    """Reads, and writes that publish a whole file or nothing."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.streams = jvm.org.apache.commons.io.IOUtils

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        where = self.at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.streams.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """False if the file is there already; of two writers one wins.

        That takes a store whose rename refuses a target that is there, such as
        HDFS; on local disks a hard link does.  Object stores that copy instead
        of renaming can't tell, and are refused.
        """
        scheme = self.fs.getUri().getScheme()
        if scheme in OBJECT_STORES:
            raise ValueError(f"{scheme} has no atomic rename; commits need a file system")
        hidden = self.at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self.at(name)
        if scheme == "file":
            try:
                os.link(hidden.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self.fs.delete(hidden, False)
        done = not self.fs.exists(target) and self.fs.rename(hidden, target)
        if not done:
            self.fs.delete(hidden, False)
        return bool(done)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
