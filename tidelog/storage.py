"""Files of a table through Hadoop's file system, so that any store Spark reads can hold one, and tables written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .model import ConflictError


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.uri(name))

    def mkdirs(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def list(self, name: str = "") -> list[tuple[str, int]]:
        """Names and sizes in a folder; none if it isn't there."""
        if not self.exists(name):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a whole file under a name that nobody has published before."""
        partial = f"{name}.{uuid.uuid4().hex}.tmp"  # no other writer's
        stream = self._fs.create(self._path(partial), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(name) or not self._fs.rename(self._path(partial), self._path(name)):
            raise ConflictError(f"{name} was published by another writer")

    def move(self, source: str, target: str) -> None:
        self.mkdirs(target.rpartition("/")[0])
        if not self._fs.rename(self._path(source), self._path(target)):
            raise ConflictError(f"cannot move {source} to {target}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where unset (as in tests) a temporary folder is set for the session."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidelog.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.tidelog.shared.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors never cause it to be computed again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*saved: DataFrame) -> None:
    """Delete tables that ``save`` wrote and that nothing will read again."""
    for df in saved:
        folder, _, name = df._saved_at.rpartition("/")
        Storage(df.sparkSession, folder).delete(name)
