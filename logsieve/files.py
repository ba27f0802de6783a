"""Folders of the shared file system, by Spark's own file access."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """Lists and removes what lies directly below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def names(self) -> list[str]:
        """The entries of the folder; none if there is no such folder."""
        if not self._fs.exists(self._path):
            return []
        return sorted(entry.getPath().getName() for entry in self._fs.listStatus(self._path))

    def finished(self) -> list[str]:
        """Entries that a job has written to the end."""
        return [name for name in self.names() if self._fs.exists(self._child(self._child(self._path, name), "_SUCCESS"))]

    def remove(self, name: str) -> None:
        self._fs.delete(self._child(self._path, name), True)
