"""Files of a table through Hadoop's file system: list, publish by rename, remove.

Works alike for every scheme the cluster's Hadoop configuration knows, so the
same code runs against a local folder in tests and a shared store on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """Files of one table through Hadoop's file system, whatever the scheme."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def names(self, *parts: str) -> list[str]:
        folder = self.Path(self.path(*parts))
        if not self.fs.exists(folder):
            return []
        return sorted(status.getPath().getName() for status in self.fs.listStatus(folder))

    def read_text(self, *parts: str) -> str:
        stream = self.fs.open(self.Path(self.path(*parts)))
        reader = self.spark.sparkContext._jvm.java.io.BufferedReader(
            self.spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8")
        )
        try:
            lines = []
            line = reader.readLine()
            while line is not None:
                lines.append(line)
                line = reader.readLine()
            return "\n".join(lines)
        finally:
            reader.close()

    def publish(self, text: str, *parts: str) -> bool:
        """Write a file aside and rename it into place; false if it is there already."""
        final = self.Path(self.path(*parts))
        aside = self.Path(self.path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}"))
        out = self.fs.create(aside, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        if self.fs.exists(final) or not self.fs.rename(aside, final):
            self.fs.delete(aside, False)
            return False
        return True

    def remove(self, *parts: str) -> None:
        self.fs.delete(self.Path(self.path(*parts)), True)

    def files(self, *parts: str) -> list[str]:
        """Visible data files of a folder (hidden and marker files left out)."""
        return [name for name in self.names(*parts) if not name.startswith((".", "_"))]

    def rename(self, source: str, target: str) -> bool:
        return self.fs.rename(self.Path(source), self.Path(target))
