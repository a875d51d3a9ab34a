"""Small text files and folder listings in whatever store Spark uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Names, texts and deletions below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.system = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, kind: str) -> list[str]:
        """What lies in a folder below; nothing if there is none."""
        at = self.path(kind)
        return [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a text that appears under its name only when it is whole."""
        draft = self.path(f"{name}.draft")
        out = self.system.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.system.delete(self.path(name), False)
        if not self.system.rename(draft, self.path(name)):
            raise OSError(f"cannot write {self.folder}/{name}")

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)
