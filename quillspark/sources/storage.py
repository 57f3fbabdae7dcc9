"""Small files and directory operations on any Hadoop file system (file:, hdfs:, s3a: ...)."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self._path(self.at(*parts)))

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self._path(self.at(*parts)))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, text: str, *parts: str) -> bool:
        """Writes a small file that isn't there yet; false, and nothing is written, if it is: of several writers one succeeds."""
        target = self._path(self.at(*parts))
        try:
            stream = self.fs.create(target, False)
        except Exception:
            if self.fs.exists(target):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def list(self, *parts: str) -> list[str]:
        if not self.exists(*parts):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.at(*parts))))

    def size(self, *parts: str) -> int:
        return self.fs.getContentSummary(self._path(self.at(*parts))).getLength() if self.exists(*parts) else 0

    def delete(self, *parts: str) -> None:
        self.fs.delete(self._path(self.at(*parts)), True)

    def copy_in(self, source: str, *parts: str) -> None:
        conf, path = self.spark._jsc.hadoopConfiguration(), self._path(source)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(path.getFileSystem(conf), path, self.fs, self._path(self.at(*parts)), False, True, conf)
