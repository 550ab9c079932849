"""Small files in whatever store the shared folder is in, through the driver's Hadoop client."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of small files, such as marks of what is committed."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._path = spark._jvm, path
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}" if name else self._path)

    def names(self) -> list[str]:
        """The names in the folder, sorted; none where there is no folder."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")))

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one of that name."""
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        file = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()
