"""The files of one folder, on any file system that Spark's executors share."""

from pyspark.sql import SparkSession


class Files:
    """Names are relative to the folder ``base``, a path or URI; a path without scheme is on the default file system."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.base = self._fs.makeQualified(self._path(base)).toString().rstrip("/")

    @property
    def local(self) -> str | None:
        """The folder's path if it is on this machine's own file system."""
        return self._path(self.base).toUri().getPath() if self._fs.getScheme() == "file" else None

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _at(self, name: str):
        return self._path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def make(self) -> None:
        self._fs.mkdirs(self._path(self.base))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.base))]

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, new: bool = False) -> None:
        """Writes a file; ``new``: raises if it is there already."""
        stream = self._fs.create(self._at(name), not new)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, name: str, to: str) -> bool:
        return self._fs.rename(self._at(name), self._at(to))
