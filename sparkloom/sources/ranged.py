"""Bytes of a file by offset, by whatever file system Spark knows; for previews, not for scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from sparkloom.sources.readers import SourceError


@dataclass(frozen=True)
class ByteFile:
    """A file that is there and not empty, of a known length."""

    spark: SparkSession
    path: str
    length: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ByteFile:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            raise SourceError(f"File not found: {path}")
        if not (length := fs.getFileStatus(where).getLen()):
            raise SourceError(f"File is empty: {path}")
        return cls(spark, path, length)

    def read(self, offset: int, n: int) -> bytes:
        """n bytes from the offset on; a range that isn't wholly in the file is refused."""
        if offset < 0 or n < 0 or offset + n > self.length:
            raise SourceError(f"Bytes {offset} to {offset + n} are not in a file of {self.length}: {self.path}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        stream = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(where)
        try:
            stream.seek(offset)
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    def try_read(self, offset: int, n: int) -> bytes | None:
        """The same, or None for a range that isn't wholly in the file."""
        return self.read(offset, n) if 0 <= offset and 0 <= n and offset + n <= self.length else None
