"""Results to files: folders of parts as Spark writes them, or one file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_lines(lines: DataFrame, folder: str) -> None:
    """Column value, one line a row, in parts."""
    lines.select("value").write.text(folder)


def write_one(spark: SparkSession, lines: DataFrame, path: str, header: str | None = None, bom: bool = False) -> None:
    """One file: tasks write parts, which are then joined in order as streams of bytes; no row comes to the driver."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    out = hadoop.fs.Path(path)
    fs = out.getFileSystem(conf)
    parts = hadoop.fs.Path(out.getParent() or hadoop.fs.Path("."), f".{out.getName()}-{uuid.uuid4().hex}")
    lines.select("value").write.text(parts.toString())
    fs.setWriteChecksum(False)  # no checksum file beside the one file
    try:
        fs.delete(hadoop.fs.Path(out.getParent() or hadoop.fs.Path("."), f".{out.getName()}.crc"), False)
        stream = fs.create(out, True)
        try:
            if bom:
                stream.write(bytearray(b"\xef\xbb\xbf"))
            if header is not None:
                stream.write(bytearray((header + "\n").encode()))
            for name in sorted(s.getPath().getName() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")):
                part = fs.open(hadoop.fs.Path(parts, name))
                try:
                    hadoop.io.IOUtils.copyBytes(part, stream, 1 << 20, False)
                finally:
                    part.close()
        finally:
            stream.close()
    finally:
        fs.setWriteChecksum(True)
        fs.delete(parts, True)
