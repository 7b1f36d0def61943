"""Small files through Spark's own file systems, so that any shared storage serves."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Write a file whose name nobody has taken; False if it is taken. Of several writers one succeeds.

        HDFS refuses to rename onto a file. A local file is linked to its name. Elsewhere (object stores) the
        file is created without overwriting, and appears when it is closed.
        """
        fs, p = self._at(path)
        scheme = fs.getUri().getScheme()
        if scheme not in ("hdfs", "viewfs", "file"):
            if fs.exists(p):
                return False
            try:
                stream = fs.create(p, False)
                stream.write(bytearray(text.encode()))
                stream.close()
            except Py4JJavaError:
                return False
            return True
        _, tmp = self._at(f"{path}.{self.jvm.java.util.UUID.randomUUID().toString()}.tmp")
        stream = fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if scheme != "file":
            done = fs.rename(tmp, p)
        else:
            try:
                os.link(tmp.toUri().getPath(), p.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
        if scheme == "file" or not done:
            fs.delete(tmp, False)
        return done

    def paths(self, path: str, end: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(end)) if fs.exists(p) else []

    def bloom_has(self, path: str, column: str, value: bytes) -> bool:
        """Whether a row group's bloom filter may hold the value, or has none."""
        hadoop = self.jvm.org.apache.parquet.hadoop
        _, p = self._at(path)
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(p, self.conf))
        try:
            binary = self.jvm.org.apache.parquet.io.api.Binary.fromConstantByteArray(bytearray(value))
            for group in reader.getRowGroups():
                for chunk in group.getColumns():
                    if chunk.getPath().toDotString() == column:
                        bloom = reader.readBloomFilter(chunk)
                        if bloom is None or bloom.findHash(bloom.hash(binary)):
                            return True
            return False
        finally:
            reader.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def copy(self, a: str, b: str) -> None:
        (fs, p), (to, q) = self._at(a), self._at(b)
        to.mkdirs(q.getParent())
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, self.conf)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
