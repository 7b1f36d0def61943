"""Shared pieces of the training-data operators: scratch tables and word rules."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])

#: A word: a run of anything but ASCII white space. Java and DuckDB read it alike.
WORD_RE = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prepare(spark: SparkSession) -> None:
    """Make this repository importable in Python workers that start elsewhere."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    # texts are long: the default of 10,000 rows a batch is tens of MB on either side
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def tidied(f):
    """f for mapInArrow; at a task's end its Python worker gives freed memory back.

    Workers outlive tasks: without this an executor keeps every operator's peak.
    """

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    A local session without one gets a temporary folder; a cluster without one
    is refused, since a machine-local folder would not survive an executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
    return sc.getCheckpointDir().rstrip("/")


_open: dict[str, "Scratch"] = {}


class Scratch:
    """Written tables in the shared folder that cut lineage.

    `keep` writes a table and reads it back; `drop` deletes one that no later
    plan reads. A result may read what is left, so that it stays until its owner
    calls `drop()`, or `release` once the session's results are written, or the driver's process ends.
    """

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex[:12]}"
        _open[self.root] = self

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before; the folder is then the cluster's to clean
            return

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        # Shuffle files go once the driver's JVM notices that their plan is gone; its scheduler
        # holds on to the last job, so that a small one has to follow: of one task, and no
        # query, as the driver plans each and keeps its plan.
        sc = self.spark.sparkContext
        one = sc._jvm.java.util.ArrayList()
        one.add(1)
        sc._jsc.parallelize(one, 1).count()
        sc._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete these tables; all of them if none is named."""
        if not names:
            _open.pop(self.root, None)
        for name in names or ("",):
            self._delete(f"{self.root}/{name}".rstrip("/"))


def release(spark: SparkSession | None = None) -> None:
    """Delete the scratch tables of all results so far, of this session or of all. Such results can't be read again."""
    for scratch in list(_open.values()):
        if spark is None or scratch.spark is spark:
            scratch.drop()


atexit.register(release)


def small(spark: SparkSession, rows: list[tuple], schema: str, most: int = 1 << 15) -> DataFrame:
    """Rows of the driver's as a table; marked for broadcast up to `most` rows."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= most else out


def packed(columns: list[str]) -> Column:
    """The caller's columns as one struct, so that no name of theirs clashes with one an operator uses on the way."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(None).cast("struct<none:int>")


def unpacked(columns: list[str], row: str = "row") -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def hex_key(text: Column, digits: int) -> Column:
    """The first hex digits of md5 as a non-negative long (15 digits: 60 bits)."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encode(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned words, in planes of bytes, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], dtype=np.int64)
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays]
    body = b"".join([head.tobytes(), *planes])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def decode(raw: bytes) -> list[np.ndarray]:
    body = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(body, dtype=np.int64, count=1)[0])
    head = np.frombuffer(body, dtype=np.int64, count=2 * n, offset=8)
    at, out = 8 + 16 * n, []
    for size, width in zip(head[::2].tolist(), head[1::2].tolist()):
        planes = np.frombuffer(body, dtype=np.uint8, count=size * width, offset=at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(np.dtype(f"u{width}")).ravel() if size else np.zeros(0, dtype=np.dtype(f"u{width}")))
        at += size * width
    return out
