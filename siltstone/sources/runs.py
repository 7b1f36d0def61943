"""Sorted runs: where entries are kept.

A run is Parquet sorted by key, so that row-group statistics (and a bloom filter on the
key) prune lookups and scans. Its range deletes lie beside it in a table of their own: they are few, and every
read needs them. A memory run is a DataFrame with the same rows.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..schema import DELETE_RANGE, ENTRY_SCHEMA
from .files import Files


@dataclass(frozen=True)
class Run:
    level: int
    path: str
    seq_tag: int
    min_key: str | None  # hex; over points and starts of ranges
    max_key: str | None  # over points and ends of ranges
    n_points: int
    n_ranges: int
    bytes: int

    def json(self) -> dict:
        return asdict(self)

    def meets(self, start: bytes | None, end: bytes | None) -> bool:
        """Whether the run can hold a key of [start, end)."""
        if self.min_key is None:
            return True
        return (end is None or self.min_key < end.hex()) and (start is None or self.max_key >= start.hex())


def describe(entries: DataFrame) -> tuple[int, int, int, str | None, str | None]:
    """(points, ranges, last seq, least key, greatest key as hex)."""
    is_range = F.col("kind") == DELETE_RANGE
    r = entries.agg(F.count(F.when(~is_range, 1)), F.count(F.when(is_range, 1)), F.max("seq"), F.lower(F.hex(F.min("key"))), F.lower(F.hex(F.max(F.greatest("key", F.coalesce("range_end", "key")))))).first()
    return r[0], r[1], r[2] or 0, r[3], r[4]


class ParquetRuns:
    def __init__(self, spark: SparkSession, root: str, compression: str = "snappy", rows_a_file: int = 5_000_000):
        self.spark, self.root, self.compression, self.rows_a_file = spark, root.rstrip("/"), compression, rows_a_file
        self.files = Files(spark)

    def write(self, entries: DataFrame, level: int, sort: bool = True) -> Run | None:
        """A new run of all the entries; None if there are none."""
        path = f"{self.root}/L{level}/{uuid.uuid4().hex}"
        rows = entries.select(*ENTRY_SCHEMA.names, F.when(F.col("kind") == DELETE_RANGE, "ranges").otherwise("points").alias("part"))
        if sort:
            rows = rows.repartitionByRange("part", "key", "seq").sortWithinPartitions("part", "key", F.desc("seq"))
        writer = rows.write.option("compression", self.compression).option("parquet.bloom.filter.enabled#key", "true").option("maxRecordsPerFile", self.rows_a_file)
        writer.partitionBy("part").parquet(path)  # entries are computed once for both
        n, r, tag, low, high = describe(self._read(path))
        if not n + r:
            self.files.delete(path)
            return None
        return Run(level, path, tag, low, high, n, r, self.files.size(path))

    def _read(self, *paths: str) -> DataFrame:
        parts = [f"{p}/part={part}" for p in paths for part in ("points", "ranges")]
        found = [p for p in parts if self.files.exists(p)]
        return self.spark.read.schema(ENTRY_SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], ENTRY_SCHEMA)

    def read(self, runs: list[Run]) -> DataFrame:
        """One scan over all runs' files."""
        for r in runs:
            if not self.readable(r):
                raise StoreError(f"run {r.path} can't be read")
        return self._read(*(r.path for r in runs))

    def readable(self, run: Run) -> bool:
        """Whether its files are there, with the bytes that the manifest names."""
        return self.files.exists(run.path) and self.files.size(run.path) == run.bytes

    def might_contain(self, run: Run, key: bytes) -> bool:
        """False only if no point entry of the run has the key: by its bounds, then by the files' bloom filters."""
        if not run.n_points or not run.meets(key, key + b"\x00"):
            return False
        return any(self.files.bloom_has(f, "key", key) for f in self.files.paths(f"{run.path}/part=points", ".parquet"))

    def delete(self, run: Run) -> None:
        self.files.delete(run.path)


class MemoryRuns:
    """Runs that live in the session, tombstones and sequence numbers included."""

    def __init__(self, spark: SparkSession, most: int = 1_000_000):
        self.spark, self.held, self.most = spark, {}, most

    def write(self, entries: DataFrame, level: int, sort: bool = True) -> Run | None:
        rows = entries.select(*ENTRY_SCHEMA.names)
        found = (rows.orderBy("key", F.desc("seq")) if sort else rows).limit(self.most + 1).collect()
        if len(found) > self.most:
            raise StoreError(f"a store in memory takes runs of at most {self.most} entries; give it a path")
        held = self.spark.createDataFrame(found, ENTRY_SCHEMA)
        n, r, tag, low, high = describe(held)
        if not n + r:
            return None
        path = f"memory:{uuid.uuid4().hex}"
        self.held[path] = held
        return Run(level, path, tag, low, high, n, r, 0)

    def read(self, runs: list[Run]) -> DataFrame:
        out = self.spark.createDataFrame([], ENTRY_SCHEMA)
        for r in runs:
            out = out.unionByName(self.held[r.path])
        return out

    def readable(self, run: Run) -> bool:
        return run.path in self.held

    def might_contain(self, run: Run, key: bytes) -> bool:
        return not self.held[run.path].filter((F.col("kind") != DELETE_RANGE) & (F.col("key") == F.lit(key))).isEmpty()

    def paths(self) -> list[str]:
        return sorted(self.held)

    def delete(self, run: Run) -> None:
        self.held.pop(run.path, None)
