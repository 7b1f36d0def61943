"""The commit log as rows: records of transactions, and what they committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BEGIN, COMMIT, ENTRY, ROLLBACK, WAL_SCHEMA
from .files import Files


def to_wal(entries: DataFrame, txn: str = "txn_id", rolled_back=None) -> DataFrame:
    """Log records for entries with a transaction number: begin, entries, then commit or rollback.

    lsn = 4 * seq for entries; begin just before a transaction's first, its end just after the last.
    """
    ok = F.lit(True) if rolled_back is None else ~rolled_back
    own = entries.select((F.col("seq") * 4).alias("lsn"), F.lit(ENTRY).cast("byte").alias("type"), F.col(txn).alias("txn_id"), "seq", "kind", "key", "value", "range_end")
    ends = entries.groupBy(F.col(txn).alias("txn_id")).agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    begin = ends.select((F.col("a") * 4 - 1).alias("lsn"), F.lit(BEGIN).cast("byte").alias("type"), "txn_id")
    end = ends.select((F.col("b") * 4 + 1).alias("lsn"), F.when(ok, COMMIT).otherwise(ROLLBACK).cast("byte").alias("type"), "txn_id")
    return own.unionByName(begin, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)


def committed(wal: DataFrame) -> DataFrame:
    """Entries of transactions that have a commit and no rollback; others, torn tails too, are ignored."""
    ends = wal.filter(F.col("type").isin(COMMIT, ROLLBACK)).groupBy("txn_id").agg(F.max("type").alias("_end"))
    good = ends.filter(F.col("_end") == COMMIT)
    return wal.filter(F.col("type") == ENTRY).join(good, "txn_id", "left_semi").select("seq", "kind", "key", "value", "range_end")


def uncommitted(wal: DataFrame) -> DataFrame:
    """(txn_id, entries) of the transactions that replay leaves out."""
    good = wal.filter(F.col("type") == COMMIT).select("txn_id").join(wal.filter(F.col("type") == ROLLBACK).select("txn_id"), "txn_id", "left_anti")
    return wal.filter(F.col("type") == ENTRY).join(good, "txn_id", "left_anti").groupBy("txn_id").agg(F.count("*").alias("entries"))


def record_counts(wal: DataFrame) -> DataFrame:
    return wal.groupBy("type").agg(F.count("*").alias("records"))


def bounded_tail(wal: DataFrame, most: int) -> DataFrame:
    """The newest `most` records; older ones fall out of a bounded buffer."""
    return wal.orderBy(F.desc("lsn")).limit(most)


class SegmentWriter:
    """Appends transactions to a log of Parquet segments, one folder each, in the order of their names.

    A segment appears whole or not at all as far as replay is concerned: its commit record is written in a
    file of its own, after its entries. An error leaves a rollback record instead.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        names = [n for n in self.files.names(self.path) if n.startswith("segment=")]
        self.next = 1 + max((int(n.split("=")[1]) for n in names), default=-1)

    def append(self, entries: DataFrame, txn_id: int) -> str:
        """Write one transaction (seq, kind, key, value, range_end); the segment's folder."""
        segment = f"{self.path}/segment={self.next:012d}"
        self.next += 1
        records = to_wal(entries.withColumn("txn_id", F.lit(txn_id).cast("long"))).select(*WAL_SCHEMA.names)
        ended = F.col("type") == COMMIT
        try:
            records.filter(~ended).write.parquet(segment)
            records.filter(ended).coalesce(1).write.mode("append").parquet(segment)  # one record
        except Exception:
            rollback = [(0, ROLLBACK, txn_id, None, None, None, None, None)]
            self.spark.createDataFrame(rollback, WAL_SCHEMA).coalesce(1).write.mode("append").parquet(segment)
            raise
        return segment


def read_segments(spark: SparkSession, path: str, skip_torn: bool = True) -> DataFrame:
    """All records of a log of segments. Files that can't be read, such as a torn last one, are left out or fail."""
    return spark.read.schema(WAL_SCHEMA).option("ignoreCorruptFiles", str(skip_torn).lower()).option("recursiveFileLookup", "true").parquet(path)
