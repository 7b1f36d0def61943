"""The commit log as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..schema import COMMIT, ENTRY, ENTRY_SCHEMA, ROLLBACK, WAL_SCHEMA
from ..sources.files import Files

END_DDL = "txn_id long, lsn long, type tinyint"
HELD = ["txn_id", "lsn", *ENTRY_SCHEMA.names]
HELD_SCHEMA = StructType([WAL_SCHEMA[name] for name in HELD])


def read_wal(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(WAL_SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ends_of(records: DataFrame) -> DataFrame:
    """(txn_id, lsn, type) of a log's commits and rollbacks."""
    return records.filter(F.col("type").isin(COMMIT, ROLLBACK)).select("txn_id", "lsn", "type")


def ended(entries: DataFrame, ends: DataFrame) -> DataFrame:
    """Entries with _end, the type of their transaction's first end that is not before them, or null.

    A number may be taken again by a later transaction, so its older ends leave newer entries open.
    """
    before = F.lag("lsn").over(Window.partitionBy("txn_id").orderBy("lsn"))
    spans = ends.select(F.col("txn_id").alias("_txn"), before.alias("_after"), F.col("lsn").alias("_to"), F.col("type").alias("_end"))
    own = (F.col("txn_id") == F.col("_txn")) & (F.col("lsn") <= F.col("_to")) & (F.col("_after").isNull() | (F.col("lsn") > F.col("_after")))
    return entries.join(spans, own, "left").select(*entries.columns, "_end")


class Release:
    """Writes the committed entries of micro-batches of a log, one folder of target a batch.

    A transaction's records may come in any order and in several batches: entries without an end are held for
    the next batch, and ends are kept (three numbers each) for entries that come after theirs. Both lie under
    the checkpoint. A batch that runs again replaces what it wrote.
    """

    def __init__(self, target: str, checkpoint: str):
        self.target, self.open, self.ends = target, f"{checkpoint}/open", f"{checkpoint}/ends"

    def known_ends(self, batch: DataFrame, number: int) -> DataFrame:
        """The batch's ends, and older ones of the transactions between its least and largest number."""
        spark = batch.sparkSession
        # the rollback of a segment that could not be written has no place in the log
        lost = (F.col("type") == ROLLBACK) & (F.col("lsn") == 0)
        new = spark.read.schema(END_DDL).parquet(f"{self.ends}/batch={number}").withColumn("lsn", F.when(lost, 2**63 - 1).otherwise(F.col("lsn")))
        if number == 0:
            return new
        low, high = batch.filter(F.col("type") == ENTRY).agg(F.min("txn_id"), F.max("txn_id")).first()
        old = spark.read.schema(END_DDL).parquet(self.ends).filter(F.col("batch") < number).filter(F.col("txn_id").between(low, high))
        return new.unionByName(old.drop("batch"))

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ends_of(batch).write.mode("overwrite").parquet(f"{self.ends}/batch={number}")
        entries = batch.filter(F.col("type") == ENTRY).select(*HELD)
        if number > 0:
            entries = entries.unionByName(spark.read.schema(HELD_SCHEMA).parquet(f"{self.open}/batch={number - 1}"))
        marked = ended(entries, self.known_ends(batch, number)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            marked.filter(F.col("_end") == COMMIT).select(*ENTRY_SCHEMA.names).write.mode("overwrite").parquet(f"{self.target}/batch={number}")
            marked.filter(F.col("_end").isNull()).select(*HELD).write.mode("overwrite").parquet(f"{self.open}/batch={number}")
        finally:
            marked.unpersist()
        Files(spark).delete(f"{self.open}/batch={number - 2}")  # only the last batch can run again


def tail(wal: DataFrame, target: str, checkpoint: str, available_now: bool = True):
    """Write committed entries under target, one folder a micro-batch; a batch that runs again replaces its folder."""
    writer = wal.writeStream.foreachBatch(Release(target, checkpoint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tailed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(ENTRY_SCHEMA).parquet(f"{target}/batch=*")


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["seq", "kind"], kind="stable")
    seq, kind, value = rows.iloc[-1][["seq", "kind", "value"]]
    best = (int(seq), int(kind), value)
    if state.exists and tuple(state.get)[:2] > best[:2]:
        best = tuple(state.get)
    state.update(best)
    yield pd.DataFrame([(best[0], best[1], key[0], best[2])], columns=["seq", "kind", "key", "value"])


def latest_stream(entries: DataFrame) -> DataFrame:
    """Updates of the newest point entry per key; a late, older entry changes nothing.

    Range deletes touch many keys and so have no place in keyed state: apply them when reading.
    """
    pts = entries.filter(F.col("kind") != 2).select("seq", "kind", "key", "value")
    return pts.groupBy("key").applyInPandasWithState(_newest, "seq long, kind tinyint, key binary, value binary", "seq long, kind tinyint, value binary", "update", GroupStateTimeout.NoTimeout)
