"""Merging runs, and which runs to merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE_RANGE, PUT
from .visibility import latest_points, mask_ranges, points, ranges


def merge_runs(*runs: DataFrame) -> DataFrame:
    """All versions of all runs."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def compact(entries: DataFrame, bottom: bool = False) -> DataFrame:
    """The newest point per key, without puts that a newer range covers, and all ranges.

    Deletes stay, as older runs may hold what they delete. With `bottom` nothing older exists:
    deletes and ranges go too. The visible state is the same before and after.
    """
    newest = latest_points(points(entries))
    puts = mask_ranges(newest.filter(F.col("kind") == PUT), ranges(entries))
    if bottom:
        return puts.select(*entries.columns)
    return puts.select(*entries.columns).unionByName(newest.filter(F.col("kind") != PUT).select(*entries.columns)).unionByName(entries.filter(F.col("kind") == DELETE_RANGE))


def dedup_on_seal(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(key, value): the last value per key."""
    return rows.groupBy("key").agg(F.max_by("value", order).alias("value"))


def fan_in(manifest: DataFrame, threshold: int, levels: int) -> DataFrame:
    """(level, files) of the levels above the last that have enough files to merge."""
    return manifest.filter(F.col("level") < levels - 1).groupBy("level").agg(F.count("*").alias("files")).filter(F.col("files") >= threshold)


def install(manifest: DataFrame, inputs: DataFrame, output: DataFrame) -> DataFrame:
    """The manifest with the input files (path) replaced by the output rows."""
    return manifest.join(inputs.select("path"), "path", "left_anti").select(*manifest.columns).unionByName(output.select(*manifest.columns))


def take_level(manifest: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(the level's rows by path, the manifest without them)."""
    return manifest.filter(F.col("level") == level).orderBy("path"), manifest.filter(F.col("level") != level)


def input_bytes(manifest: DataFrame) -> DataFrame:
    """(level, bytes) that a merge of each level would read."""
    return manifest.groupBy("level").agg(F.sum("bytes").alias("bytes"))


def prune_ranges(entries: DataFrame, min_live_seq: int | None = None, drop=None) -> DataFrame:
    """entries without the range deletes older than min_live_seq, or that meet the condition `drop`.

    Legal once nothing older than they are can be read any more.
    """
    gone = F.lit(False)
    if min_live_seq is not None:
        gone = gone | (F.col("seq") < min_live_seq)
    if drop is not None:
        gone = gone | drop
    return entries.filter((F.col("kind") != DELETE_RANGE) | ~F.coalesce(gone, F.lit(False)))


def unexpired(visible: DataFrame, now, column: str = "expires_at") -> DataFrame:
    """Live rows whose time to live hasn't run out; a null never does."""
    return visible.filter(F.col(column).isNull() | (F.col(column) > now))
