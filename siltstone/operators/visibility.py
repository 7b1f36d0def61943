"""From a log of versioned entries to the visible state.

A key's visible value is that of its newest point entry, if this is a put and no
newer range delete covers the key. Of equal sequence numbers a delete beats a put, and a put
beats a range delete.

The newest entry per key is found first: a range that hides it hides all older ones,
so only one row a key meets the ranges.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE_KEY, DELETE_RANGE, PUT

#: Up to so many ranges every winner is compared with each; beyond, ranges become fragments.
FEW_RANGES = 64
ROWS_A_BUCKET = 1 << 20


def points(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("kind") != DELETE_RANGE)


def ranges(entries: DataFrame) -> DataFrame:
    """Range deletes as (start, end, rseq)."""
    return entries.filter(F.col("kind") == DELETE_RANGE).select(F.col("key").alias("start"), F.col("range_end").alias("end"), F.col("seq").alias("rseq"))


def in_bounds(key: Column, start: bytes | None, end: bytes | None) -> Column:
    ok = F.lit(True)
    if start is not None:
        ok = ok & (key >= F.lit(start))
    if end is not None:
        ok = ok & (key < F.lit(end))
    return ok


def overlapping(ranges_: DataFrame, start: bytes | None, end: bytes | None) -> DataFrame:
    """Ranges that share a key with [start, end)."""
    ok = F.col("start") < F.col("end")
    if start is not None:
        ok = ok & (F.col("end") > F.lit(start))
    if end is not None:
        ok = ok & (F.col("start") < F.lit(end))
    return ranges_.filter(ok)


def clamped(ranges_: DataFrame, start: bytes | None) -> DataFrame:
    """Ranges whose start is moved up to the scan's."""
    return ranges_ if start is None else ranges_.withColumn("start", F.greatest("start", F.lit(start)))


def latest_points(points_: DataFrame, *key: str) -> DataFrame:
    """The newest point entry per key, whole rows.

    row_number() = 1 lets Spark drop all but one row a key before the shuffle.
    """
    newest = Window.partitionBy(*(key or ("key",))).orderBy(F.desc("seq"), F.desc("kind"), F.desc("value"))
    return points_.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def _fragment(pdf: pd.DataFrame) -> pd.DataFrame:
    """Disjoint pieces of one bucket's ranges with the newest rseq over each."""
    import heapq

    edges = sorted({*pdf["start"], *pdf["end"]})
    todo = sorted(zip(pdf["start"], pdf["end"], pdf["rseq"]))
    heap: list[tuple[int, bytes]] = []
    out, at = [], 0
    for low, high in zip(edges, edges[1:]):
        while at < len(todo) and todo[at][0] <= low:
            heapq.heappush(heap, (-todo[at][2], todo[at][1]))
            at += 1
        while heap and heap[0][1] <= low:
            heapq.heappop(heap)
        if heap:
            if out and out[-1][2] == low and out[-1][3] == -heap[0][0]:
                out[-1][2] = high
            else:
                out.append([pdf["bucket"].iloc[0], low, high, -heap[0][0]])
    return pd.DataFrame(out, columns=["bucket", "start", "end", "rseq"])


def bucket_edges(keyed: DataFrame, buckets: int) -> list[bytes]:
    """Up to buckets - 1 keys that part the rows about evenly, from a bounded sample.

    They only set the balance; results don't depend on them.
    """
    if buckets < 2:
        return []
    sample = keyed.select("key").orderBy(F.xxhash64("key")).limit(min(20_000, 50 * buckets)).collect()
    keys = sorted({bytes(r["key"]) for r in sample})
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}) if keys else []


def bucket_of(key: Column, edges: list[bytes]) -> Column:
    """Number of edges that are not above the key, by binary search in nested conditions."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(edges[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(edges))


def fragment_ranges(ranges_: DataFrame, edges: list[bytes]) -> DataFrame:
    """(bucket, start, end, rseq): disjoint within and between the buckets that edges part."""
    last = F.lit(len(edges))
    first_b = bucket_of(F.col("start"), edges)
    wide = ranges_.filter("start < end").withColumn("_b", F.sequence(first_b, F.least(last, bucket_of(F.col("end"), edges))))
    split = wide.withColumn("bucket", F.explode("_b")).drop("_b")
    if edges:
        low = F.element_at(F.lit(edges), F.greatest(F.col("bucket"), F.lit(1)))
        high = F.element_at(F.lit(edges), F.least(F.col("bucket") + 1, last))
        split = split.withColumns({
            "start": F.when(F.col("bucket") > 0, F.greatest("start", low)).otherwise(F.col("start")),
            "end": F.when(F.col("bucket") < last, F.least("end", high)).otherwise(F.col("end")),
        }).filter("start < end")
    return split.groupBy("bucket").applyInPandas(_fragment, "bucket int, start binary, end binary, rseq long")


def covering_seq(keyed: DataFrame, ranges_: DataFrame, buckets: int | None = None, few: int = FEW_RANGES) -> DataFrame:
    """keyed (a key column and any others) with cover_seq, the newest range over each key.

    Few ranges go through a broadcast nested loop, behind a count. More become disjoint
    fragments in key buckets, and a key looks back to the last fragment's start in its
    bucket: one sort of the keys, whatever the number of ranges.
    """
    n = ranges_.limit(few + 1).count()
    if n == 0:
        return keyed.withColumn("cover_seq", F.lit(None).cast("long"))
    if n <= few:
        rows = ranges_.collect()  # at most `few`
        hits = [F.when((F.col("key") >= F.lit(bytes(r["start"]))) & (F.col("key") < F.lit(bytes(r["end"]))), F.lit(r["rseq"])) for r in rows]
        return keyed.withColumn("cover_seq", F.array_max(F.array(*hits)).cast("long"))
    if buckets is None:
        buckets = max(1, min(4096, math.ceil(keyed.count() / ROWS_A_BUCKET)))
    edges = bucket_edges(keyed, buckets)
    parts = fragment_ranges(ranges_, edges).select("bucket", F.col("start").alias("key"), F.lit(0).alias("_is_key"), F.struct("end", "rseq").alias("_f"))
    own = keyed.select(bucket_of(F.col("key"), edges).alias("bucket"), "key", F.lit(1).alias("_is_key"), F.struct(*keyed.columns).alias("_row"))
    both = own.unionByName(parts, allowMissingColumns=True)
    back = Window.partitionBy("bucket").orderBy("key", "_is_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last("_f", ignorenulls=True).over(back)).filter("_is_key = 1")
    cover = F.when(F.col("key") < F.col("_last.end"), F.col("_last.rseq"))
    return seen.select("_row.*", cover.alias("cover_seq"))


def mask_ranges(rows: DataFrame, ranges_: DataFrame, **options) -> DataFrame:
    """Rows (key, seq, ...) that no newer range covers."""
    covered = covering_seq(rows, ranges_, **options)
    return covered.filter(F.col("cover_seq").isNull() | (F.col("cover_seq") <= F.col("seq"))).drop("cover_seq")


def visible_entries(entries: DataFrame, start: bytes | None = None, end: bytes | None = None, as_of_seq: int | None = None, **options) -> DataFrame:
    """The winning put entries, unordered."""
    if as_of_seq is not None:
        entries = entries.filter(F.col("seq") <= as_of_seq)
    winners = latest_points(points(entries).filter(in_bounds(F.col("key"), start, end))).filter(F.col("kind") == PUT)
    return mask_ranges(winners, overlapping(ranges(entries), start, end), **options)


def visible(entries: DataFrame, start: bytes | None = None, end: bytes | None = None, as_of_seq: int | None = None, **options) -> DataFrame:
    """(key, value) of the live keys in [start, end), unordered."""
    return visible_entries(entries, start, end, as_of_seq, **options).select("key", "value")


def delete_max_seq(entries: DataFrame) -> DataFrame:
    """(key, max_seq, delete_seq) per key: newest entry and newest delete."""
    return points(entries).groupBy("key").agg(F.max("seq").alias("max_seq"), F.max(F.when(F.col("kind") == DELETE_KEY, F.col("seq"))).alias("delete_seq"))
