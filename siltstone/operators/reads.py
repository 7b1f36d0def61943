"""Reads of a log of entries: scans, lookups, prefixes, floors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import encode
from ..schema import PUT
from .visibility import ROWS_A_BUCKET, bucket_edges, bucket_of, latest_points, mask_ranges, points, ranges, visible


def scan(entries: DataFrame, start: bytes | None = None, end: bytes | None = None, limit: int | None = None, as_of_seq: int | None = None) -> DataFrame:
    """Live (key, value) in [start, end) by key; at most `limit` rows (0: none)."""
    out = visible(entries, start, end, as_of_seq).orderBy("key")
    return out if limit is None else out.limit(max(0, limit))


def seek(entries: DataFrame, target: bytes) -> DataFrame:
    """Live rows from the first key at or after the target on, by key."""
    return scan(entries, start=target)


def get(entries: DataFrame, key: bytes) -> bytes | None:
    """The live value of one key. The key and the covering ranges are filters on the scan."""
    own = points(entries).filter(F.col("key") == F.lit(key))
    over = ranges(entries).filter((F.col("start") <= F.lit(key)) & (F.col("end") > F.lit(key)))
    newest = own.orderBy(F.desc("seq"), F.desc("kind")).limit(1).collect()
    if not newest or newest[0]["kind"] != PUT:
        return None
    cover = over.agg(F.max("rseq")).first()[0]
    return None if cover is not None and cover > newest[0]["seq"] else bytes(newest[0]["value"] or b"")


def exists(entries: DataFrame, key: bytes) -> bool:
    return get(entries, key) is not None


def multi_get(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, found) for every distinct key asked for."""
    asked = keys.select("key").distinct()
    winners = latest_points(points(entries).join(asked, "key", "left_semi")).filter(F.col("kind") == PUT)
    live = mask_ranges(winners, ranges(entries)).select("key", "value", F.lit(True).alias("found"))
    return asked.join(live, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def prefix_scan(entries: DataFrame, *parts, strict: bool = True, limit: int | None = None) -> DataFrame:
    """Live rows whose composite key begins with the parts.

    strict: children only, keys that go on with a separator. Otherwise also keys that merely begin with
    the same bytes ("p2" under "p").
    """
    return scan(entries, *prefix_bounds(*parts, strict=strict), limit)


def prefix_bounds(*parts, strict: bool = True) -> tuple[bytes, bytes]:
    prefix = encode(*parts)
    return prefix + b"\x00", prefix + (b"\x01" if strict else b"\xff")


def sample_index(keyed: DataFrame, interval: int) -> DataFrame:
    """Every interval-th (key, offset) by key, the first one included.

    keyed: key and offset, where offset is the row's place in key order.
    """
    return keyed.filter(F.col("offset") % interval == 0).select("key", "offset")


def unsorted(keyed: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Rows (ord, key) whose key is below the one before; an index of sorted keys has none.

    Rows are compared within blocks of `ord`, a block's first with the last key of the one before.
    """
    rows = keyed.withColumn("_b", F.floor(F.col("ord") / block).cast("long"))
    last = rows.groupBy("_b").agg(F.max_by("key", "ord").alias("_last"))
    carried = last.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_last"))  # one row a block
    before = F.lag("key").over(Window.partitionBy("_b").orderBy("ord"))
    out = rows.withColumn("previous", before).join(carried, "_b").withColumn("previous", F.coalesce("previous", "_last"))
    return out.filter(F.col("previous") > F.col("key")).drop("_b", "_last")


def floor_lookup(index: DataFrame, probes: DataFrame, group: str | None = None) -> DataFrame:
    """probes with the offset of the greatest index key not above each; 0 if there is none.

    `group`, a column of both, is matched exactly and parts the work. Without it keys are
    parted by ranges of the index's own keys, each range starting with the floor below it.
    """
    a = index.select(*([group] if group else []), F.col("key").alias("_k"), F.lit(0).alias("_probe"), F.col("offset").alias("_o"))
    b = probes.select(*([group] if group else []), F.col("key").alias("_k"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_row"))
    both = a.unionByName(b, allowMissingColumns=True)
    if group:
        w = Window.partitionBy(group)
    else:
        edges = bucket_edges(index, max(1, min(4096, math.ceil(probes.count() / ROWS_A_BUCKET))))
        per = index.groupBy(bucket_of(F.col("key"), edges).alias("b")).agg(F.max_by("offset", "key").alias("o")).collect()  # one row a bucket
        known, top, carried = {r["b"]: r["o"] for r in per}, None, []
        for i, e in enumerate(edges):
            top = known.get(i, top)
            carried.append((e, -1, top))
        both = both.unionByName(index.sparkSession.createDataFrame(carried, "_k binary, _probe int, _o long"), allowMissingColumns=True)
        w = Window.partitionBy(bucket_of(F.col("_k"), edges))
    back = w.orderBy("_k", "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_f", F.last("_o", ignorenulls=True).over(back)).filter("_probe = 1").select("_row.*", F.coalesce("_f", F.lit(0)).alias("floor_offset"))
