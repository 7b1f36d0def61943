"""Batches of mutations as DataFrames: sequence numbers, insert checks, results of deletes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE_KEY, DELETE_RANGE, OP_DELETE, OP_DELETE_RANGE, OP_INSERT, OP_PUT, PUT
from .visibility import FEW_RANGES, ROWS_A_BUCKET, bucket_edges, bucket_of

BLOCK = 1 << 16


def assign_seq(batch: DataFrame, base: int, order: str = "ord", block: int = BLOCK) -> DataFrame:
    """batch with seq = base + 1, base + 2, ... by `order`, a distinct non-negative integer.

    Blocks of orders are counted, the counts are summed up, and rows are numbered within
    their block: no task sorts more than `block` rows.
    """
    blocks = batch.withColumn("_b", F.floor(F.col(order) / block).cast("long"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    skip = blocks.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return blocks.withColumn("_own", own).join(skip, "_b").withColumn("seq", F.lit(base) + F.col("_skip") + F.col("_own")).drop("_b", "_own", "_skip")


def to_entries(batch: DataFrame) -> DataFrame:
    """Numbered mutations as log entries; a checked insert is a put."""
    op = F.col("op")
    kind = F.when(op.isin(OP_PUT, OP_INSERT), PUT).when(op == OP_DELETE, DELETE_KEY).when(op == OP_DELETE_RANGE, DELETE_RANGE)
    value = F.when(op.isin(OP_PUT, OP_INSERT), F.coalesce("value", F.lit(b"")))
    return batch.select(F.col("seq").cast("long"), kind.cast("byte").alias("kind"), "key", value.alias("value"), F.when(op == OP_DELETE_RANGE, F.col("range_end")).alias("range_end"))


def _numbered_ends(wipes: DataFrame) -> tuple[DataFrame, list[bytes], list[int]]:
    """(key, n) for the distinct ends of ranges, numbered from 1 by key; the bucket edges; the ends before each bucket."""
    ends = wipes.select(F.explode(F.array("start", "end")).alias("key")).distinct()
    edges = bucket_edges(ends, max(1, min(4096, math.ceil(ends.count() / ROWS_A_BUCKET))))
    placed = ends.withColumn("_b", bucket_of(F.col("key"), edges))
    count = {r["_b"]: r["count"] for r in placed.groupBy("_b").count().collect()}  # a row a bucket
    before = [sum(count.get(j, 0) for j in range(i)) for i in range(len(edges) + 1)]
    own = F.row_number().over(Window.partitionBy("_b").orderBy("key"))
    return placed.select("key", (F.element_at(F.lit(before), F.col("_b") + 1) + own).cast("long").alias("n")), edges, before


def _nodes(size: int, depth: int) -> Column:
    """The nodes of a binary tree over numbers below `size` that make up [l, r) exactly: 2 * depth at most."""

    def step(acc: Column, _: Column) -> Column:
        low, high, out = acc["l"], acc["r"], acc["out"]
        none = F.array().cast("array<bigint>")
        left, right = (low < high) & (low % 2 == 1), (low < high) & (high % 2 == 1)
        found = F.concat(out, F.when(left, F.array(low)).otherwise(none), F.when(right, F.array(high - 1)).otherwise(none))
        return F.struct(F.shiftright(low + left.cast("long"), 1).alias("l"), F.shiftright(high - right.cast("long"), 1).alias("r"), found.alias("out"))

    start = F.struct((F.col("l") + size).alias("l"), (F.col("r") + size).alias("r"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, step, lambda acc: acc["out"])


def last_wipe(rows: DataFrame, wipes: DataFrame, few: int = FEW_RANGES) -> DataFrame:
    """(ord, _wipe) of the rows (ord, key) that a range (start, end, rseq) with rseq < ord covers: the greatest such rseq.

    Few ranges become conditions, behind a count. More become nodes of a binary tree over the
    numbered ends of ranges, a logarithm of them each; a key lies in one node of each depth. Rows and
    ranges of a node then meet by blocks of `ord`, so that a node that covers all keys is no hot group.
    """
    wipes = wipes.filter("start < end")
    known = wipes.limit(few + 1).collect()
    if len(known) <= few:
        if not known:
            return rows.select("ord", F.lit(None).cast("long").alias("_wipe")).filter("_wipe is not null")
        hits = [F.when((F.col("key") >= F.lit(bytes(r["start"]))) & (F.col("key") < F.lit(bytes(r["end"]))) & (F.col("ord") > r["rseq"]), F.lit(r["rseq"])) for r in known]
        return rows.select("ord", F.array_max(F.array(*hits)).cast("long").alias("_wipe")).filter("_wipe is not null")
    ends, edges, before = _numbered_ends(wipes)
    depth = (ends.count() + 1).bit_length()
    size = 1 << depth
    spans = wipes.join(ends.select(F.col("key").alias("start"), F.col("n").alias("l")), "start").join(ends.select(F.col("key").alias("end"), F.col("n").alias("r")), "end")
    marks = spans.select("rseq", F.explode(_nodes(size, depth)).alias("node"))
    # a key's number is that of the last end at or before it
    both = rows.select("key", "ord", F.lit(None).cast("long").alias("n"), F.lit(1).alias("_row")).unionByName(ends.select("key", F.lit(None).cast("long").alias("ord"), "n", F.lit(0).alias("_row")))
    bucket = bucket_of(F.col("key"), edges)
    back = Window.partitionBy(bucket).orderBy("key", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.coalesce(F.last("n", ignorenulls=True).over(back), F.element_at(F.lit(before), bucket + 1).cast("long"))
    placed = both.withColumn("n", number).filter("_row = 1")
    asks = placed.select("ord", F.explode(F.array(*(F.shiftright(F.col("n") + size, h) for h in range(depth + 1)))).alias("node"))
    asks = asks.join(marks.select("node").distinct(), "node", "left_semi")
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    # per node and block of ord: the last range of the blocks before, one row each
    per = marks.select("node", block("rseq").alias("_b"), "rseq").unionByName(asks.select("node", block("ord").alias("_b"), F.lit(None).cast("long").alias("rseq")))
    per = per.groupBy("node", "_b").agg(F.max("rseq").alias("m"))
    carry = F.max("m").over(Window.partitionBy("node").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = per.select("node", "_b", carry.alias("rseq")).filter("rseq is not null").select("node", "_b", F.lit(-1).cast("long").alias("at"), "rseq")
    own = marks.select("node", block("rseq").alias("_b"), F.col("rseq").alias("at"), "rseq").unionByName(carried)
    met = own.withColumn("ord", F.lit(None).cast("long")).unionByName(asks.select("node", block("ord").alias("_b"), F.col("ord").alias("at"), F.lit(None).cast("long").alias("rseq"), "ord"))
    upto = Window.partitionBy("node", "_b").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = met.withColumn("_wipe", F.max("rseq").over(upto)).filter("ord is not null and _wipe is not null")
    return found.groupBy("ord").agg(F.max("_wipe").alias("_wipe"))


def live_before(batch: DataFrame, live: DataFrame, few: int = FEW_RANGES) -> DataFrame:
    """Point mutations with live_before: whether the key lives just before the mutation.

    That is so if the last mutation of the batch that touches the key put it, or if none
    does and it is in `live` (key). Range deletes of the batch touch all keys they cover.
    """
    own = batch.filter(F.col("op") != OP_DELETE_RANGE)
    wipes = batch.filter(F.col("op") == OP_DELETE_RANGE).select(F.col("key").alias("start"), F.col("range_end").alias("end"), F.col("ord").cast("long").alias("rseq"))
    by_key = Window.partitionBy("key").orderBy("ord")
    steps = own.withColumns({"_op": F.lag("op").over(by_key), "_at": F.lag("ord").over(by_key)})
    base = live.select("key").distinct().withColumn("_live", F.lit(True))
    known = steps.join(last_wipe(own.select(F.col("ord").cast("long").alias("ord"), "key"), wipes, few), "ord", "left").join(base, "key", "left")
    wiped = F.col("_wipe") > F.coalesce("_at", F.lit(-1))
    lives = F.when(F.coalesce(wiped, F.lit(False)), False).when(F.col("_op").isNotNull(), F.col("_op") != OP_DELETE).otherwise(F.coalesce("_live", F.lit(False)))
    return known.withColumn("live_before", lives).drop("_op", "_at", "_wipe", "_live")


def insert_conflicts(batch: DataFrame, live: DataFrame) -> DataFrame:
    """The inserts (ord, key) that meet a live key. Any of them fails the whole batch."""
    return live_before(batch, live).filter((F.col("op") == OP_INSERT) & F.col("live_before")).select("ord", "key")


def insert_if_absent(inserts: DataFrame, live: DataFrame) -> DataFrame:
    """The inserts whose key isn't live; the first by ord of those with one key."""
    first = Window.partitionBy("key").orderBy("ord")
    fresh = inserts.join(live.select("key"), "key", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def delete_existed(batch: DataFrame, live: DataFrame) -> DataFrame:
    """(ord, key, existed) of the batch's deletes."""
    return live_before(batch, live).filter(F.col("op") == OP_DELETE).select("ord", "key", F.col("live_before").alias("existed"))


def overlay(entries: DataFrame, staged: DataFrame, begin_seq: int) -> DataFrame:
    """What a transaction sees: entries up to its begin, and its staged mutations on top."""
    own = to_entries(assign_seq(staged, begin_seq))
    return entries.filter(F.col("seq") <= begin_seq).select(*own.columns).unionByName(own)
