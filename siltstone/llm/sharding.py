"""Operator 2, sharding by histogram sort.

Rows are ordered by (60 bits of md5(text), doc_id), so that equal texts are
neighbours and hot sources or languages spread. Iterated histograms count the
exact bytes below candidate boundaries until every splitter is known; then the
whole rows are exchanged once. The histogram also gives the rows below every
splitter, so a row's slot needs no second pass.

A splitter stays on the edge of a group of equal texts if that edge is within
`tolerance` of the shard size; only a larger group is cut, between doc_ids.

Defined cases: null text weighs 8 bytes and all null texts form one group (key
-1); null doc_id sorts first; repeated rows (same text and doc_id) never part;
a very long text is one row like any other, and a shard that holds it may be larger by
it; an empty table gives no rows; other columns pass through, and columns that clash
with the ones added are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hex_key, packed, unpacked
from .splitters import Edge, locate

NO_ID = -(2**63)
LOCAL = 2**33 - 1  # monotonically_increasing_id: the low bits count within a partition


def piece_of(k1: np.ndarray, k2: np.ndarray, key: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """Number of splitters (k1, k2) that are not above each (key, sub)."""
    left, right = np.searchsorted(k1, key, "left"), np.searchsorted(k1, key, "right")
    out = left.astype(np.int64)
    for i in np.flatnonzero(left < right):
        out[i] += np.searchsorted(k2[left[i] : right[i]], sub[i], "right")
    return out


def nearest(e: Edge, target: float) -> tuple[float, bool]:
    """Distance of the key's nearer edge, and whether that is its upper one."""
    low, high = target - e.below, e.below + e.weight - target
    return (low, False) if low <= high else (high, True)


def histogram_sort(df: DataFrame, shards: int = 24, tolerance: float = 0.02, piece_bytes: int = 512 << 20, columns: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Rows of df (their `columns`, all by default), with size, text_key, shard and slot.

    Within a shard, slots follow the order by (text_key, doc_id), from 0 without
    gaps. A shard is exchanged as pieces of about `piece_bytes`, each sorted by one task.
    """
    scratch = scratch or Scratch(df.sparkSession)
    columns = [c for c in (df.columns if columns is None else columns) if c not in ("size", "text_key", "shard", "slot")]
    rows = df.select(packed(columns).alias("row"), "text", "doc_id").withColumns({
        "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long"),
        "text_key": F.coalesce(hex_key(F.col("text"), 15), F.lit(-1)),
        "_sub": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
    })
    digest = scratch.keep(rows.select(F.col("text_key").alias("key"), "_sub", F.col("size").alias("w")), "digest")
    total = digest.agg(F.sum("w")).first()[0] or 0
    per_shard = max(1, math.ceil(total / shards / piece_bytes))
    pieces = shards * per_shard
    wanted = [total * j / pieces for j in range(1, pieces)]
    slack = [tolerance * total / shards if j % per_shard == 0 else total / pieces / 2 for j in range(1, pieces)]
    found = locate(digest.select(F.lit(0).alias("g"), "key", "w"), {0: wanted})

    # (key, doc_id) of the first row above each cut, and the rows below it
    cuts: list[tuple[int, int, int] | None] = []
    inside: dict[int, list[int]] = {}
    for j, (t, s) in enumerate(zip(wanted, slack)):
        e = found[0, j]
        if e is None:
            cuts.append((2**62, NO_ID, -1))
            continue
        gap, upper = nearest(e, t)
        if gap <= s or e.rows == 1:
            cuts.append((e.key + 1, NO_ID, e.rows_below + e.rows) if upper else (e.key, NO_ID, e.rows_below))
        else:
            cuts.append(None)
            inside.setdefault(e.key, []).append(j)
    if inside:
        keys = sorted(inside)
        number = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (k, i)])
        part = digest.filter(F.col("key").isin(keys)).select(number[F.col("key")].alias("g"), F.col("_sub").alias("key"), "w")
        split = locate(part, {i: [wanted[j] - found[0, j].below for j in inside[k]] for i, k in enumerate(keys)})
        for i, k in enumerate(keys):
            for n, j in enumerate(inside[k]):
                e, base = split[i, n], found[0, j]
                _, upper = nearest(e, wanted[j] - base.below)
                cuts[j] = (k, e.key + 1, base.rows_below + e.rows_below + e.rows) if upper else (k, e.key, base.rows_below + e.rows_below)
    every = digest.count()
    cuts = [(a, b, every if n < 0 else n) for a, b, n in cuts]
    k1, k2 = np.array([c[0] for c in cuts], dtype=np.int64), np.array([c[1] for c in cuts], dtype=np.int64)
    starts = [0, *(c[2] for c in cuts)]
    base = [starts[p] - starts[p - p % per_shard] for p in range(pieces)]

    @F.pandas_udf("int")
    def piece(key: pd.Series, sub: pd.Series) -> pd.Series:
        return pd.Series(piece_of(k1, k2, key.to_numpy(), sub.to_numpy()).astype(np.int32))

    placed = (
        rows.select("row", "size", "text_key", "_sub", piece("text_key", "_sub").alias("_piece"))
        .repartitionById(pieces, F.col("_piece"))
        .sortWithinPartitions("text_key", "_sub")
        .withColumns({
            "shard": F.floor(F.col("_piece") / per_shard).cast("int"),
            "slot": F.element_at(F.lit(base), F.col("_piece") + 1).cast("long") + F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL)),
        })
    )
    return placed.select(*unpacked(columns), "size", "text_key", "shard", "slot")


def crc32_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def oracle(shards: int = 24, tolerance: float = 0.02) -> str:
    """DuckDB SQL for the op2 query: running sizes in key order, and the nearest edge to each shard's exact end."""
    return f"""
with d as (select doc_id, text, coalesce(strlen(text), 0) + 8 as size, coalesce(('0x' || substr(md5(text), 1, 15))::bigint, -1) as key from documents),
o as (select doc_id, key, size, row_number() over (order by key, doc_id nulls first) as r, sum(size) over (order by key, doc_id nulls first rows unbounded preceding) as upto from d),
g as (select key, min(upto - size) as lo, max(upto) as hi, min(r) - 1 as r_lo, max(r) as r_hi from o group by key),
w as (select j, (select sum(size) from d) * j / {float(shards)}::double as want, (select sum(size) from d) * {tolerance}::double / {shards} as slack from (select unnest(range(1, {shards})) as j)),
edge as (select j, case when least(want - lo, hi - want) <= slack or r_hi - r_lo = 1 then case when want - lo <= hi - want then r_lo else r_hi end
    else (select case when want - (upto - size) <= upto - want then r - 1 else r end from o where upto - size <= want and want < upto) end as e from w join g on lo <= want and want < hi),
s as (select o.*, (select count(*) from edge where e < r) as shard, coalesce((select max(e) from edge where e < r), 0) as first from o),
b as (select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) as b from d where text is not null),
crc as (select doc_id, xor(4294967295, list_reduce(list_concat([4294967295::bigint], b),
    lambda c, x: xor(([{', '.join(map(str, crc32_table()))}]::bigint[])[xor(c & 255, x) + 1], c >> 8)))::bigint as text_crc32 from b)
select s.doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard::int as shard, (r - 1 - first)::bigint as slot, null::int as grown_shard from s left join crc using (doc_id)
"""
