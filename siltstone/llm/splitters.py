"""Exact weighted splitters by iterated histograms.

Every round counts, over all rows, the exact weight below a set of probe keys.
Each wanted position then lies between two probes; the next round probes inside
that interval only, until one key value holds the position. What reaches the
driver is one row per probe interval: (number of positions) x `probes` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

COUNT_SCHEMA = "g int, bucket long, w long, n long, lo long, hi long"


@dataclass(frozen=True)
class Edge:
    """The key whose rows hold a position: weight and rows below it, and of it."""

    key: int
    below: int
    weight: int
    rows_below: int
    rows: int


def _counter(probes: dict[int, np.ndarray]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy(zero_copy_only=False)
            key = b.column(1).to_numpy(zero_copy_only=False)
            w = b.column(2).to_numpy(zero_copy_only=False)
            order = np.lexsort((key, g))
            g, key, w = g[order], key[order], w[order]
            bucket = np.zeros(len(g), dtype=np.int64)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(g)]):
                at = probes.get(int(g[s]))
                if at is not None:
                    bucket[s:e] = np.searchsorted(at, key[s:e], side="right")
            cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (bucket[1:] != bucket[:-1])])
            end = np.r_[cut[1:], len(g)] - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(g[cut], pa.int32()),
                    pa.array(bucket[cut], pa.int64()),
                    pa.array(np.add.reduceat(w, cut), pa.int64()),
                    pa.array(end - cut + 1, pa.int64()),
                    pa.array(key[cut], pa.int64()),
                    pa.array(key[end], pa.int64()),
                ],
                names=["g", "bucket", "w", "n", "lo", "hi"],
            )

    return count


def histogram(digest: DataFrame, probes: dict[int, np.ndarray]) -> dict[int, list]:
    """Per group, its non-empty probe intervals in key order."""
    rows = (
        digest.select(F.col("g").cast("int"), F.col("key").cast("long"), F.col("w").cast("long"))
        .mapInArrow(tidied(_counter(probes)), COUNT_SCHEMA)
        .groupBy("g", "bucket")
        .agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .collect()
    )
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["g"], r["bucket"])):
        out.setdefault(r["g"], []).append(r)
    return out


def locate(digest: DataFrame, targets: dict[int, list[float]], probes: int = 32) -> dict[tuple[int, int], Edge | None]:
    """For target i of group g: the key with below <= target < below + weight.

    `digest` has g int, key long and w long (not negative), none null. None where
    the target is not below the group's weight. Ties share a key and stay together.
    """
    found: dict[tuple[int, int], Edge | None] = {}
    at: dict[int, np.ndarray] = {}
    while True:
        counts = histogram(digest, at)
        ask: dict[int, set[int]] = {}
        for g, wanted in targets.items():
            rows = counts.get(g, [])
            below = np.cumsum([0] + [r["w"] for r in rows])
            rows_below = np.cumsum([0] + [r["n"] for r in rows])
            for i, t in enumerate(wanted):
                if (g, i) in found:
                    continue
                k = int(np.searchsorted(below, t, side="right")) - 1
                if k >= len(rows) or k < 0:
                    found[g, i] = None
                    continue
                r = rows[k]
                if r["lo"] == r["hi"]:
                    found[g, i] = Edge(r["lo"], int(below[k]), r["w"], int(rows_below[k]), r["n"])
                    continue
                # lo and hi are probes too: the interval is kept, and its ends always part
                span = r["hi"] - r["lo"]
                n = min(probes, span)
                ask.setdefault(g, set()).update(r["lo"] + span * j // n for j in range(n + 1))
        if not ask:
            return found
        at = {g: np.array(sorted(x), dtype=np.int64) for g, x in ask.items()}
