"""Byte n-grams: counting with Spark, and sorted hash arrays to look them up.

An n-gram of up to 6 bytes is packed into a long, the newest byte lowest. A text
is preceded by n-1 zero bytes and followed by one (the end symbol).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

SLAB = 1 << 18  # bytes of text handled at once: its arrays stay in a core's cache
MERGE = 1 << 22  # grams that a task holds before it merges them


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words: equal hashes mean equal keys."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class HashArray:
    """Keys as one sorted array of hashes, with a directory on their top bits.

    Hashes are uniform, so a directory of about one entry a key leaves one or two
    candidates to compare.
    """

    def __init__(self, keys: np.ndarray):
        h = mix64(keys.astype(np.uint64))
        self.order = np.argsort(h, kind="stable")
        self.hashes = np.append(h[self.order], np.uint64(0))
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        edges = np.arange(2**bits, dtype=np.uint64) << self.shift
        start = np.searchsorted(self.hashes[:-1], edges)
        self.start = np.append(start, len(keys)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position in the sorted order of each key, -1 where absent."""
        h = mix64(keys)
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.where((self.hashes[at] == h) & (at < end), at, -1)
        rest = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            hit = self.hashes[at[rest]] == h[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit & (at[rest] + 1 < end[rest])]
        return out


def slabs(raws: list[bytes], order: int, limit: int = SLAB) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, segment starts, document of each segment) for all texts, whole.

    One gram for each byte and for each end. Long texts are cut into segments that
    keep their context, so memory doesn't follow the longest text.
    """
    pad = bytes(order - 1)
    parts: list[bytes] = []
    sizes: list[int] = []
    docs: list[int] = []
    held = 0

    def flush():
        buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
        n = len(buf) - order + 1
        grams = np.zeros(n, dtype=np.uint64)
        for i in range(order):
            grams <<= np.uint64(8)
            grams |= buf[i : n + i]
        lengths = np.array(sizes)
        begin = np.cumsum(lengths + order - 1) - (lengths + order - 1)
        keep = np.ones(n + order - 1, dtype=bool)
        for i in range(order - 1):
            keep[begin + lengths + i] = False
        return grams[keep[:n]], np.cumsum(lengths) - lengths, np.array(docs)

    for d, raw in enumerate(raws):
        whole = raw + b"\x00"
        for s in range(0, len(whole), limit):
            body = whole[s : s + limit]
            before = (pad + whole[max(0, s - order + 1) : s])[-(order - 1) :] if order > 1 else b""
            parts.append(before + body)
            sizes.append(len(body))
            docs.append(d)
            held += len(body)
            if held >= limit:
                yield flush()
                parts, sizes, docs, held = [], [], [], 0
    if parts:
        yield flush()


def runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in a sorted array."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = runs(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _count(order: int, normal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out():
            for g, parts in held.items():
                k, n = merged(parts)
                for s in range(0, len(k), 1 << 16):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * len(k[s : s + 65536]), pa.string()), pa.array(k[s : s + 65536].view(np.int64)), pa.array(n[s : s + 65536])],
                        names=["g", "gram", "n"],
                    )

        for b in batches:
            by: dict[str, list[bytes]] = {}
            for g, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = normal(raw)
                if raw is not None:
                    by.setdefault(g, []).append(raw)
            for g, raws in by.items():
                for grams, _, _ in slabs(raws, order):
                    grams.sort()
                    at = runs(grams)
                    held.setdefault(g, []).append((grams[at], np.diff(np.r_[at, len(grams)])))
                    size += len(at)
                    if size > MERGE:
                        held = {g: [merged(parts)] for g, parts in held.items()}
                        size = sum(len(p[0][0]) for p in held.values())
                        if size > MERGE // 2:
                            yield from out()
                            held, size = {}, 0
        yield from out()

    return run


def same(raw: bytes) -> bytes:
    return raw


def count_ngrams(df: DataFrame, order: int, normal=same) -> DataFrame:
    """(g, gram, n) over all rows of df, whose columns are g string and raw binary.

    `normal` maps a text to what is counted, None to leave it out.
    """
    return df.mapInArrow(tidied(_count(order, normal)), "g string, gram long, n long").groupBy("g", "gram").agg(F.sum("n").alias("n"))


def shorter(level: DataFrame, order: int) -> DataFrame:
    """Continuation counts: for each gram of order - 1, its number of different left bytes."""
    mask = (1 << 8 * (order - 1)) - 1
    return level.groupBy("g", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("n"))


PIECE = 1 << 21  # grams fetched by one job: what one result holds is fixed, their number isn't


def gathered(level: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """All grams of a written level as sorted arrays by g, whatever their counts: 16 bytes each on the driver."""
    pieces = max(1, -(-level.count() // PIECE))
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i in range(pieces):
        found = level.filter(F.pmod(F.xxhash64("g", "gram"), F.lit(pieces)) == i).toArrow()
        for g in pc.unique(found.column("g")).to_pylist():
            part = found.filter(pc.equal(found.column("g"), g))
            parts.setdefault(g, []).append((part.column("gram").to_numpy(), part.column("n").to_numpy()))
        del found
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for g in sorted(parts):
        gram, n = (np.concatenate(x) for x in zip(*parts.pop(g)))
        order = np.argsort(gram)
        out[g] = (gram[order].view(np.uint64), n[order].astype(np.int64))
    return out
