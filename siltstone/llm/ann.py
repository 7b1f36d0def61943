"""Operator 8, approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword from each of M
codebooks. The codebooks start as k-means of the residuals and are then refitted by
least squares to beam-search codes, on a bounded sample. All rows are coded by beam
search, and the norm of each reconstruction is stored. A query scores the codes of a
block from lookup tables (its inner products with all codewords; with the stored
norms for the distance), and the best `depth` of the block are scored again exactly,
in double precision, before they leave the task.

Queries are a stated set; they meet the index in blocks, joined by block number.

Defined cases: rows with a null id, a null or zero vector, null or non-finite components
or another than the most frequent length take no part; rows that share an id
are one item (of different vectors, the one with the smallest bytes); fewer candidates
than k: all; ties go to the smaller id; no rows, no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidied

FOUND = "query_id long, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = n > 0
        start = (np.cumsum(n) - n)[full]
        c[full] = np.add.reduceat(x[order], start, axis=0) / n[full, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes (n, M) by beam search over the codebooks in turn."""
    m, k, d = books.shape
    flat = books.reshape(m * k, d)
    gram, sq = flat @ flat.T, (flat * flat).sum(1)
    out = np.zeros((len(x), m), dtype=np.uint8 if k <= 256 else np.uint16)
    for s in range(0, len(x), 1024):
        xc = x[s : s + 1024] @ flat.T
        n = len(xc)
        codes, cost = np.zeros((n, 1, 0), dtype=np.int64), np.zeros((n, 1), dtype=np.float32)
        for j in range(m):
            part = slice(j * k, (j + 1) * k)
            step = (sq[part] - 2 * xc[:, part])[:, None, :] + cost[:, :, None]
            for i in range(j):
                step = step + 2 * gram[i * k + codes[:, :, i], part]
            width = step.shape[1]
            step = step.reshape(n, -1)
            keep = min(beam, step.shape[1])
            best = np.argpartition(step, keep - 1, axis=1)[:, :keep]
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, best // k], (best % k)[:, :, None]], axis=2)
            cost = step[rows, best]
            assert width * k >= keep
        pick = np.argmin(cost, axis=1)
        out[s : s + n] = codes[np.arange(n), pick]
    return out


def train(x: np.ndarray, m: int = 8, k: int = 256, rounds: int = 2, seed: int = 0) -> np.ndarray:
    """Codebooks (m, k, d): residual k-means, then least squares on beam-search codes."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    k = min(k, len(x))
    rest, books = x.copy(), []
    for _ in range(m):
        c = kmeans(rest, k, 6, rng)
        rest = rest - c[np.argmin((c * c).sum(1) - 2 * (rest @ c.T), axis=1)]
        books.append(c)
    books = np.stack(books)
    for _ in range(rounds):
        codes = encode(x, books, 4)
        cols = codes.astype(np.int64) + np.arange(m) * k
        ata = np.zeros((m * k, m * k), dtype=np.float64)
        atx = np.zeros((m * k, x.shape[1]), dtype=np.float64)
        for i in range(m):
            np.add.at(atx, cols[:, i], x)
            for j in range(m):
                ata += np.bincount(cols[:, i] * (m * k) + cols[:, j], minlength=(m * k) ** 2).reshape(m * k, m * k)
        ata[np.diag_indices(m * k)] += 0.5
        books = (np.linalg.solve(ata, atx + 0.5 * books.reshape(m * k, -1)).astype(np.float32)).reshape(books.shape)
    return books


def _vectors(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(zero_copy_only=False), np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)


def _pack(d: int, most: int, books: np.ndarray | None, beam: int):
    """One row per up to `most` vectors: ids, vectors (double), and codes and norms if coded."""

    def row(items: dict[int, bytes]) -> pa.RecordBatch:
        ids = np.array(sorted(items), dtype=np.int64)
        x = np.frombuffer(b"".join(items[i] for i in ids), dtype=np.float64).reshape(-1, d)
        codes = norms = b""
        if books is not None:
            code = encode(x.astype(np.float32), books, beam)
            made = sum(books[j][code[:, j]] for j in range(len(books)))
            codes, norms = code.tobytes(), (made * made).sum(1).astype(np.float32).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (ids.tobytes(), x.tobytes(), codes, norms)], names=["ids", "x", "codes", "norms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, bytes] = {}
        for b in batches:
            if b.num_rows:
                for i, v in zip(*_vectors(b, d)):
                    raw = v.tobytes()
                    if int(i) not in items or raw < items[int(i)]:
                        items[int(i)] = raw
        keys = sorted(items)
        for s in range(0, len(keys), most):
            yield row({i: items[i] for i in keys[s : s + most]})

    return run


def _search(d: int, books: np.ndarray, k: int, depth: int, metric: str):
    m, size, _ = books.shape
    flat = books.reshape(m * size, d)
    kind = np.uint8 if size <= 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, x = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["x"], dtype=np.float64).reshape(-1, d)
                codes = np.frombuffer(r["codes"], dtype=kind).reshape(-1, m).astype(np.int64) + np.arange(m) * size
                norms = np.frombuffer(r["norms"], dtype=np.float32)
                qids, q = np.frombuffer(r["qids"], dtype=np.int64), np.frombuffer(r["qx"], dtype=np.float64).reshape(-1, d)
                out: list[tuple] = []
                for s in range(0, len(q), 64):
                    part = q[s : s + 64]
                    table = part.astype(np.float32) @ flat.T
                    score = sum(np.take(table, codes[:, j], axis=1) for j in range(m))
                    if metric == "l2":
                        score = 2 * score - norms
                    take = min(depth, len(ids))
                    near = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(part), 1))
                    if metric == "l2":
                        exact = -((x[near] - part[:, None, :]) ** 2).sum(2)
                    else:
                        exact = np.einsum("qnd,qd->qn", x[near], part)
                    for i in range(len(part)):
                        mine = ids[near[i]]
                        ok = mine != qids[s + i]
                        mine, e = mine[ok], exact[i][ok]
                        best = np.lexsort((mine, -e))[:k]
                        out.append((np.full(len(best), qids[s + i]), mine[best], e[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["query_id", "vec_id", "score"])

    return run


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of rows that take part, v as doubles."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def search(df: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", books: int = 8, words: int = 256, sample: int = 16384, beam: int = 8, depth: int = 1024, block: int = 16384, metric: str = "ip", seed: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest to every row that meets `queries`.

    `queries` is a condition on vec_id. `sample` bounds the rows the codebooks are
    fitted on (those with the smallest hash of the id).
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    rows = usable(df, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(queries.cast("int")).alias("q")).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = max(sizes, key=lambda r: (r["n"], -r["d"]))
    d = top["d"]
    rows = rows.filter(F.size("v") == d)
    some = rows.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).distinct()
    fitted = rows.join(F.broadcast(some), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").toArrow()  # at most `sample` ids
    x = np.asarray(fitted.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, d)
    book = train(x, books, words, seed=seed)

    def packed(part: DataFrame, n: int, most: int, coded: bool) -> DataFrame:
        parts = max(1, math.ceil(n / most))
        spread = part.repartitionById(parts, F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
        return spread.mapInArrow(tidied(_pack(d, most, book if coded else None, beam)), "ids binary, x binary, codes binary, norms binary")

    number = F.monotonically_increasing_id()
    index = scratch.keep(packed(rows, top["n"], block, True).withColumn("block", number), "index")
    asked = scratch.keep(packed(rows.filter(queries), top["q"] or 0, 1024, False).select(F.col("ids").alias("qids"), F.col("x").alias("qx")), "queries")
    blocks = index.select("block")
    # every query block goes to every index block: one small row each
    spread = _to_blocks(asked, [r["block"] for r in blocks.collect()])
    hits = index.join(spread, "block").drop("block").mapInArrow(tidied(_search(d, book, k, depth, metric)), FOUND)
    best = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def _to_blocks(asked: DataFrame, blocks: list[int]) -> DataFrame:
    return asked.withColumn("block", F.explode(F.lit(blocks) if blocks else F.array().cast("array<long>")))
