"""Operator 1, quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned
filters slide over embedded bytes; each filter is max-pooled within a chunk, and a
document's features are the mean and the maximum of that over its chunks. A logistic
layer makes one probability of them.

Training runs on the driver, on the whole texts of a bounded sample of labelled rows (the `per_class`
rows of each label with the smallest hash, without those of more than `longest` bytes), with a fixed number of steps,
so its cost doesn't depend on the corpus. Batches are balanced; the bias is then
moved to the labels' own proportion. Scoring reads every byte of every text, however long.

Scoring uses that a filter over embedded bytes is a sum of table entries: pairs of
neighbouring bytes index tables of 65,536 rows, one table for two taps.

Defined cases: null and empty texts are one chunk of zero bytes; rows with null
doc_id are scored, and are not held out unless their crc32 says so (null: false);
repeated rows get equal scores; labels with null, conflicting (the smaller counts) or
missing rows are fine; without both labels every score is the proportion of 1 (0.5 without
labels); no rows, no rows; columns that clash with added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, tidied, unpacked

CHUNK, STEP, BLOCK = 512, 448, 64  # chunks of 512 bytes every 448: blocks of 64 make both
TAPS, EMBED, FILTERS = 8, 6, 24


@dataclass
class Net:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (TAPS * EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (2 * FILTERS,)
    base: float

    def tables(self) -> np.ndarray:
        """(TAPS / 2, 65536, FILTERS): what a pair of bytes adds at each pair of taps."""
        w = self.filters.reshape(TAPS, EMBED, FILTERS)
        one = np.einsum("be,tef->tbf", self.embed, w).astype(np.float32)
        return np.stack([(one[t][:, None, :] + one[t + 1][None, :, :]).reshape(65536, FILTERS) for t in range(0, TAPS, 2)])


GROUP = 384  # chunks that training holds at once, beside those of one more text


def gradient(params: list[np.ndarray], texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Gradient of the summed log loss by embedding, filters, their bias, output layer and base."""
    x = np.concatenate(texts).astype(np.int64)
    n = np.array([len(t) for t in texts])
    doc, start = np.repeat(np.arange(len(texts)), n), np.cumsum(n) - n
    e = params[0].astype(np.float32)[x]
    view = np.lib.stride_tricks.sliding_window_view(e, TAPS, axis=1)  # (N, L, EMBED, TAPS)
    patches = np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), -1, TAPS * EMBED)
    h = patches @ params[1].astype(np.float32)
    at = h.argmax(1)  # (N, FILTERS)
    top = np.take_along_axis(h, at[:, None, :], 1)[:, 0, :] + params[2]
    act = np.maximum(top, 0)
    mean, most = np.add.reduceat(act, start) / n[:, None], np.maximum.reduceat(act, start)
    feature = np.concatenate([mean, most], 1)
    d = 1 / (1 + np.exp(-(feature @ params[3] + params[4]))) - labels
    g_feature = d[:, None] * params[3]
    g_act = (g_feature[:, :FILTERS] / n[:, None])[doc] + g_feature[:, FILTERS:][doc] * (act == most[doc])
    g_top = g_act * (top > 0)
    rows = np.arange(len(x))[:, None]
    g_filters = np.einsum("nfp,nf->pf", patches[rows, at], g_top)
    g_patch = g_top[:, :, None] * params[1].T[None]
    g_embed = np.zeros_like(params[0])
    for t in range(TAPS):
        np.add.at(g_embed, x[rows, at + t].ravel(), g_patch[:, :, t * EMBED : (t + 1) * EMBED].reshape(-1, EMBED))
    return [g_embed, g_filters, g_top.sum(0), feature.T @ d, np.array([d.sum()])]


def fit(chunks: list[np.ndarray], labels: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Net:
    """Adam on balanced batches. chunks[i] is (number of chunks, CHUNK) bytes of text i."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.2, (TAPS * EMBED, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0)
    params = [net.embed, net.filters, net.bias, net.out, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    sides = [np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(s, batch // 2) for s in sides])
        pick = pick[np.argsort([len(chunks[i]) for i in pick], kind="stable")]
        total = [np.zeros_like(p) for p in params]
        # texts of many chunks come in groups of their own: memory doesn't follow the longest
        group = np.cumsum([len(chunks[i]) for i in pick]) // GROUP
        for g in np.unique(group):
            for t, x in zip(total, gradient(params, [chunks[i] for i in pick[group == g]], labels[pick[group == g]])):
                t += x / batch
        total[3] += 1e-4 * params[3]
        speed = rate * min(1, step / 30) * (0.1 + 0.9 * (1 - step / steps))
        for q, g, (a, b) in zip(params, total, moments):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    share = float((labels == 1).mean())
    return Net(params[0], params[1], params[2], params[3], float(params[4][0] + np.log(share / (1 - share))))


def doc_scores(tables: np.ndarray, net: Net, raws: list[bytes], limit: int = 1 << 18) -> np.ndarray:
    """Probability of label 1 for each text, over all its bytes."""
    sums, most = np.zeros((len(raws), FILTERS)), np.full((len(raws), FILTERS), -np.inf)
    number = np.zeros(len(raws), dtype=np.int64)
    parts: list[bytes] = []
    docs: list[int] = []
    held = 0

    def flush():
        # every part is a whole number of blocks, then TAPS - 1 bytes of what follows
        buf = np.frombuffer(b"".join(parts) + bytes(TAPS), dtype=np.uint8)
        pair = (buf[:-1].astype(np.int32) << 8) | buf[1:]
        sizes = np.array([len(p) - (TAPS - 1) for p in parts])
        begin = np.cumsum(sizes + TAPS - 1) - (sizes + TAPS - 1)
        where = np.concatenate([np.arange(b, b + s) for b, s in zip(begin, sizes)])
        h = np.take(tables[0], pair[where], axis=0)
        for t in range(1, TAPS // 2):
            h += np.take(tables[t], pair[where + 2 * t], axis=0)
        blocks = h.reshape(-1, BLOCK, FILTERS).max(1)
        per = sizes // BLOCK
        first = np.cumsum(per) - per
        for d, s, k in zip(docs, first, per):
            starts = np.arange(0, max(1, k - 1), STEP // BLOCK)
            pooled = np.maximum.reduceat(blocks[s : s + k], starts) if len(starts) > 1 else blocks[s : s + k].max(0)[None]
            ends = starts + CHUNK // BLOCK - 1  # the block that a chunk shares with the next one
            inside = ends < k
            pooled[inside] = np.maximum(pooled[inside], blocks[s + ends[inside]])
            act = np.maximum(pooled + net.bias, 0)
            sums[d] += act.sum(0)
            most[d] = np.maximum(most[d], act.max(0))
            number[d] += len(act)

    room = limit // STEP * STEP
    for d, raw in enumerate(raws):
        for s in range(0, max(1, len(raw)), room):
            body = raw[s : s + room + CHUNK - STEP + TAPS - 1]
            if s and len(raw) - s <= CHUNK - STEP:  # the chunk before holds it
                break
            full = min(room + CHUNK - STEP, -(-len(body) // BLOCK) * BLOCK or BLOCK)
            parts.append(body[: full + TAPS - 1].ljust(full + TAPS - 1, b"\0"))
            docs.append(d)
            held += full
            if held >= limit:
                flush()
                parts, docs, held = [], [], 0
    if parts:
        flush()
    z = np.concatenate([sums / np.maximum(number, 1)[:, None], most], 1) @ net.out + net.base
    return 1 / (1 + np.exp(-z))


def chunked(raw: bytes) -> np.ndarray:
    """All chunks of a text, for training."""
    starts = range(0, max(1, len(raw) - (CHUNK - STEP)), STEP)
    return np.stack([np.frombuffer(raw[s : s + CHUNK].ljust(CHUNK, b"\0"), dtype=np.uint8) for s in starts])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, longest: int = 1 << 16, steps: int = 500) -> Net | float:
    """The net; a constant score if not both labels occur outside the held-out fold."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"))
    picked = None
    for v in (0, 1):
        part = known.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("raw")).join(F.broadcast(picked), "doc_id")  # at most 2 * per_class ids
    rows = rows.select("doc_id", "label", F.coalesce("raw", F.lit(b"")).alias("raw")).filter(F.octet_length("raw") <= longest)
    got = rows.orderBy("doc_id", "raw").limit(4 * per_class).collect()  # ids may repeat
    y = np.array([r["label"] for r in got])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    net = fit([chunked(bytes(r["raw"])) for r in got], y, steps)
    share = known.agg(F.avg("label")).first()[0]
    own = float((y == 1).mean())
    net.base += float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return net


def _score(net: Net | float, schema: T.StructType):
    tables = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal tables
        if isinstance(net, Net) and tables is None:
            tables = net.tables()
        for big in batches:
            for s in range(0, big.num_rows, 512):
                b = big.slice(s, 512)
                raws = [x or b"" for x in b.column("raw").to_pylist()]
                p = doc_scores(tables, net, raws) if isinstance(net, Net) else np.full(len(raws), net)
                cols = [pa.array(p, pa.float64()) if f.name == "score" else b.column(f.name) for f in schema]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return run


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", columns: list[str] | None = None, threshold: float = 0.3, **options) -> DataFrame:
    """Rows of documents (their `columns`, all by default) with score, held_out and predicted."""
    net = train(documents, labels, label, **options)
    columns = [c for c in (documents.columns if columns is None else columns) if c not in ("score", "held_out", "predicted")]
    source = documents.select(packed(columns).alias("row"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("raw"))
    schema = T.StructType([f for f in source.schema if f.name != "raw"] + [T.StructField("score", T.DoubleType())])
    out = source.mapInArrow(tidied(_score(net, schema)), schema)
    return out.select(*unpacked(columns), "score", "held_out", (F.col("score") >= threshold).cast("int").alias("predicted"))
