"""Operator 4, near-duplicates by a containment ensemble of MinHash.

Two documents are linked if the smaller one's set of five-word shingles (lower case)
lies to 0.8 or more in the larger one's, which has at most `max_ratio` times as many:
beyond that, the one is a passage of the other, not a near copy of it.

1. Documents with equal shingle sets become one set (partial aggregation first, so any
   number of copies costs one row a task).
2. Sets are partitioned by size, on two overlapping grids of factor max_ratio squared, so
   that any two within the ratio share a partition. For each partition the containment becomes the
   least Jaccard similarity of two of its members, and bands and rows are tuned for that.
3. Sets that share a band meet in a bucket. 64 one-bit minhashes and the sizes rule out
   pairs that are far from the threshold. Small buckets give all other pairs. In large ones a
   set pairs with the first leader it may be linked to, or becomes a leader. Buckets that a sample of sets
   shows to be hot are divided, and the leaders of their parts meet again.
   All minhashes then leave out pairs 4 standard errors or more below the threshold.
4. The rest is checked exactly, on the shingle sets, which meet block by block.
5. The components of the links so far label the members of the large buckets; pairs of
   different components there are checked too, so no link between components is lost. Such a pair has a member
   outside its bucket's largest component: blocks of these meet blocks of all.
6. What all this left out (bands reach 0.99, signatures 4 standard errors) is found exactly, and so are the
   containments beyond the ratio: a set of q shingles misses at most q less the needed ones in a text that contains it.
   Shingles that no other set has rule out most sets; the others meet all sets that have one of as many of their rarest
   shingles as suffice. Links within the ratio join the components; those beyond it are counted (n_containers) or
   listed (`containments`), but join nothing, as through a passage unrelated texts would be one class.

Defined cases: texts of one to four words have one shingle, all of them; null texts and texts
without words are alone in their class; very long texts are hashed in parts, and their sets compared
whole; null doc_id is kept (a class's id is its least known doc_id); repeated rows are copies;
no rows, no rows; other columns pass through, and columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, decode, encode, packed, small, tidied, unpacked
from .graph import components
from .ngrams import mix64, runs

WIDTH, THRESHOLD, MAX_RATIO, SMALL = 5, 0.8, 2.0, 8
FUNCTIONS = 128
BLOCK = 1024  # documents that are checked against one another in one place
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MULTIPLY = (np.random.default_rng(4).integers(0, 2**63, FUNCTIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        both = []
        for x in (BASE, INVERSE):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


PART = 1 << 20  # bytes hashed at once
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def pieces(raw: bytes, limit: int = PART) -> Iterator[bytes]:
    """A text in pieces of about `limit` bytes, cut between words."""
    s = 0
    while len(raw) - s > limit:
        gap = BLANK.search(raw, s + limit)
        e = gap.start() if gap else len(raw)
        yield raw[s:e]
        s = e
    if s < len(raw) or not raw:
        yield raw[s:]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, and the number of words of each text."""
    out, counts = [np.zeros(0, dtype=np.uint64)], np.zeros(len(raws), dtype=np.int64)
    part: list[bytes] = []
    owner: list[int] = []
    held = 0

    def flush():
        buf = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        up, down = powers(len(buf))
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        space = SPACE[buf]
        edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        out.append(mix64((total[end] - total[start]) * down[start]))
        ends = np.cumsum([len(r) + 1 for r in part])
        np.add.at(counts, owner, np.diff(np.r_[0, np.searchsorted(start, ends)]))

    for i, raw in enumerate(raws):
        for x in pieces(raw):
            part.append(x)
            owner.append(i)
            held += len(x)
            if held > PART:
                flush()
                part, owner, held = [], [], 0
    if part:
        flush()
    return np.concatenate(out), counts


def shingle_sets(raws: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, counts = word_hashes([r.lower() for r in raws])
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        rolled = rolled * BASE + h[i : n + i]
    rolled = mix64(rolled)
    out, at = [], 0
    for c in counts:
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            x = np.full(1, c, dtype=np.uint64)
            for i in range(at, at + c):
                x = x * BASE + h[i : i + 1]
            out.append(mix64(x))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += c
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes (n, FUNCTIONS) of non-empty sets."""
    out = np.empty((len(sets), FUNCTIONS), dtype=np.uint64)
    group: list[int] = []
    held = 0

    def flush():
        x = np.concatenate([sets[i] for i in group])
        sizes = np.array([len(sets[i]) for i in group])
        start = np.cumsum(sizes) - sizes
        for j in range(FUNCTIONS):
            out[group, j] = np.minimum.reduceat(x * MULTIPLY[j], start)

    for i, s in enumerate(sets):
        group.append(i)
        held += len(s)
        if held > 1 << 15:
            flush()
            group, held = [], 0
    if group:
        flush()
    return out


def slices(b: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in parts of about `limit` bytes of text."""
    raws, s, held = b.column(column).to_pylist(), 0, 0
    for i, r in enumerate(raws):
        held += len(r or b"")
        if held > limit or i + 1 == len(raws):
            yield b.slice(s, i + 1 - s), [x or b"" for x in raws[s : i + 1]]
            s, held = i + 1, 0


SIGNED = "rid long, n int, k1 long, k2 long, sig binary"  # sig: the minhashes in planes of bytes, lowest first


def minhashes(sig: list[bytes]) -> np.ndarray:
    """Minhashes (n, FUNCTIONS) of whole signatures."""
    planes = np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(-1, 4, FUNCTIONS)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32)[:, :, 0]


def low_bytes(sig: list[bytes]) -> np.ndarray:
    """The lowest bytes (n, FUNCTIONS), which is what comparing sets needs: others than equal ones agree in 1 of 256."""
    return np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(-1, FUNCTIONS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b, raws in slices(big, "raw"):
            sets = shingle_sets(raws)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            sig: list[bytes | None] = [None] * len(raws)
            k1, k2 = np.zeros(len(raws), dtype=np.uint64), np.zeros(len(raws), dtype=np.uint64)
            if len(full):
                mins = signatures([sets[i] for i in full])
                # the low 32 bits: the high ones of a minimum are near zero
                low = (mins >> np.uint64(16)).astype(np.uint32)
                planes = low.view(np.uint8).reshape(-1, FUNCTIONS, 4).transpose(0, 2, 1)
                for i, row in zip(full, planes):
                    sig[i] = row.tobytes()
                x, start = np.concatenate([sets[i] for i in full]), np.cumsum(n[full]) - n[full]
                k1[full] = np.add.reduceat(mix64(x), start)
                k2[full] = np.add.reduceat(mix64(x * BASE + np.uint64(1)), start)
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(n, pa.int32()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sig, pa.binary())], names=["rid", "n", "k1", "k2", "sig"])


def least_jaccard(low: int, high: int, threshold: float, ratio: float) -> float:
    """Least Jaccard similarity of two linked sets with sizes in [low, high] and within the ratio."""
    sizes = range(low, high + 1) if high - low < 64 else [*range(low, low + 40), high]
    out = 1.0
    for q in sizes:
        u = max(q, min(high, int(q * ratio)))
        need = math.ceil(threshold * q - 1e-9)
        out = min(out, need / (q + u - need))
    return out


def tune(jaccard: float, recall: float = 0.99, functions: int = FUNCTIONS) -> tuple[int, int]:
    """(bands, rows): the most rows a band that reach the recall at that similarity."""
    for r in range(8, 0, -1):
        p = jaccard**r
        b = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if b * r <= functions and (r < 3 or b <= 24):
            return b, r
    return functions, 1


def partitions(n: int, ratio: float) -> list[tuple[int, int]]:
    """The partition of a set size on either grid: (grid, bin)."""
    x = math.log(n) / math.log(ratio * ratio)
    return [(0, math.floor(x + 1e-9)), (1, math.floor(x + 0.5 + 1e-9))]


def bounds(grid: int, number: int, ratio: float) -> tuple[int, int]:
    f = ratio * ratio
    low = f ** (number - grid / 2)
    return max(1, math.ceil(low - 1e-9)), max(1, math.ceil(low * f - 1e-9) - 1)


BUCKETS = "bucket long, rid long, n int, bits long"


def _band(threshold: float, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[tuple[int, int], tuple[int, int]] = {}
        for big in batches:
            for s in range(0, big.num_rows, 2048):
                b = big.slice(s, 2048)
                n = b.column("n").to_numpy(zero_copy_only=False)
                rid = b.column("rid").to_numpy(zero_copy_only=False)
                sig = minhashes(b.column("sig").to_pylist())
                bits = np.packbits((sig[:, :64] & 1).astype(np.uint8), axis=1).view(np.int64)[:, 0]
                groups: dict[tuple[int, int], list[int]] = {}
                for i, size in enumerate(n):
                    for p in partitions(int(size), ratio):
                        groups.setdefault(p, []).append(i)
                for p, who in groups.items():
                    if p not in plans:
                        plans[p] = tune(least_jaccard(*bounds(*p, ratio), threshold, ratio))
                    bands, r = plans[p]
                    at = np.array(who)
                    keys = np.empty((len(at), bands), dtype=np.uint64)
                    for j in range(bands):
                        x = np.full(len(at), (p[0] << 40) + ((p[1] + 8) << 20) + j, dtype=np.uint64) * BASE
                        for k in range(r):
                            x = mix64(x ^ sig[at, j * r + k].astype(np.uint64)) + BASE
                        keys[:, j] = x
                    pick = np.repeat(at, bands)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rid[pick]), pa.array(n[pick], pa.int32()), pa.array(bits[pick])], names=["bucket", "rid", "n", "bits"])

    return run


def may_link(n1, x1, n2, x2, threshold: float, ratio: float) -> np.ndarray:
    """Whether sizes and one-bit minhashes leave a link possible (4 standard errors)."""
    small, large = np.minimum(n1, n2).astype(float), np.maximum(n1, n2).astype(float)
    need = np.ceil(threshold * small - 1e-9)
    p = (1 + need / (small + large - need)) / 2
    agree = 1 - np.bitwise_count(np.bitwise_xor(x1, x2).view(np.uint64)) / 64
    return (large <= ratio * small) & (agree >= p - 4 * np.sqrt(p * (1 - p) / 64) - 1e-9)


def signature_allows(n1, s1, n2, s2, threshold: float) -> np.ndarray:
    """Whether the minhashes leave a link possible (4 standard errors)."""
    small, large = np.minimum(n1, n2).astype(float), np.maximum(n1, n2).astype(float)
    need = np.ceil(threshold * small - 1e-9)
    p = need / (small + large - need)
    return (s1 == s2).mean(axis=-1) >= p - 4 * np.sqrt(p * (1 - p) / FUNCTIONS) - 1e-9


def _likely(threshold: float):
    """Pairs (a, b) of rows with both signatures that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 2048):
                b = big.slice(s, 2048)
                n1, n2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n1", "n2"))
                s1, s2 = (low_bytes(b.column(c).to_pylist()) for c in ("s1", "s2"))
                ok = pa.array(signature_allows(n1, s1, n2, s2, threshold))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return run


def likely_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    one = sets.select(F.col("rid").alias("a"), F.col("n").alias("n1"), F.col("low").alias("s1"))
    two = sets.select(F.col("rid").alias("b"), F.col("n").alias("n2"), F.col("low").alias("s2"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "s1", "s2").mapInArrow(tidied(_likely(threshold)), "a long, b long")


PAIRS = "a long, b long, bucket long, n int, bits long, comp long"


def _rows(a=(), b=(), bucket=None, n=None, bits=None, comp=None) -> pa.RecordBatch:
    k = len(a)
    null = lambda x, t: pa.nulls(k, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), null(b, pa.int64()), null(bucket, pa.int64()), null(n, pa.int32()), null(bits, pa.int64()), null(comp, pa.int64())],
        names=["a", "b", "bucket", "n", "bits", "comp"],
    )


def by_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of a sorted partition, cut only where the first column changes."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        cut = int(np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[-1])
        if cut == 0 and held and held[-1][0][-1] == cols[0][0]:
            held.append(cols)
            continue
        held.append([c[:cut] for c in cols])
        whole = [np.concatenate(x) for x in zip(*held)]
        if len(whole[0]):
            yield whole
        held = [[c[cut:] for c in cols]]
    if held:
        whole = [np.concatenate(x) for x in zip(*held)]
        if len(whole[0]):
            yield whole


def _pair(threshold: float, ratio: float):
    """Candidate pairs within meets (buckets or their parts); members of large or divided buckets come out as rows of their own (b null; comp 1: leaders)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for meet, bucket, rid, n, bits, parts in by_runs(batches, ["meet", "bucket", "rid", "n", "bits", "parts"]):
            start = runs(meet)
            size = np.diff(np.r_[start, len(meet)])
            few = (size <= SMALL) & (parts[start] == 1)
            small = np.repeat(few, size)
            for d in range(1, SMALL):
                i = np.flatnonzero((meet[:-d] == meet[d:]) & small[:-d]) if d < len(meet) else np.zeros(0, dtype=int)
                i = i[may_link(n[i], bits[i], n[i + d], bits[i + d], threshold, ratio)]
                if len(i):
                    yield _rows(np.minimum(rid[i], rid[i + d]), np.maximum(rid[i], rid[i + d]))
            for s, k in zip(start[~few], size[~few]):
                part = slice(s, s + k)
                r, m, x = rid[part], n[part], bits[part]
                left, leads = np.arange(k), np.zeros(k, dtype=np.int64)
                while len(left):
                    lead, others = left[0], left[1:]
                    leads[lead] = 1
                    ok = may_link(m[lead], x[lead : lead + 1], m[others], x[others], threshold, ratio)
                    hit = others[ok]
                    if len(hit):
                        yield _rows(np.minimum(r[lead], r[hit]), np.maximum(r[lead], r[hit]))
                    left = others[~ok]
                yield _rows(r, None, bucket[part], m, x, leads)

    return run


def _cross(threshold: float, ratio: float):
    """Possible pairs of different components where blocks of large buckets meet: side 1 are those outside the largest component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for meet, side, bucket, rid, n, bits, comp, low in by_runs(batches, ["meet", "side", "bucket", "a", "n", "bits", "comp", "low"]):
            start = runs(meet)
            for s, e in zip(start, np.r_[start[1:], len(meet)]):
                rows = low_bytes(low[s:e])
                every = s + np.flatnonzero(side[s:e] == 0)
                for i in s + np.flatnonzero(side[s:e] == 1):
                    j = every[comp[every] != comp[i]]
                    j = j[may_link(n[i], bits[i : i + 1], n[j], bits[j], threshold, ratio)]
                    j = j[signature_allows(n[i], rows[i - s], n[j], rows[j - s], threshold)]
                    if len(j):
                        yield _rows(np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j]), np.full(len(j), bucket[s]))

    return run


def cross_pairs(large: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float, ratio: float, block: int = BLOCK) -> DataFrame:
    """(a, b, bucket): possible pairs of different components of large buckets' members (a, bucket, n, bits)."""
    labels = roots.select(F.col("node").alias("a"), F.col("root"))
    member = large.join(labels, "a", "left").select("bucket", "a", "n", "bits", F.coalesce("root", "a").alias("comp"))
    count = member.groupBy("bucket", "comp").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("k"), F.max("k").alias("most"), F.max_by("comp", "k").alias("major"))
    mixed = count.filter("most < k").select("bucket", "major", F.ceil(F.col("k") / block).alias("nx"), F.ceil((F.col("k") - F.col("most")) / block).alias("ny"))
    placed = member.join(mixed, "bucket").join(sets.select(F.col("rid").alias("a"), "low"), "a")
    spot = lambda c: F.pmod(F.xxhash64("a"), F.col(c))
    all_of = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    place = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    every = F.transform(all_of("ny"), lambda y: place(0, spot("nx"), y))
    minor = F.transform(all_of("nx"), lambda x: place(1, x, spot("ny")))
    spots = F.when(F.col("comp") == F.col("major"), every).otherwise(F.concat(every, minor))
    met = placed.withColumn("at", F.explode(spots)).select(F.xxhash64("bucket", "at.x", "at.y").alias("meet"), "at.side", "bucket", "a", "n", "bits", "comp", "low")
    ordered = met.repartition("meet").sortWithinPartitions("meet", "bucket", "side", "a")
    return ordered.mapInArrow(tidied(_cross(threshold, ratio)), PAIRS).select("a", "b", "bucket")


WORDS = 1 << 20  # of 64 ids each, that are broadcast


def chosen(rows: DataFrame, ids: DataFrame, scratch: Scratch, name: str, words: int = WORDS) -> DataFrame:
    """The rows (rid, ...) whose rid is among ids (rid). The ids reach all tasks as one bit a row, so that the rows, which hold
    texts, stay where they are; only more than `words` words of bits (64 million rows) are joined by an exchange."""
    bits = ids.groupBy(F.shiftright("rid", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(rid & 63 as int)))").alias("bits"))
    bits = scratch.keep(bits, f"bits-{name}")
    if bits.count() > words:
        return rows.join(ids.distinct().hint("merge"), "rid", "left_semi")
    held = rows.join(F.broadcast(bits), F.shiftright(rows["rid"], 6) == bits["word"])
    return held.filter("shiftright(bits, cast(rid & 63 as int)) & 1 = 1").select(*(rows[c] for c in rows.columns))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b, raws in slices(big, "raw"):
            sets = [s.tobytes() for s in shingle_sets(raws)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("bucket", "x", "y", "a")), pa.array(sets, pa.binary())], names=["bucket", "x", "y", "a", "sh"])


def _verify(threshold: float):
    """Of a block's sets (b null), then its pairs: the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for big in batches:
            for s in range(0, big.num_rows, 1024):
                c = big.slice(s, 1024)
                out: list[tuple[int, int, float]] = []
                for bucket, x, y, a, b, sh in zip(*(c.column(k).to_pylist() for k in ("bucket", "x", "y", "a", "b", "sh"))):
                    if block != (bucket, x, y):
                        block, sets = (bucket, x, y), {}
                    if b is None:
                        sets[a] = np.frombuffer(sh, dtype=np.uint64)
                        continue
                    one, two = sets[a], sets[b]
                    at = np.minimum(np.searchsorted(one, two), len(one) - 1)
                    both, least = int((one[at] == two).sum()), min(len(one), len(two))
                    if both >= math.ceil(threshold * least - 1e-9):
                        out.append((a, b, both / least))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "containment"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b, bucket) of texts (rid, raw) whose containment reaches the threshold, as the table `name`.

    Texts without a pair stay where they are.
    A bucket's documents are cut into blocks of about `block`; a pair is checked where its
    two blocks meet, and a document's set goes once to each meeting that it has pairs in.
    """
    ends = pairs.select("bucket", "a").union(pairs.select("bucket", F.col("b").alias("a"))).distinct()
    blocks = ends.groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("nb"))
    spot = lambda c: F.pmod(F.xxhash64(c), F.col("nb")).cast("int")
    # written, as it is read several times: else each reading is planned, joined and broadcast anew by the driver
    spread = scratch.keep(pairs.join(blocks, "bucket").select("bucket", spot("a").alias("x"), spot("b").alias("y"), "a", "b"), f"spread-{name}")
    ends = spread.select("a").union(spread.select(F.col("b").alias("a")))
    routes = spread.select("bucket", "x", "y", "a").union(spread.select("bucket", "x", "y", F.col("b").alias("a"))).distinct()
    # the same plan at every size: texts are sorted to the routes, which may be many
    texts = chosen(texts, ends.select(F.col("a").alias("rid")), scratch, name)
    sent = texts.withColumnRenamed("rid", "a").join(routes.hint("merge"), "a").select("bucket", "x", "y", "a", "raw")
    sets = sent.mapInArrow(tidied(_expand), "bucket long, x int, y int, a long, sh binary")
    rows = sets.unionByName(spread, allowMissingColumns=True)
    ordered = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", F.col("b").isNotNull())
    found = scratch.keep(ordered.mapInArrow(tidied(_verify(threshold)), "a long, b long, containment double"), name)
    scratch.drop(f"bits-{name}", f"spread-{name}")
    return found


FAMILY = 256  # texts that are sent to one place once, instead of pair by pair


def gathered(pairs: DataFrame, scratch: Scratch, name: str, family: int = FAMILY) -> DataFrame:
    """(a, b, bucket): the pairs of a family, a component of pairs of at most `family` texts, in one bucket; others by b."""
    label = scratch.keep(components(pairs, scratch, f"families-{name}"), f"families-{name}")
    few = label.groupBy("root").agg(F.count("*").alias("k")).filter(F.col("k") <= family)
    own = label.join(few, "root").select(F.col("node").alias("a"), "root")
    return pairs.join(own, "a", "left").select("a", "b", F.coalesce("root", "b").alias("bucket"))


# --- what the ensemble leaves out

BLOCKS = "kind int, bucket int, code long, data binary, rid long, n int"  # code: a slab's first, or the set's
SETS, POSTS, HELD, RARE = range(4)
MEMBERS = "h long, code long, rare boolean"
POST_BYTES = 16 << 20  # of text posted at once, and about that of a bucket


def _blocks(kind: int, bucket, code, data: list[bytes]) -> pa.RecordBatch:
    k = len(data)
    one = lambda v, t: pa.array(np.broadcast_to(np.asarray(v, dtype=t), k))
    return pa.RecordBatch.from_arrays([one(kind, np.int32), one(bucket, np.int32), one(code, np.int64), pa.array(data, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())], names=["kind", "bucket", "code", "data", "rid", "n"])


def halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 40 bits of a shingle that its bucket doesn't tell."""
    return h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint8)


def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def steps(doc: np.ndarray) -> np.ndarray:
    return np.diff(doc.astype(np.uint32), prepend=np.uint32(0))


def _post(buckets: int):
    """Per slab and bucket one row of 40 bits of each shingle and its set's number in the slab; one row (SETS) a set."""

    def posted(first: int, rids: list[int], raws: list[bytes]) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(raws)
        size = np.array([len(s) for s in sets])
        h = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint32), size)
        to = (((h & np.uint64(0xFFFFFF)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        cut = runs(to[order])
        h >>= np.uint64(24)
        yield _blocks(POSTS, to[order][cut], first, [encode(*halves(h[o]), steps(doc[o])) for o in np.split(order, cut[1:])])
        n = len(rids)
        codes = first + np.arange(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, SETS, dtype=np.int32)), pa.array((codes % buckets).astype(np.int32)), pa.array(codes), pa.nulls(n, pa.binary()), pa.array(rids, pa.int64()), pa.array(size.astype(np.int32))], names=["kind", "bucket", "code", "data", "rid", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a slab's first set has a number divisible by 2^24: a slab has fewer sets, as each has a byte or more
        first, rids, raws, held = TaskContext.get().partitionId() << 44, [], [], 0
        for big in batches:
            for rid, raw in zip(big.column("rid").to_pylist(), big.column("raw").to_pylist()):
                rids.append(rid)
                raws.append(raw)
                held += len(raw) + 1
                if held > POST_BYTES:
                    yield from posted(first, rids, raws)
                    first, rids, raws, held = first + (1 << 24), [], [], 0
        if rids:
            yield from posted(first, rids, raws)

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """The rows (kind, code, data) of each bucket, which come together."""
    at, held = None, []
    for b in batches:
        for kind, bucket, code, data in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "code", "data"))):
            if bucket != at and held:
                yield at, held
                held = []
            at = bucket
            held.append((kind, code, data))
    if held:
        yield at, held


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole buckets the shingles of two sets or more: with their sets (HELD), and to each slab with the number of sets (POSTS). SETS rows pass."""

    def posts() -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.filter(pc.equal(b.column("kind"), SETS))
            if own.num_rows:
                passed.append(own)
            yield b.filter(pc.equal(b.column("kind"), POSTS))

    passed: list[pa.RecordBatch] = []
    for bucket, rows in by_bucket(posts()):
        parts = [decode(data) for _, _, data in rows]
        h = np.concatenate([whole(low, high) for low, high, _ in parts])
        doc = [np.cumsum(d, dtype=np.uint32) for _, _, d in parts]
        del parts
        order = np.argsort(h, kind="stable")
        start = runs(h[order])
        size = np.diff(np.r_[start, len(h)])
        df = np.empty(len(h), dtype=np.uint32)
        df[order] = np.repeat(size, size)
        kept = order[np.repeat(size > 1, size)]
        code = np.concatenate([first + d.astype(np.int64) for (_, first, _), d in zip(rows, doc)])
        yield _blocks(HELD, bucket, 0, [encode(*halves(h[kept]), code[kept].view(np.uint64))])
        data, s = [], 0
        for d in doc:
            many = np.flatnonzero(df[s : s + len(d)] > 1)
            data.append(encode(*halves(h[s + many]), steps(d[many]), df[s + many]))
            s += len(d)
        yield _blocks(POSTS, bucket, [first for _, first, _ in rows], data)
        yield from passed
        passed.clear()
    yield from passed


def _mark(threshold: float):
    """Per slab (its SETS rows first): the shared shingles of which any text that contains the set has one."""

    def marked(first: int, seq: np.ndarray, n: np.ndarray, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        q = np.zeros(int(seq.max()) + 1, dtype=np.int64)
        q[seq] = n
        parts = [decode(data) for _, data in rows]
        h = np.concatenate([whole(low, high) for low, high, _, _ in parts])
        doc = np.concatenate([np.cumsum(d, dtype=np.uint32) for _, _, d, _ in parts])
        bucket = np.repeat(np.array([b for b, _ in rows], dtype=np.int32), [len(p[0]) for p in parts])
        # of q shingles at most q - need may be missing; those of no other set are, and so one of the next spare + 1 is not
        spare = q - np.ceil(threshold * q - 1e-9).astype(np.int64) - (q - np.bincount(doc, minlength=len(q)))
        live = np.flatnonzero(spare[doc] >= 0)
        df = np.concatenate([p[3] for p in parts])[live]
        del parts
        live = live[np.lexsort((df, doc[live]))]
        start = runs(doc[live])
        size = np.diff(np.r_[start, len(live)])
        place = np.arange(len(live)) - np.repeat(start, size)
        rare = np.sort(live[place <= spare[doc[live]]])
        if len(rare):
            cut = runs(bucket[rare])
            yield _blocks(RARE, bucket[rare][cut], first, [encode(*halves(h[o]), steps(doc[o])) for o in np.split(rare, cut[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, n, rows = None, [], [], []
        for b in batches:
            for kind, bucket, code, data, size in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "code", "data", "n"))):
                if code >> 24 != at:
                    if at is not None:
                        yield from marked(at << 24, np.array(seq), np.array(n), rows)
                    at, seq, n, rows = code >> 24, [], [], []
                if kind == SETS:
                    seq.append(code - (at << 24))
                    n.append(size)
                else:
                    rows.append((bucket, data))
        if at is not None:
            yield from marked(at << 24, np.array(seq), np.array(n), rows)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole buckets (HELD and RARE rows): all sets that have a shingle which is rare for one of them."""
    for bucket, rows in by_bucket(batches):
        held = [decode(data) for kind, _, data in rows if kind == HELD]
        rare = [(first, decode(data)) for kind, first, data in rows if kind == RARE]
        if not rare:
            continue
        h, code = whole(*held[0][:2]), held[0][2]
        own = np.concatenate([whole(low, high) for _, (low, high, _) in rare])
        who = np.concatenate([first + np.cumsum(d, dtype=np.int64) for first, (_, _, d) in rare]).view(np.uint64)
        met = np.flatnonzero(np.isin(h, own))
        h, code = h[met], code[met]
        mark = np.isin(mix64(h * BASE + code), mix64(own * BASE + who))
        for s in range(0, len(h), 1 << 16):
            e = s + 65536
            yield pa.RecordBatch.from_arrays([pa.array(h[s:e].astype(np.int64) + (bucket << 40)), pa.array(code[s:e].view(np.int64)), pa.array(mark[s:e])], names=["h", "code", "rare"])


def _meet(ratio: float):
    """Pairs (a the smaller set, b) at a shingle that a's container must have: of different components, or beyond the ratio."""

    def wanted(n1, c1, n2, c2):
        return (n1 <= n2) & ((c1 != c2) | (n2 > ratio * n1))

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, rid, n, comp, rare in by_runs(batches, ["h", "rid", "n", "comp", "rare"]):
            rare = rare.astype(bool)
            start = runs(h)
            size = np.diff(np.r_[start, len(h)])
            least, most = np.minimum.reduceat(n, start), np.maximum.reduceat(n, start)
            use = np.logical_or.reduceat(rare, start) & ((np.minimum.reduceat(comp, start) < np.maximum.reduceat(comp, start)) | (most > ratio * least))
            few = np.repeat(use & (size <= 32), size)
            for d in range(1, 32):
                i = np.flatnonzero((h[:-d] == h[d:]) & few[:-d]) if d < len(h) else np.zeros(0, dtype=int)
                if not len(i):
                    break
                for x, y in ((i, i + d), (i + d, i)):
                    ok = rare[x] & wanted(n[x], comp[x], n[y], comp[y])
                    if ok.any():
                        yield out(rid[x[ok]], rid[y[ok]])
            for s, k in zip(start[use & (size > 32)], size[use & (size > 32)]):
                r, m, c = rid[s : s + k], n[s : s + k], comp[s : s + k]
                for i in np.flatnonzero(rare[s : s + k]):
                    j = np.flatnonzero(wanted(m[i], c[i], m, c))
                    if len(j):
                        yield out(np.full(len(j), r[i]), r[j])

    return run


def left_out(texts: DataFrame, sets: DataFrame, roots: DataFrame, scratch: Scratch, threshold: float, ratio: float) -> DataFrame:
    """(a, b, containment): all links between components, and all beyond the ratio (a in b), exactly.

    A set of q shingles that lies to the threshold in another misses at most `spare` of its own; so the other has
    one of any spare + 1 of them. Shingles of one set only are missing anywhere: most sets are ruled out by their number.
    Of the rest, sets meet at the rarest shingles that suffice.
    """
    own = sets.select("rid")
    total = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = max(1, math.ceil(total / POST_BYTES))
    posted = chosen(texts.select("rid", "raw"), own, scratch, "blocks").mapInArrow(tidied(_post(buckets)), BLOCKS)
    blocks = scratch.keep(posted.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(tidied(_share), BLOCKS), "blocks")
    slab = F.shiftright("code", 24)
    rare = blocks.filter(F.col("kind") != HELD).repartition(slab).sortWithinPartitions(slab, "kind").mapInArrow(tidied(_mark(threshold)), BLOCKS)
    both = blocks.filter(F.col("kind") == HELD).unionByName(rare)
    members = scratch.keep(both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(tidied(_members), MEMBERS), "members_")
    label = roots.select(F.col("node").alias("rid"), F.col("root"))
    one = scratch.keep(blocks.filter(F.col("kind") == SETS).select("code", "rid", "n").join(label, "rid", "left").select("code", "rid", "n", F.coalesce("root", "rid").alias("comp")), "codes")
    scratch.drop("blocks", "bits-blocks")
    met = members.join(one, "code").select("h", "rid", "n", "comp", "rare").repartition("h").sortWithinPartitions("h").mapInArrow(tidied(_meet(ratio)), "a long, b long")
    size = sets.select(F.col("rid"), F.col("n"))
    pairs = scratch.keep(met.distinct(), "left")
    scratch.drop("members_", "codes")
    # beyond families the smaller sets go to the larger one
    placed = scratch.keep(gathered(pairs, scratch, "contained"), "placed")
    scratch.drop("families-contained")
    found = verify(placed, texts, scratch, "contained", threshold)
    scratch.drop("placed")
    found = found.join(size.select(F.col("rid").alias("a"), F.col("n").alias("n1")), "a").join(size.select(F.col("rid").alias("b"), F.col("n").alias("n2")), "b")
    return scratch.keep(found.select("a", "b", "containment", (F.col("n2") > ratio * F.col("n1")).alias("beyond")), "rest")


#: What link_sets leaves in its scratch folder.
TABLES = ("signed", "sets", "low", "found", "pairs", "links", "more", "links2", "roots", "roots2", "left", "contained", "rest", "roots3", "reps", "slim")


PART_ROWS, SAMPLE = 1 << 16, 8192


def hot_buckets(sets: DataFrame, threshold: float, ratio: float, rows_a_part: int = PART_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(bucket, parts) of the buckets that a sample of sets shows to be larger than a part: it sets the balance only."""
    number = sets.count()
    some = sets.select("rid").orderBy(F.xxhash64("rid"), "rid").limit(sample)
    some = sets.join(F.broadcast(some), "rid").select("rid", "n", "sig")  # at most `sample` ids
    count = some.mapInArrow(tidied(_band(threshold, ratio)), BUCKETS).groupBy("bucket").count()
    scale = max(1.0, number / sample)
    found = count.withColumn("parts", F.ceil(F.col("count") * scale / rows_a_part).cast("int")).filter((F.col("parts") > 1) & (F.col("count") > 8))
    rows = [(r["bucket"], r["parts"]) for r in found.select("bucket", "parts").collect()]  # at most bands * sample / 8
    return small(sets.sparkSession, rows, "bucket long, parts int")


def link_sets(texts: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, ratio: float = MAX_RATIO) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For texts (rid, raw): (rid, n, rep) with one rep for equal sets, (node, root) of linked reps, and (a, b, containment) of reps a that lie in larger ones beyond the ratio."""
    signed = scratch.keep(texts.mapInArrow(tidied(_sign), SIGNED), "signed")
    sets = scratch.keep(signed.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("rid").alias("rid"), F.max("sig").alias("sig")), "sets")
    named = signed.select("rid", "n", "k1", "k2").join(sets.select("k1", "k2", "n", F.col("rid").alias("rep")), ["k1", "k2", "n"], "left")
    reps = scratch.keep(named.select("rid", "n", F.coalesce("rep", "rid").alias("rep")), "reps")
    scratch.drop("signed")
    hot = hot_buckets(sets, threshold, ratio, PART_ROWS)
    rows = sets.select("rid", "n", "sig").mapInArrow(tidied(_band(threshold, ratio)), BUCKETS).join(hot, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("parts") > 1, F.xxhash64("bucket", F.pmod(F.xxhash64("rid"), F.col("parts")))).otherwise(F.col("bucket"))

    def paired(x: DataFrame) -> DataFrame:
        return x.repartition("meet").sortWithinPartitions("meet", "rid").mapInArrow(tidied(_pair(threshold, ratio)), PAIRS)

    found = scratch.keep(paired(rows.withColumn("meet", part)), "found")
    # whole signatures have done their work in the bands
    low = scratch.keep(sets.select("rid", "n", F.substring("sig", 1, FUNCTIONS).alias("low")), "low")
    scratch.drop("sets")
    again = found.filter("b is null and comp = 1").join(hot, "bucket", "left_semi").select("bucket", F.col("a").alias("rid"), "n", "bits", F.lit(2).alias("parts"), F.col("bucket").alias("meet"))
    both = found.filter(F.col("b").isNotNull()).select("a", "b").unionByName(paired(again).filter(F.col("b").isNotNull()).select("a", "b"))
    pairs = scratch.keep(likely_pairs(both.distinct(), low, threshold), "pairs")
    links = verify(pairs.withColumn("bucket", F.col("a")), texts, scratch, "links", threshold)
    roots = scratch.keep(components(links, scratch), "roots")
    large = found.filter(F.col("b").isNull()).select("a", "bucket", "n", "bits")
    if not large.isEmpty():
        more = cross_pairs(large, roots, low, threshold, ratio)
        more = scratch.keep(more.groupBy("a", "b").agg(F.min("bucket").alias("bucket")).join(pairs, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            extra = verify(more, texts, scratch, "links2", threshold)
            links = links.unionByName(extra)
            roots = scratch.keep(components(links, scratch, "components2"), "roots2")
    # signatures have done their work: only sizes and representatives stay on disk
    slim = scratch.keep(low.select("rid", "n"), "slim")
    scratch.drop("found", "pairs", "more", "low")
    rest = left_out(texts, slim, roots, scratch, threshold, ratio)
    extra = rest.filter("not beyond").select("a", "b", "containment")
    if not extra.isEmpty():
        roots = scratch.keep(components(links.unionByName(extra), scratch, "components3"), "roots3")
    return reps, roots, rest.filter("beyond").select("a", "b", "containment")


def containments(df: DataFrame, threshold: float = THRESHOLD, ratio: float = MAX_RATIO, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, container_id, containment): every text that lies to the threshold in one of more than `ratio` times its size.

    Texts with equal sets stand as one, by their least doc_id (`near_duplicates` puts them in one class).
    """
    scratch = scratch or Scratch(df.sparkSession)
    docs = scratch.keep(df.select("doc_id", F.col("text").cast("binary").alias("raw")).withColumn("rid", F.monotonically_increasing_id()), "documents")
    reps, _, beyond = link_sets(docs.select("rid", "raw"), scratch, threshold, ratio)
    first = scratch.keep(docs.select("rid", "doc_id").join(reps, "rid").groupBy("rep").agg(F.min("doc_id").alias("id")), "first")
    out = beyond.join(first.select(F.col("rep").alias("a"), F.col("id").alias("doc_id")), "a").join(first.select(F.col("rep").alias("b"), F.col("id").alias("container_id")), "b")
    return out.select("doc_id", "container_id", "containment")


ADDED = ("n_shingles", "class_id", "class_size", "keep", "n_containers")


def _labelled(df: DataFrame, other: list[str], threshold: float, ratio: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of df (rid, doc_id, text, row of the other columns), and their labels (rid, doc_id, ADDED)."""
    docs = scratch.keep(df.select("doc_id", "text", packed(other).alias("row")).withColumn("rid", F.monotonically_increasing_id()), "documents")
    texts = docs.select("rid", F.col("text").cast("binary").alias("raw"))
    reps, roots, beyond = link_sets(texts, scratch, threshold, ratio)
    larger = beyond.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("larger"))
    named = docs.select("rid", "doc_id").join(reps, "rid").join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(larger, "rep", "left")
    member = scratch.keep(named.select("rid", "doc_id", "n", F.coalesce("root", "rep").alias("class"), F.coalesce("larger", F.lit(0).cast("long")).alias("n_containers")), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid"))
    classes = member.groupBy("class").agg(first.alias("f"), F.count("*").alias("class_size"))
    labels = member.join(classes, "class").select("rid", F.col("n").alias("n_shingles"), F.col("f.doc_id").alias("class_id"), "class_size", (F.col("f.rid") == F.col("rid")).alias("keep"), "n_containers", "doc_id")
    labels = scratch.keep(labels, "labels")
    scratch.drop("members", *(t for t in TABLES))
    return docs, labels


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, ratio: float = MAX_RATIO, columns: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Rows of df (their `columns`, all by default) with n_shingles, class_id, class_size, keep and n_containers.

    One row of each class has keep: that with the least doc_id, null ones last. n_containers: the number of different
    larger texts, beyond the ratio, in which the text lies to the threshold (`containments` gives the pairs).
    """
    scratch = scratch or Scratch(df.sparkSession)
    columns = [c for c in (df.columns if columns is None else columns) if c not in ADDED]
    other = [c for c in columns if c not in ("doc_id", "text")]
    docs, labels = _labelled(df, other, threshold, ratio, scratch)
    if columns == ["doc_id"]:
        scratch.drop("documents")
        return labels.select("doc_id", *ADDED)
    carried = {c: x for c, x in zip(other, unpacked(other))}
    out = docs.join(labels.drop("doc_id"), "rid")
    return out.select(*(carried.get(c, F.col(c)) for c in columns), *ADDED)


def distinct_texts(df: DataFrame, threshold: float = THRESHOLD, ratio: float = MAX_RATIO, scratch: Scratch | None = None) -> DataFrame:
    """The rows of df that `near_duplicates` keeps, with all their columns and no others. Their texts aren't exchanged."""
    scratch = scratch or Scratch(df.sparkSession)
    other = [c for c in df.columns if c not in ("doc_id", "text")]
    docs, labels = _labelled(df, other, threshold, ratio, scratch)
    carried = {c: x for c, x in zip(other, unpacked(other))}
    return chosen(docs, labels.filter("keep").select("rid"), scratch, "kept").select(*(carried.get(c, F.col(c)) for c in df.columns))
