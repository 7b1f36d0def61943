"""Operator 5, suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

Documents are ordered by doc_id (repeated ids: by an arbitrary but fixed row number);
a string starts earlier in a smaller document or at a smaller offset of the same one.
Everything is judged on the input as it is.

1. Anchors. In every window of 100 bytes the 32-byte strings of least hash are its
   anchors, so that equal windows hold the same anchor at the same place. An anchor goes with
   the hash of its context: the bytes of all windows that can hold it.
2. Anchors meet by hash. Of equal contexts all but the first are covered whole; contexts count as equal
   if the 64-bit hashes of the anchor and of the context both agree. Where an
   anchor has several contexts, one of each is needed in full. Equal contexts are dropped before
   the shuffle already, within a task's slice. Anchors that a sample finds in many documents (licence lines
   and the like) rank last, so that windows prefer others; that changes the work's
   spread, never the result.
3. The needed contexts, cut out of the texts, meet by anchor and are laid out in document
   order. An anchor with very many contexts is divided first: a window around it holds the 34 bytes
   before it or the 34 after it, so contexts meet once by either.
4. Prefix doubling (8, 16, 32, 64, then 64 + 36 bytes) gives the suffix order to a depth of 100, ties by
   position. The longest previous factor of a suffix is the longer of its matches with the previous
   and the next smaller position in suffix order. Its 100 bytes are covered where that reaches 100.
5. The covered ranges of a document are merged and taken out.

Defined cases: null text is an empty text; null doc_id comes last; rows with the same
doc_id are documents of their own; texts under 100 bytes lose nothing; very long texts
are hashed and solved in parts, and only cut whole; no rows, no rows; other
columns pass through, and columns that clash with added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, packed, tidied, unpacked
from .minhash import powers, slices
from .ngrams import mix64, runs

LENGTH, KMER = 100, 32
SPAN = LENGTH - KMER + 1  # anchors to choose from in a window
TOP = np.uint64(1 << 63)
LAST = 2**63 - 1


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over a[i : i + w], for every i with a whole window."""
    n = len(a)
    size = -(-n // w) * w
    x = np.full(size, a[-1], dtype=a.dtype)
    x[:n] = a
    x = x.reshape(-1, w)
    head = op.accumulate(x, axis=1).ravel()
    tail = op.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def anchors(raws: list[bytes], hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, offset, anchor hash, context hash, bytes before, bytes after) of all anchors."""
    lengths = np.array([len(r) for r in raws])
    buf = np.frombuffer(b"".join(raws), dtype=np.uint8)
    n = len(buf)
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    if n < LENGTH:
        return none
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix64((total[KMER:] - total[:-KMER]) * down[: n - KMER + 1])
    rank = (h >> np.uint64(1)) + np.uint64(1)
    if len(hot):
        near = np.zeros(1 << 16, dtype=bool)
        near[(hot >> np.uint64(48)).astype(np.int64)] = True
        some = np.flatnonzero(near[(h >> np.uint64(48)).astype(np.int64)])
        rank[some[np.isin(h[some], hot)]] |= TOP
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(raws)), lengths)
    least = sliding(rank, SPAN, np.minimum)  # one for each window of LENGTH bytes
    inside = text[: n - LENGTH + 1] == text[LENGTH - 1 :]
    least[~inside] = 0
    padded = np.zeros(len(least) + 2 * (SPAN - 1), dtype=np.uint64)
    padded[SPAN - 1 : SPAN - 1 + len(least)] = least
    at = np.flatnonzero(sliding(padded, SPAN, np.maximum) == rank)
    doc = text[at]
    begin, end = (ends - lengths)[doc], ends[doc]
    low, high = np.maximum(begin, at - (SPAN - 1)), np.minimum(end, at + LENGTH)
    context = mix64(mix64((total[high] - total[low]) * down[low]) + (at - low).astype(np.uint64) * np.uint64(1009) + (high - at).astype(np.uint64))
    return doc, at - begin, h[at], context, at - low, high - at


def pack(pos, before, after):
    return (pos << 14) | (before << 7) | after


def unpack(x):
    return x >> 14, (x >> 7) & 127, x & 127


def joined_ranges(rid: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a row made one."""
    if not len(rid):
        return rid, s, e
    order = np.lexsort((s, rid))
    rid, s, e = rid[order], s[order], e[order]
    group = np.cumsum(np.r_[0, rid[1:] != rid[:-1]])
    far = group.astype(np.int64) * (int(e.max()) + 2)
    reach = np.maximum.accumulate(e + far)
    new = np.flatnonzero(np.r_[True, (s + far)[1:] > reach[:-1]])
    return rid[new], s[new], np.maximum.reduceat(e, new)


MARKS = "kind int, ah long, ch long, doc long, rid long, x long, s long, e long"


def _marks(kind: int, ah=None, ch=None, doc=None, rid=None, x=None, s=None, e=None) -> pa.RecordBatch:
    n = len(rid)
    cols = [np.full(n, kind, dtype=np.int32), *(np.zeros(n, dtype=np.int64) if v is None else np.ascontiguousarray(v).view(np.int64) for v in (ah, ch, doc, rid, x, s, e))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[m.split()[0] for m in MARKS.split(", ")])


def _anchor(hot: np.ndarray):
    """Kind 0: anchors; kind 1: ranges covered by an equal context in the same slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b, raws in slices(big, "raw", 1 << 19):
                text, pos, ah, ch, before, after = anchors(raws, hot)
                if not len(text):
                    continue
                doc = b.column("doc").to_numpy(zero_copy_only=False)[text]
                rid = b.column("rid").to_numpy(zero_copy_only=False)[text]
                order = np.lexsort((pos, rid, doc, ch.view(np.int64)))
                text, pos, ah, ch, before, after, doc, rid = (v[order] for v in (text, pos, ah, ch, before, after, doc, rid))
                first = np.r_[True, (ch[1:] != ch[:-1]) | (ah[1:] != ah[:-1])]
                # a random key, so that covered ranges spread like anchors
                yield _marks(0, ah[first], ch[first], doc[first], rid[first], pack(pos, before, after)[first])
                if not first.all():
                    r, s, e = joined_ranges(rid[~first], (pos - before)[~first], (pos + after)[~first])
                    yield _marks(1, ah=mix64(r * 31 + s), rid=r, s=s, e=e)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors in the order (ah, kind, ch, doc, rid, x): kind 1 covered ranges, kind 2 needed contexts.

    Rows stream: of an anchor only the first context is held, until a second one shows that it is needed.
    """
    names = [m.split()[0] for m in MARKS.split(", ")]
    last_a = last_c = None
    pending = None  # the only context of the last anchor so far
    for big in batches:
        for at in range(0, big.num_rows, 1 << 17):
            kind, ah, ch, doc, rid, x, s, e = (big.column(c).slice(at, 1 << 17).to_numpy(zero_copy_only=False) for c in names)
            ready = kind == 1
            if ready.any():
                yield _marks(1, rid=rid[ready], s=s[ready], e=e[ready])
                ah, ch, doc, rid, x = (v[~ready] for v in (ah, ch, doc, rid, x))
            if not len(ah):
                continue
            going_on = last_a is not None and ah[0] == last_a
            new = np.r_[not going_on, ah[1:] != ah[:-1]]
            first = new | np.r_[not going_on or ch[0] != last_c, ch[1:] != ch[:-1]]
            last_a, last_c = ah[-1], ch[-1]
            if not first.all():
                pos, before, after = unpack(x[~first])
                r, s1, e1 = joined_ranges(rid[~first], pos - before, pos + after)
                yield _marks(1, rid=r, s=s1, e=e1)
            one = np.flatnonzero(first)
            if not len(one):
                continue
            start = runs(ah[one])
            count = np.diff(np.r_[start, len(one)])
            need = np.repeat(count > 1, count)
            if going_on := going_on and ah[one[0]] == ah[0]:
                need[: count[0]] = True
                if pending is not None:
                    yield pending
            own = one[need]
            if len(own):
                yield _marks(2, ah=ah[own], doc=doc[own], rid=rid[own], x=x[own])
            if len(start) > 1 or not going_on:
                i = one[-1:]
                pending = _marks(2, ah=ah[i], doc=doc[i], rid=rid[i], x=x[i]) if count[-1] == 1 else None
            else:
                pending = None


CONTEXTS = "ah long, doc long, rid long, s long, bytes binary"


HALF = (LENGTH - KMER) // 2
MANY = 8192  # contexts of an anchor, beyond which it is divided


def sides(ah: int, body: bytes, before: int) -> list[int]:
    """Keys of a context by its anchor with the HALF bytes on either side. A window around the anchor holds one of them whole."""
    out = []
    for side, s in ((1, before - HALF), (2, before)):
        if 0 <= s and s + HALF + KMER <= len(body):
            out.append(int.from_bytes(hashlib.blake2b(body[s : s + HALF + KMER] + ah.to_bytes(8, "little", signed=True) + bytes([side]), digest_size=8).digest(), "little", signed=True))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, 64):
            b = big.slice(at, 64)
            out: list[list] = [[] for _ in range(5)]
            for doc, rid, raw, needs in zip(*(b.column(c).to_pylist() for c in ("doc", "rid", "raw", "needs"))):
                for need in needs:
                    pos, before, after = unpack(need["x"])
                    body = raw[pos - before : pos + after]
                    for key in sides(need["ah"], body, before) if need["many"] else (need["ah"],):
                        for col, v in zip(out, (key, doc, rid, pos - before, body)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=[c.split()[0] for c in CONTEXTS.split(", ")])


def ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), dtype=np.uint64)
    out[order] = np.cumsum(np.r_[0, (k[1:] != k[:-1]).astype(np.int64)]).astype(np.uint64)
    return out


def smaller(pos: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, -1 if there is none: all at once, by jumping over larger ones."""
    at = np.arange(-1, len(pos) - 1)
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[pos[at[todo]] > pos[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def longest_previous_factors(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Capped at LENGTH: of each suffix of `order`, whose equal ranks mean LENGTH equal bytes; shorter matches are 0.

    A suffix's longest match with an earlier one is with the previous or the next smaller position
    in suffix order.
    """
    n = len(order)
    previous = smaller(order)
    following = n - 1 - smaller(order[::-1])[::-1]
    out = np.zeros(n, dtype=np.int64)
    for at, there in ((previous, previous >= 0), (following, following < n)):
        i = np.flatnonzero(there)
        out[i] = np.maximum(out[i], np.where(rank[i] == rank[at[i]], LENGTH, 0))
    return out


def earlier(buf: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Positions whose longest previous factor is at least LENGTH.

    room[i] is the number of bytes from i to the end of its segment; strings do not
    leave their segment.
    """
    n = len(buf)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = buf
    rank = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        rank = (rank << np.uint64(8)) | padded[i : n + i]
    rank = ranks(rank)
    for depth in (8, 16, 32):
        key = rank << np.uint64(32)
        key[:-depth] |= rank[depth:]
        rank = ranks(key)
    at = np.flatnonzero(room >= LENGTH)
    if not len(at):
        return at
    key = (rank[at] << np.uint64(32)) | rank[at + LENGTH - 64]
    order = np.argsort(key, kind="stable")  # suffix order, ties by position
    key = key[order]
    # a suffix that shares LENGTH bytes with neither neighbour in suffix order shares them with none
    same = key[1:] == key[:-1]
    near = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    order = order[near]
    return at[np.sort(order[longest_previous_factors(order, key[near]) >= LENGTH])]


def _compare(slab: int):
    def solve(held: list[tuple]) -> pa.RecordBatch | None:
        held.sort()
        parts, base, rids = [], [], []
        row = end = None
        for _, r, s, raw in held:
            if r == row and s <= end:
                if s + len(raw) > end:
                    parts[-1].append(raw[end - s :])
                    end = s + len(raw)
            else:
                parts.append([raw])
                base.append(s)
                rids.append(r)
                row, end = r, s + len(raw)
        segments = [b"".join(p) for p in parts]
        sizes = np.array([len(x) for x in segments])
        first = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(sizes)), sizes)
        buf = np.frombuffer(b"".join(segments), dtype=np.uint8)
        at = earlier(buf, (first + sizes)[which] - np.arange(len(buf)))
        if not len(at):
            return None
        w = which[at]
        s = np.array(base, dtype=np.int64)[w] + at - first[w]
        rid, s, e = joined_ranges(np.array(rids, dtype=np.int64)[w], s, s + LENGTH)
        return _marks(1, rid=rid, s=s, e=e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, group = 0, None
        for b in batches:
            for ah, d, r, s, raw in zip(*(c.to_pylist() for c in b.columns)):
                if ah != group and size > slab:
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
                group = ah
                held.append((d, r, s, raw))
                size += len(raw)
        if held and (out := solve(held)) is not None:
            yield out

    return run


def hot_anchors(texts: DataFrame, rows: int, share: float, most: int) -> np.ndarray:
    """Anchors in at least `share` of a sample of `rows` texts, `most` at most: a hint for the spread of work."""
    some = texts.orderBy(F.xxhash64("rid")).select("rid").limit(rows)
    sample = texts.join(F.broadcast(some), "rid").select("doc", "rid", "raw")  # at most `rows` ids
    counts = sample.mapInArrow(tidied(_anchor(np.zeros(0, dtype=np.uint64))), MARKS).filter("kind = 0").groupBy("ah").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") > max(20, rows * share)).orderBy(F.desc("n"), "ah").limit(most).collect()
    return np.sort(np.array([r["ah"] for r in found], dtype=np.int64).view(np.uint64))


def covered_ranges(texts: DataFrame, scratch: Scratch, slab: int = 1 << 20, sample: int = 4096, most: int | None = None) -> DataFrame:
    """(rid, s, e): ranges of bytes to remove, possibly overlapping. texts: doc, rid, raw."""
    hot = hot_anchors(texts, sample, 0.01, 4096)
    found = texts.select("doc", "rid", "raw").mapInArrow(tidied(_anchor(hot)), MARKS)
    order = ["ah", "kind", "ch", "doc", "rid", "x"]
    met = scratch.keep(found.repartition("ah").sortWithinPartitions(*order).mapInArrow(tidied(_meet), MARKS), "met")
    found = met.filter("kind = 2").select("ah", "rid", "x")
    many = found.groupBy("ah").count().filter(F.col("count") > (MANY if most is None else most)).select("ah", F.lit(True).alias("many"))
    found = found.join(many, "ah", "left").select("rid", F.struct("ah", "x", F.coalesce("many", F.lit(False)).alias("many")).alias("need"))
    needs = found.groupBy("rid").agg(F.collect_list("need").alias("needs"))
    contexts = texts.join(needs, "rid").select("doc", "rid", "raw", "needs").mapInArrow(tidied(_cut), CONTEXTS)
    more = scratch.keep(contexts.repartition("ah").sortWithinPartitions("ah").mapInArrow(tidied(_compare(slab)), MARKS), "compared")
    return met.filter("kind = 1").select("rid", "s", "e").unionByName(more.select("rid", "s", "e"))


ADDED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string"


def _remove(schema: T.StructType, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b, raws in slices(big, "raw", 1 << 22):
                out: dict[str, list] = {c.split()[0]: [] for c in ADDED.split(", ")}
                for raw, ranges in zip(raws, b.column("ranges").to_pylist()):
                    spans, at, kept = 0, 0, []
                    if ranges:
                        x = np.array([(r["s"], r["e"]) for r in ranges], dtype=np.int64)
                        _, s, e = joined_ranges(np.zeros(len(x), dtype=np.int64), x[:, 0], x[:, 1])
                        spans = len(s)
                        for i, j in zip(s.tolist(), e.tolist()):
                            kept.append(raw[at:i])
                            at = j
                    kept.append(raw[at:])
                    rest = b"".join(kept)
                    for name, v in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(rest)), ("n_spans", spans), ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("kept", rest if keep else None), ("kept_text", rest.decode("utf-8", "ignore") if keep else None)):
                        out[name].append(v)
                kinds = {"kept_sha256": pa.string(), "kept": pa.binary(), "kept_text": pa.string()}
                cols = [pa.array(out[f.name], kinds.get(f.name, pa.int64())) if f.name in out else b.column(f.name) for f in schema]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return run


def remove_repeats(df: DataFrame, columns: list[str] | None = None, keep: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Rows of df (their `columns`, all by default) with n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) and kept_text.

    A cut may fall inside a character; kept_text leaves such bytes out.
    """
    scratch = scratch or Scratch(df.sparkSession)
    added = [c.split()[0] for c in ADDED.split(", ")]
    columns = [c for c in (df.columns if columns is None else columns) if c not in added]
    other = [c for c in columns if c not in ("doc_id", "text")]
    docs = scratch.keep(df.select("doc_id", "text", packed(other).alias("row")).withColumn("rid", F.monotonically_increasing_id()), "documents")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "rid", raw.alias("raw"))
    ranges = covered_ranges(texts, scratch).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    ranges = scratch.keep(ranges, "ranges")
    scratch.drop("met", "compared")
    source = docs.select("rid", "doc_id", "row", *(["text"] if "text" in columns else []), raw.alias("raw")).join(ranges, "rid", "left").drop("rid")
    schema = T.StructType([f for f in source.schema if f.name not in ("raw", "ranges")] + list(T._parse_datatype_string(ADDED)))
    out = source.mapInArrow(tidied(_remove(schema, keep)), schema)
    carried = {c: x for c, x in zip(other, unpacked(other))}
    return out.select(*(carried.get(c, F.col(c)) for c in columns), *added)


def oracle() -> str:
    """DuckDB SQL for the op5 query: every 100-byte string of every document, ranked by place."""
    return f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) as s from (select doc_id, h, unnest(range(0, n - {LENGTH - 1})) as i from d where n >= {LENGTH})),
dup as (select doc_id, i from w qualify row_number() over (partition by s order by doc_id, i) > 1),
edge as (select *, case when i <= lag(i) over (partition by doc_id order by i) + {LENGTH} then 0 else 1 end as new from dup),
spans as (select doc_id, min(i) as s, max(i) + {LENGTH} as e from (select *, sum(new) over (partition by doc_id order by i) as g from edge) group by doc_id, g),
gaps as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as a from spans),
kept as (select doc_id, sum(e - s) as n_removed, count(*) as n_spans, max(e) as last_e,
    string_agg(substr(h, 2 * a + 1, 2 * (s - a)), '' order by s) as hex from gaps join d using (doc_id) group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(hex, '') || substr(h, 2 * coalesce(last_e, 0) + 1))) as kept_sha256 from d left join kept using (doc_id)
"""
