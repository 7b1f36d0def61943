"""Operator 9, packing by minimum bin slack.

A document's ids are cut into full windows and one rest. How many rests there are
of each length (at most window - 1 numbers, whatever the corpus) goes to the
driver, where `plan_bins` fills windows: a bitset of reachable sums, kept per length, finds
the multiset of rest lengths closest to the capacity around the longest rest, and
backtracking gives its counts. The same filling is used as often as the counts
allow, so the plan has few patterns and many repetitions. A rest's rank among
those of its length then says which repetition, and where in it, it goes.

Rests that no filling takes up without slack are cut at the end: `plan_bins` lays
what remains end to end when that saves padding, as ids may be cut freely.

Ranks need no sort of a whole length: they count within a write task, and the
offsets of the tasks are running sums over one row per (length, task), which go to the pieces as one array a task.

Defined cases: null text is an empty text, whose ids are the end id alone; rows
are packed as they come, repeated ones too; null doc_id is kept; no rows, no
pieces; very long texts are tokenized whole and cut into windows; other columns are not needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidied

PIECES = "doc_id long, start long, length int, ids binary, ids_crc32 long, doc_tokens long, task int, lrank long"


class Ids:
    """Ids of a byte-level BPE file of `tokenizers`.

    The file's own library encodes about 2.5 MB a CPU second. `tiktoken` applies the
    same merges as ranks four times as fast, so it does the bulk; texts that hold a
    special token's string, and every batch's first text as a check, go through
    `tokenizers`, which takes over if the two ever differ.
    """

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        checked = False
        for x in texts:
            if self.fast is None or any(s in x for s in self.special):
                yield self.exact(x)
                continue
            got = np.array(self.fast.encode_ordinary(x), dtype="<u4")
            if not checked and 0 < len(x) < 20_000:
                checked = True
                if not np.array_equal(got, self.exact(x)):
                    self.fast, got = None, self.exact(x)
            yield got


def _tokenize(path: str, ranks_path: str | None, window: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok, task, seen = Ids(path, ranks_path), TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: dict[str, list] = {k: [] for k in ("doc", "start", "length", "ids", "crc", "n", "rank")}
                for doc, ids in zip(part.column("doc_id").to_pylist(), tok.batch([x or "" for x in part.column("text").to_pylist()])):
                    ids = np.append(ids, np.array([end_id], dtype="<u4"))
                    for s in range(0, len(ids), window):
                        raw = ids[s : s + window].tobytes()
                        k = len(raw) // 4
                        for name, v in (("doc", doc), ("start", s), ("length", k), ("ids", raw if keep_ids else None), ("crc", zlib.crc32(raw)), ("n", len(ids)), ("rank", int(seen[k]))):
                            out[name].append(v)
                        seen[k] += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array(v, t) for v, t in zip(out.values(), kinds)]
                cols.insert(6, pa.array([task] * len(out["doc"]), pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def best_fill(counts: np.ndarray, capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum <= capacity of lengths within counts, and one multiset for it.

    Bit s of the set after a length says that sum s can be reached with the lengths
    so far; longer lengths come first. Counts of a length are added as powers of two.
    """
    mask, items = (1 << (capacity + 1)) - 1, []
    for length in np.flatnonzero(counts[: capacity + 1])[::-1]:
        left, k = min(int(counts[length]), capacity // int(length)), 1
        while left > 0:
            k = min(k, left)
            items.append((int(length), k))
            left -= k
            k *= 2
    sets = [1]
    for length, k in items:
        sets.append((sets[-1] | (sets[-1] << (length * k))) & mask)
        if sets[-1] >> capacity & 1:
            break
    s = best = sets[-1].bit_length() - 1
    used: dict[int, int] = {}
    for i in range(len(sets) - 1, 0, -1):
        if not sets[i - 1] >> s & 1:
            length, k = items[i - 1]
            used[length] = used.get(length, 0) + k
            s -= length * k
    return best, used


def plan_bins(counts: np.ndarray, window: int) -> list[tuple[dict[int, int], int]]:
    """(counts of each length, repetitions) of every filling; all pieces are placed."""
    left, plan = counts.copy(), []
    if left[window]:
        plan.append(({window: 1}, int(left[window])))
        left[window] = 0
    for length in range(window - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            _, used = best_fill(left, window - length)
            left[length] += 1
            used[length] = used.get(length, 0) + 1
            times = min(int(left[k]) // n for k, n in used.items())
            for k, n in used.items():
                left[k] -= n * times
            plan.append((used, times))
    return plan


def padding(total: int, window: int) -> int:
    """Padding of a sequence: none at the window or at a power of two."""
    return 0 if total & (total - 1) == 0 else window - total


def _layout(plan: list[tuple[dict[int, int], int]], window: int):
    """Per length: (first rank, copies in the pattern, first sequence, offset of the first copy)."""
    where: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    loose: list[tuple[int, int]] = []
    for used, times in plan:
        total = sum(k * n for k, n in used.items())
        if padding(total, window):
            loose.extend((k, n * times) for k, n in sorted(used.items(), reverse=True))
            continue
        offset = 0
        for k, n in sorted(used.items(), reverse=True):
            where.setdefault(k, []).append((taken.get(k, 0), n, sequence, offset))
            taken[k] = taken.get(k, 0) + n * times
            offset += k * n
        sequence += times
    runs: dict[int, list[tuple[int, int, int]]] = {}
    at = 0
    for k, n in loose:  # end to end from here on, cut where a window ends
        runs.setdefault(k, []).append((taken.get(k, 0), n, at))
        taken[k] = taken.get(k, 0) + n
        at += k * n
    return where, runs, sequence, at


def tail_windows(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the windows over what is laid end to end: the last one in powers of two."""
    out = [(s, window) for s in range(0, total - window + 1, window)]
    start = total - total % window
    for bit in range(window.bit_length(), -1, -1):
        if total % window >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


PLACED = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _place(where, runs, first_tail: int, tail_total: int, window: int):
    full = tail_total // window
    rest = tail_windows(tail_total, window)[full:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, start, k, ids, crc, n, rank in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "rank"))):
                slots = where.get(k, [])
                i = _last(slots, rank)
                loose = runs.get(k, [])
                j = _last(loose, rank)
                if j >= 0:
                    first, _, at = loose[j]
                    at += (rank - first) * k
                    done = 0
                    while done < k:
                        w = (at + done) // window
                        if w < full:
                            seq, lo, size = first_tail + w, w * window, window
                        else:
                            m = max(x for x, (s, _) in enumerate(rest) if s <= at + done)
                            seq, (lo, size) = first_tail + full + m, rest[m]
                        take = min(k - done, lo + size - at - done)
                        row = (doc, start + done, take, ids[4 * done : 4 * (done + take)] if ids is not None else None, crc if take == k else None, n, seq, at + done - lo)
                        for col, v in zip(out, row):
                            col.append(v)
                        done += take
                else:
                    first, per, seq, offset = slots[i]
                    row = (doc, start, k, ids, crc, n, seq + (rank - first) // per, offset + (rank - first) % per * k)
                    for col, v in zip(out, row):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=[x.split()[0] for x in PLACED.split(", ")])

    return run


def _last(slots: list[tuple], rank: int) -> int:
    lo, hi = 0, len(slots)
    while lo < hi:
        mid = (lo + hi) // 2
        if slots[mid][0] <= rank:
            lo = mid + 1
        else:
            hi = mid
    return lo - 1


def pack(df: DataFrame, tokenizer: str, ranks: str | None = None, window: int = 2048, end_id: int = 1, ids: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and places.

    Columns: doc_id, start, length, ids (only with `ids`), ids_crc32, doc_tokens, sequence_id, offset.
    Without `ids` only those of pieces that are cut once more are looked up.
    """
    scratch = scratch or Scratch(df.sparkSession)
    raw = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = scratch.keep(raw.mapInArrow(tidied(_tokenize(tokenizer, ranks, window, end_id, True)), PIECES), "pieces")
    by_task = scratch.keep(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "by_task")
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    where, runs, first_tail, tail_total = _layout(plan_bins(counts, window), window)
    # per task an array of the ranks where its pieces of each length begin: one row a task, so that pieces are never sorted to their offsets
    every = by_task.select("task").distinct().crossJoin(F.broadcast(scratch.spark.range(1, window + 1).select(F.col("id").cast("int").alias("length"))))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    skips = every.join(by_task, ["task", "length"], "left").select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    offsets = skips.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("length", "skip"))).getField("skip").alias("skips"))
    offsets = scratch.keep(offsets, "offsets")
    place = tidied(_place(where, runs, first_tail, tail_total, window))

    def ranked(x: DataFrame) -> DataFrame:
        return x.join(F.broadcast(offsets), "task").withColumn("rank", F.element_at("skips", F.col("length")) + F.col("lrank")).drop("skips")

    if ids:
        placed = ranked(pieces).mapInArrow(place, PLACED)
    else:
        # of each length with pieces that are laid end to end, the first such rank
        cut = F.create_map(*[F.lit(x) for k, rows in runs.items() for x in (k, rows[0][0])]) if runs else F.create_map().cast("map<int,long>")
        loose = F.coalesce(F.col("rank") >= F.try_element_at(cut, F.col("length")), F.lit(False))
        whole = ranked(pieces.withColumn("ids", F.lit(None).cast("binary"))).filter(~loose)
        rest = ranked(pieces.filter(F.col("length").isin(list(runs)))).filter(loose)
        placed = whole.mapInArrow(place, PLACED).unionByName(rest.mapInArrow(place, PLACED))
    # a piece that was cut once more needs its own checksum
    out = placed.withColumn("ids_crc32", F.coalesce("ids_crc32", F.crc32("ids")))
    return out if ids else out.drop("ids")
