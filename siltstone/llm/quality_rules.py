"""Operator 6, quality rules by n-gram perplexity.

Byte 5-grams of all reference texts (those with few symbols) are counted with Spark by
language; a language without any reference text is counted over all its texts. From them comes an
interpolated modified Kneser-Ney model (raw counts at the top order, continuation
counts below, three discounts an order), held as sorted hash arrays. A text's
perplexity is judged against a lower and an upper band of its own language, set
from the median and the median absolute deviation over all texts that pass the
base rules. Short texts vary more, so the band widens with 1/sqrt(bytes).

Base rules: fewer than 20 words, or more than 30 % of words inside 8-word windows
that the text repeats.

Defined cases: null text is an empty text (fails the base rules); null lang is a
language of its own; very long texts are scored whole, in slabs; a language of symbol-rich texts only is judged by a model and
bands of those texts; repeated rows count each time and get the same verdict; an
empty table gives no rows; other columns pass through, and columns that clash with
the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, give_back, packed, small, tidied, unpacked
from .ngrams import HashArray, count_ngrams, gathered, runs, shorter, slabs

ORDER = 5
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, log10_perplexity double"
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


class KneserNey:
    """Levels 1 to n; per level a hash array of grams with log10 p, one of contexts with log10 gamma."""

    def __init__(self, levels: list[dict[str, tuple[np.ndarray, np.ndarray]]]):
        self.groups = {g: i for i, g in enumerate(sorted(levels[0]))}
        self.levels = []
        lower: tuple | None = None
        for n, level in enumerate(levels, 1):
            keys, prob, contexts, gamma = [], [], [], []
            for g, (gram, c) in level.items():
                d = self.discounts(c)
                start = runs(gram >> np.uint64(8))
                which = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(gram)]))
                total = np.add.reduceat(c, start).astype(float)
                cut = d[np.minimum(c, 3)]
                gam = np.add.reduceat(cut, start) / total
                below = np.full(len(gram), 1 / 257) if lower is None else self.lower_prob(lower, g, gram, n)
                keys.append(self.key(g, gram))
                prob.append((c - cut) / total[which] + gam[which] * below)
                contexts.append(self.key(g, gram[start] >> np.uint64(8)))
                gamma.append(gam)
            lower = (HashArray(np.concatenate(keys)), np.concatenate(prob))
            table = HashArray(np.concatenate(contexts))
            self.levels.append((lower[0], np.log10(lower[1])[lower[0].order].astype(np.float32), table, np.log10(np.concatenate(gamma))[table.order].astype(np.float32)))
        for grams, _, contexts, _ in self.levels:
            del grams.order, contexts.order

    def key(self, g: str, gram: np.ndarray) -> np.ndarray:
        return gram | (np.uint64(self.groups[g]) << np.uint64(48))

    def lower_prob(self, lower: tuple, g: str, gram: np.ndarray, n: int) -> np.ndarray:
        table, prob = lower
        at = table.find(self.key(g, gram & np.uint64((1 << 8 * (n - 1)) - 1)))
        return np.where(at >= 0, prob[table.order[np.maximum(at, 0)]], 1 / 257)

    @staticmethod
    def discounts(c: np.ndarray) -> np.ndarray:
        """D for counts 0, 1, 2, 3 and more; fallbacks where counts of counts are missing."""
        n = [0, *(int((c == k).sum()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [0.0]
        for k in (1, 2, 3):
            x = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k
            d.append(min(max(x, 0.05), k - 0.05))
        return np.array(d)

    def log10(self, g: str, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's newest byte after the others."""
        top = len(self.levels)
        out = np.zeros(len(grams), dtype=np.float32)
        rest = None
        for n in range(top, 0, -1):
            table, prob, contexts, gamma = self.levels[n - 1]
            part = grams if rest is None else grams[rest]
            key = self.key(g, part & np.uint64((1 << 8 * n) - 1))
            at = table.find(key)
            if rest is None:
                np.copyto(out, prob[np.maximum(at, 0)], where=at >= 0)
                rest = np.flatnonzero(at < 0)
                missed = rest
            else:
                hit = at >= 0
                out[rest[hit]] += prob[at[hit]]
                missed = rest[~hit]
            if not len(missed):
                return out
            ctx = contexts.find(self.key(g, (grams[missed] & np.uint64((1 << 8 * n) - 1)) >> np.uint64(8)))
            out[missed] += np.where(ctx >= 0, gamma[np.maximum(ctx, 0)], 0)
            rest = missed
        out[rest] += np.float32(-np.log10(257))
        return out


def reference(raw: bytes) -> bytes | None:
    """The text, None if more than 2 % of its bytes are symbols: junk would teach the model to expect junk."""
    return raw if 50 * (len(raw) - len(raw.translate(None, SYMBOLS))) <= len(raw) else None


def fit(df: DataFrame, order: int = ORDER, scratch: Scratch | None = None) -> KneserNey | None:
    """Counts over the reference texts of df (g string, raw binary), or all texts of a g without any; every gram kept. None if df is empty."""
    scratch = scratch or Scratch(df.sparkSession)
    level = scratch.keep(count_ngrams(df, order, reference), f"grams{order}")
    known = level.select("g").distinct()
    bare = [r["g"] for r in df.select("g").distinct().join(known, "g", "left_anti").collect()]  # languages
    if bare:
        level = level.unionByName(scratch.keep(count_ngrams(df.filter(F.col("g").isin(bare)), order), "bare"))
    levels = []
    for n in range(order, 0, -1):
        levels.append(gathered(level))
        if n > 1:
            level = scratch.keep(shorter(level, n), f"grams{n - 1}")
    scratch.drop("bare", *(f"grams{n}" for n in range(1, order + 1)))
    model = KneserNey(levels[::-1]) if levels[0] else None
    del levels
    give_back()
    return model


def repeated_words(words: list[list[bytes]], width: int = 8) -> np.ndarray:
    """Per text, the number of words inside windows of `width` words found twice or more in it."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    total = int(lengths.sum())
    if total < width:
        return np.zeros(len(words), dtype=np.int64)
    x = np.fromiter((hash(w) for ws in words for w in ws), dtype=np.int64, count=total).view(np.uint64)
    doc = np.repeat(np.arange(len(words)), lengths)
    n = total - width + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += x[i : n + i] ^ (x[i : n + i] >> np.uint64(29))
    own = np.flatnonzero(doc[:n] == doc[width - 1 :])
    h = h[own] * np.uint64(0xC4CEB9FE1A85EC53) + doc[own].astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(total + 1, dtype=np.int64)
    np.add.at(mark, own[twice], 1)
    np.add.at(mark, own[twice] + width, -1)
    covered = np.cumsum(mark)[:-1] > 0
    sums = np.r_[0, np.cumsum(covered)]
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


def base_features(raws: list[bytes]) -> dict[str, np.ndarray]:
    words = [r.split() for r in raws]  # bytes.split() cuts at ASCII white space only
    lines = [[x for x in r.split(b"\n") if x.strip()] for r in raws]
    out = {
        "n_words": np.array([len(w) for w in words], dtype=np.int64),
        "word_chars": np.array([len(r.translate(None, SPACES).decode(errors="replace")) for r in raws], dtype=np.int64),
        "n_symbols": np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raws], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": repeated_words(words),
    }
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    return out


def _features(model: KneserNey | None, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 512):
                b = big.slice(s, 512)
                raws = [x or b"" for x in b.column("raw").to_pylist()]
                out = base_features(raws)
                sums = np.zeros(len(raws))
                by: dict[str, list[int]] = {}
                for i, g in enumerate(b.column("g").to_pylist()):
                    by.setdefault(g, []).append(i)
                for g, who in by.items():
                    index = np.array(who)
                    for grams, starts, docs in slabs([raws[i] for i in who], len(model.levels)):
                        np.add.at(sums, index[docs], np.add.reduceat(model.log10(g, grams).astype(np.float64), starts))
                size = np.array([len(r) for r in raws], dtype=np.int64)
                out |= {"n_bytes": size, "log10_perplexity": -sums / (size + 1)}
                cols = [pa.array(out[f.name]) if f.name in out else b.column(f.name) for f in schema]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return run


def bands(scored: DataFrame, width: float, short: float) -> dict[str, tuple[float, float]]:
    """Per language: median and scaled median absolute deviation of log10 perplexity.

    From counts in bins of 0.0005, exact to the bin whatever the number of rows.
    """
    bins = (
        scored.filter(~F.col("base_failed"))
        .groupBy("g", F.round(F.col("log10_perplexity") * 2000).cast("long").alias("bin"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    by: dict[str, list[tuple[int, int]]] = {}
    for r in bins:
        by.setdefault(r["g"], []).append((r["bin"], r["n"]))
    out = {}
    for g, pairs in by.items():
        mid = weighted_median(pairs)
        out[g] = (mid / 2000, 1.4826 * weighted_median([(abs(x - mid), n) for x, n in pairs]) / 2000)
    return out


def weighted_median(pairs: list[tuple[float, int]]) -> float:
    pairs = sorted(pairs)
    half, at = sum(n for _, n in pairs) / 2, 0
    for x, n in pairs:
        at += n
        if at >= half:
            return x
    return 0.0


def quality_rules(df: DataFrame, columns: list[str] | None = None, width: float = 10.0, short: float = 3.0, scratch: Scratch | None = None) -> DataFrame:
    """Rows of df (their `columns`, all by default) with FEATURES, lower, upper and kept."""
    scratch = scratch or Scratch(df.sparkSession)
    own = [x.split()[0] for x in FEATURES.split(", ")]
    columns = [c for c in (df.columns if columns is None else columns) if c not in (*own, "lower", "upper", "kept")]
    g, raw = F.coalesce(F.col("lang"), F.lit("\x00null")).alias("g"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")
    model = fit(df.select(g, raw), scratch=scratch)
    source = df.select(packed(columns).alias("row"), g, raw)
    schema = T.StructType([f for f in source.schema if f.name != "raw"] + list(T._parse_datatype_string(FEATURES)))
    scored = scratch.keep(source.mapInArrow(tidied(_features(model, schema)), schema), "scored")
    del model  # the workers had it; the driver needs the memory for the plans that follow
    give_back()
    found = bands(scored, width, short)
    limits = small(df.sparkSession, [(k, m, s) for k, (m, s) in found.items()], "g string, mid double, dev double")
    slack = F.col("dev") * width + F.lit(short) / F.sqrt(F.col("n_bytes") + 1)
    out = scored.join(limits, "g", "left")  # one row a language
    kept = ~F.col("base_failed") & F.coalesce(F.abs(F.col("log10_perplexity") - F.col("mid")) <= slack, F.lit(False))
    lower, upper = (F.pow(F.lit(10.0), x) for x in (F.col("mid") - slack, F.col("mid") + slack))
    return out.select(*unpacked(columns), *own, lower.alias("lower"), upper.alias("upper"), kept.alias("kept"))
