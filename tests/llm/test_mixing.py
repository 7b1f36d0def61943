import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm.mixing import mix, pareto_key, targets
from siltstone.llm.queries import oracle_sql, queries
from tests.oracle import expect_same

SCHEMA = "doc_id long, text string, source string, target string, g int"


def test_targets_are_a_fixed_point():
    sizes = [1000, 5, 20, 0, 300]
    got = targets(sizes, [1, 2, 3, 1, 2], 3)
    assert abs(sum(got) - sum(sizes)) < 1e-6
    assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes))
    free = [i for i in range(5) if got[i] < 3 * sizes[i] - 1e-9]
    assert len({round(got[i] / [1, 2, 3, 1, 2][i], 6) for i in free}) == 1


def test_pareto_order_is_odds_over_odds(spark):
    rng = np.random.default_rng(1)
    u, p = rng.integers(0, 2**52, 200), np.r_[1.0, 2.5, rng.random(198)]
    x = (u + 0.5) / 2**52
    q = np.where(p >= 1, 0, (x / (1 - x)) / (np.minimum(p, 1) / np.maximum(1 - p, 1e-300)))
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(u, p))], "i int, u long, p double")
    key = {r["i"]: r["k"] for r in df.select("i", pareto_key(F.col("u"), F.col("p")).alias("k")).collect()}
    assert [key[0], key[1]] == [0, 0]
    assert sorted(range(2, 200), key=lambda i: key[i]) == sorted(range(2, 200), key=lambda i: q[i])


def brute(rows, weights=(1, 2, 3), cap=3, seed="mix"):
    """doc_id -> copies, for distinct doc_ids: (doc_id, text, source)."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = [sum(size[d] for d, _, s in rows if s == n) for n in names]
    out = {}
    for n, s, t in zip(names, total, targets(total, [weights[i % len(weights)] for i in range(len(names))], cap)):
        ids = [d for d, _, x in rows if x == n]
        whole = min(int(t // s), cap) if s else 0
        want = t - whole * s
        sure, free = set(), [d for d in ids if size[d]]
        while want > 0:
            scale = (want - sum(size[d] for d in sure)) / sum(math.isqrt(size[d]) * size[d] for d in free)
            more = {d for d in free if math.isqrt(size[d]) * scale >= 1}
            if not more:
                break
            sure |= more
            free = [d for d in free if d not in more]
        key = dict.fromkeys(sure, 0.0)
        for d in free if want > 0 else []:
            x = (int(hashlib.md5(f"{seed}|{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = math.isqrt(size[d]) * scale
            key[d] = (x / (1 - x)) / (p / (1 - p))
        order, at, best, taken = sorted(key, key=key.get), 0, abs(want), 0
        for i, d in enumerate(order):
            at += size[d]
            if abs(at - want) < best:
                best, taken = abs(at - want), i + 1
        extra = set(order[:taken])
        out |= {d: (whole + (d in extra)) if size[d] else 0 for d in ids}
    return out


def test_copies_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(10_000, "long " * 30_000, "src1"), (10_001, None, "src1"), (10_002, "one", None)]
    got = mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == brute(docs)


def test_clashing_columns_pass_through(spark):
    names = ["u", "g", "scale", "whole", "cut", "key", "w", "row", "_s", "_source", "sure"]
    df = spark.createDataFrame([(1, "a b", "s", *range(11), 7), (2, "c", "s", *range(11), 7)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names) + ", size int")
    got = mix(df).orderBy("doc_id").collect()
    assert got[0].asDict().keys() >= set(names) and [got[0][n] for n in names] == list(range(11))
    assert [r["size"] for r in got] == [2, 1]


def test_query_against_brute_force(spark):
    got = queries()["op10_pareto_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    again = queries()["op10_pareto_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in zip(docs.doc_id, docs.text)}
    assert dict(zip(got.doc_id, got["size"])) == size
    got = got.merge(docs[["doc_id", "source"]], on="doc_id")
    names = sorted(docs.source.unique())
    sums = [int(got[got.source == s]["size"].sum()) for s in names]
    goal = targets(sums, [i % 3 + 1 for i in range(len(names))], 3)
    for s, total, t in zip(names, sums, goal):
        part = got[got.source == s]
        assert (part.source_size == total).all() and np.allclose(part.target, t)
        assert (part.taken <= 3 * part["size"]).all() and (part.taken % part["size"].clip(lower=1) == 0).all()
        assert abs(part.taken.sum() - t) <= part["size"].max() / 2 + 1


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    expect_same(queries()["op10_pareto_mixing"](spark, sf), oracle_sql()["op10_pareto_mixing"], sf)


def test_unequal_inclusion_prefers_heavy_rows(spark):
    df = spark.createDataFrame([(i, "a b c d e", "s" if i < 600 else "t", 1.0 if i % 2 else 3.0) for i in range(1200)], "doc_id long, text string, source string, scale double")
    got = mix(df, weights=(1, 5), inclusion="scale").toPandas()
    s = got[got.source == "s"]
    assert s[s.doc_id % 2 == 0].copies.mean() > 2 * s[s.doc_id % 2 == 1].copies.mean() > 0


def test_edge_rows(spark):
    data = [(1, None, None, "x", 9), (2, "", "a", None, 1), (None, "one two", "a", None, 1), (3, "one two", "a", None, 1), (3, "one two", "a", None, 1), (4, "w " * 5000, "b", None, 1)]
    got = mix(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 6 and all(r["copies"] <= 3 for r in got)
    assert {r["source_size"] for r in got if r["source"] is None} == {0}
    assert len({r["copies"] for r in got if r["doc_id"] == 3}) == 1
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
