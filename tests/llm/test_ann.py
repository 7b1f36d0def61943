import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm.ann import encode, search, train
from siltstone.llm.queries import queries


def brute(ids, x, asked, k):
    s = x @ x[asked].T
    out = {}
    for j, i in enumerate(asked):
        c = [(-(s[n, j]), ids[n]) for n in range(len(ids)) if ids[n] != ids[i]]
        out[ids[i]] = [v for _, v in sorted(c)[:k]]
    return out


def test_query_recall_and_exact_scores(spark):
    got = queries()["op8_additive_quantisation_search"](spark, "/root/testdata/sf0.1").toPandas()
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(np.float64)
    at = {v: i for i, v in enumerate(ids)}
    asked = [i for i, v in enumerate(ids) if v % 20 == 0]
    want = brute(ids, x, asked, 20)
    hit = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21))
        assert np.allclose(part.score, [x[at[q]] @ x[at[v]] for v in part.vec_id], rtol=0, atol=1e-12)
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))
        hit += len(set(part.vec_id) & set(want[q]))
    assert set(got.query_id) == set(want) and hit / (20 * len(want)) > 0.95


def test_small_blocks_and_depth_still_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = search(df, F.col("vec_id") % 40 == 0, k=10, block=1500, depth=100, books=4, words=64).toPandas()
    want = brute(np.arange(4000), x, list(range(0, 4000, 40)), 10)
    hit = sum(len(set(p.vec_id) & set(want[q])) for q, p in got.groupby("query_id"))
    assert hit / (10 * len(want)) > 0.9


def test_recall_at_full_blocks(spark):
    rng = np.random.default_rng(5)
    n = 33_000  # two blocks of the default size and a rest
    x = rng.normal(size=(n, 32)) + rng.normal(size=(40, 32))[rng.integers(0, 40, n)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = search(df, F.col("vec_id") % 300 == 0, k=20).toPandas()
    want = brute(np.arange(n), x, list(range(0, n, 300)), 20)
    hit = sum(len(set(p.vec_id) & set(want[q])) for q, p in got.groupby("query_id"))
    assert hit / (20 * len(want)) > 0.9


def test_beam_search_beats_greedy():
    x = np.random.default_rng(0).normal(size=(2000, 12)).astype(np.float32)
    books = train(x, 4, 16)
    err = [float(((x - sum(books[j][c[:, j]] for j in range(4))) ** 2).sum()) for c in (encode(x, books, 1), encode(x, books, 8))]
    assert err[1] <= err[0]


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_edge_rows(spark, metric):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (0, [1.0, 0.0]), (9, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in search(df, F.col("vec_id") % 20 == 0, metric=metric).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 9)]
    assert search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
