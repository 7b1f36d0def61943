import zlib

import numpy as np
import pytest

from siltstone.llm.quality_net import CHUNK, EMBED, FILTERS, STEP, TAPS, Net, chunked, classify, doc_scores, gradient
from siltstone.llm.queries import queries


def auc(score, y):
    r = score.rank()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0


def random_net(seed=0):
    rng = np.random.default_rng(seed)
    return Net(rng.normal(size=(256, 6)), rng.normal(size=(TAPS * 6, FILTERS)), rng.normal(size=FILTERS), rng.normal(size=2 * FILTERS) / 30, 0.1)


def brute(net, raw):
    size = max(64, -(-len(raw) // 64) * 64)
    buf = np.frombuffer(raw.ljust(size, b"\0") + bytes(TAPS), dtype=np.uint8)
    e = net.embed[buf]
    h = np.stack([e[i : i + TAPS].ravel() @ net.filters for i in range(size)])
    starts = range(0, max(1, size - (CHUNK - STEP)), STEP)
    act = np.stack([np.maximum(h[s : s + CHUNK].max(0) + net.bias, 0) for s in starts])
    return 1 / (1 + np.exp(-(np.concatenate([act.mean(0), act.max(0)]) @ net.out + net.base)))


@pytest.mark.parametrize("limit", [448, 1344, 1 << 18])
def test_scores_cover_the_whole_text(limit):
    net = random_net()
    rng = np.random.default_rng(1)
    raws = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 63, 64, 65, 447, 448, 449, 511, 512, 513, 519, 900, 960, 961, 5000)]
    got = doc_scores(net.tables(), net, raws, limit)
    assert np.allclose(got, [brute(net, r) for r in raws], atol=1e-5)


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    params = [rng.normal(size=s) * 0.3 for s in ((256, EMBED), (TAPS * EMBED, FILTERS), (FILTERS,), (2 * FILTERS,), (1,))]
    texts, y = [chunked(bytes(rng.integers(0, 256, n, dtype=np.uint8))) for n in (100, 900, 3000)], np.array([0, 1, 1])
    assert [len(t) for t in texts] == [1, 2, 7]

    def loss():
        p = doc_scores(Net(*params[:4], float(params[4][0])).tables(), Net(*params[:4], float(params[4][0])), [b"".join(c[:STEP].tobytes() for c in t[:-1]) + t[-1].tobytes() for t in texts])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    for param, grad in zip(params, gradient(params, texts, y)):
        for i in rng.choice(param.size, min(5, param.size), replace=False):
            old = param.flat[i]
            param.flat[i] = old + 1e-3
            up = loss()
            param.flat[i] = old - 1e-3
            down = loss()
            param.flat[i] = old
            assert abs((up - down) / 2e-3 - grad.flat[i]) < 2e-2 * max(1, abs(grad.flat[i]))


def test_columns_of_any_name_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7, 8)], "doc_id long, text string, _raw int, raw int, row int, score int")
    got = classify(docs, spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (got["_raw"], got["raw"], got["row"], got["score"]) == (5, 6, 7, 0.5)


def test_query_learns_and_holds_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op1_byte_conv_quality"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    m = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    assert auc(m.score, m.quality) > 0.95
    long = m.doc_id.map(dict(zip(docs.doc_id, docs.text.str.len()))) > 4000
    assert (m[long].predicted == m[long].quality).mean() > 0.9  # texts of many chunks are judged as well


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 1.0), (None, "text", 0.0), (2, "", 1.0), (7, "é" * 40_000, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = classify(docs, none).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5} and {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (7, 1), (99, 0)], "doc_id long, quality int")
    got = classify(docs, labels, steps=20).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert classify(docs.limit(0), labels).collect() == []
