import hashlib
import random

import numpy as np
import pytest

from siltstone.llm.queries import oracle_sql, queries
from siltstone.llm.suffix_dedup import LENGTH, MARKS, _marks, _meet, earlier, longest_previous_factors, remove_repeats, sliding, smaller
from tests.oracle import expect_same


def brute(docs):
    """{key: (removed, spans, sha)} of (key, raw) in order."""
    seen, out = set(), {}
    for key, raw in docs:
        mark = bytearray(len(raw))
        for i in range(len(raw) - LENGTH + 1):
            w = hash(raw[i : i + LENGTH])
            if w in seen:
                mark[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        rest = bytes(b for b, m in zip(raw, mark) if not m)
        spans = sum(m and (not i or not mark[i - 1]) for i, m in enumerate(mark))
        out[key] = (sum(mark), spans, hashlib.sha256(rest).hexdigest())
    return out


def test_query_matches_brute_force(spark):
    for sf in ("/root/testdata/sf0.01",):
        got = queries()["op5_suffix_array_dedup"](spark, sf).toPandas()
        docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
        raws = [(d, (t or "").encode()) for d, t in zip(docs.doc_id, docs.text)]
        want = brute(raws)
        assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()} == want
        assert {r.doc_id: r.n_bytes for r in got.itertuples()} == {d: len(x) for d, x in raws}
        assert got.n_removed.sum() > 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    expect_same(queries()["op5_suffix_array_dedup"](spark, sf), oracle_sql()["op5_suffix_array_dedup"], sf)


@pytest.mark.parametrize("seed, many", [(1, 8192), (2, 8192), (3, 1), (4, 2)])
def test_periodic_overlapping_and_boundary_repeats(spark, monkeypatch, seed, many):
    monkeypatch.setattr("siltstone.llm.suffix_dedup.MANY", many)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.choice([3, 9, 40])))
    passages = ["".join(word() for _ in range(30))[: rng.choice([99, 100, 101, 150, 300])] for _ in range(6)] + ["x" * 150, "ab" * 100, "abc" * 70, "é" * 60]
    texts = {}
    for i in range(120):
        texts[i] = "".join(rng.choice(passages)[rng.choice([0, 0, 1, 7]) :] if rng.random() < 0.6 else word() for _ in range(rng.choice([0, 1, 2, 5])))
    rows = list(texts.items())
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute([(i, texts[i].encode()) for i in sorted(texts)])


def test_earlier_respects_segments():
    raw = bytes(np.random.default_rng(0).integers(97, 100, 130, dtype=np.uint8))
    buf = np.frombuffer(raw + raw + raw[:99], dtype=np.uint8)
    room = np.r_[np.arange(130, 0, -1), np.arange(130, 0, -1), np.arange(99, 0, -1)]
    assert list(earlier(buf, room)) == list(range(130, 161))


def test_longest_previous_factors_against_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 60):
        pos = rng.permutation(n)
        want = [next((j for j in range(i - 1, -1, -1) if pos[j] < pos[i]), -1) for i in range(n)]
        assert smaller(pos).tolist() == want
    for n, period in ((400, 1), (700, 130), (900, 333)):
        text = np.resize(rng.integers(97, 99, period, dtype=np.uint8), n).tobytes()
        suffixes = [text[i : i + LENGTH] for i in range(n - LENGTH + 1)]
        order = np.array(sorted(range(len(suffixes)), key=lambda i: (suffixes[i], i)))
        rank = np.unique([suffixes[i] for i in order], return_inverse=True)[1]
        got = longest_previous_factors(order, rank)
        assert [g >= LENGTH for g in got] == [text.find(suffixes[i]) < i for i in order]
        assert earlier(np.frombuffer(text, dtype=np.uint8), np.arange(n, 0, -1)).tolist() == sorted(i for i in order if text.find(suffixes[i]) < i)


def test_anchors_meet_alike_in_batches_of_any_size():
    rng = np.random.default_rng(6)
    ah, ch, doc = np.sort(rng.integers(0, 6, 80)), rng.integers(0, 3, 80), np.arange(80)
    order = np.lexsort((doc, ch, ah))
    rows = _marks(0, ah[order], ch[order], doc[order], doc[order], (doc[order] * 200 << 14) | 32)

    def met(size):
        out = [r for b in _meet(rows.slice(i, size) for i in range(0, 80, size)) for r in b.to_pylist()]
        return sorted((r["kind"], r["ah"] if r["kind"] == 2 else 0, r["rid"], r["x"], r["s"], r["e"]) for r in out)

    assert len(MARKS.split(", ")) == 8 and met(80) == met(1) == met(7)
    firsts = {(a, c): d for a, c, d in reversed(list(zip(ah[order].tolist(), ch[order].tolist(), doc[order].tolist())))}
    several = {a for a in range(6) if sum(x == a for x, _ in firsts) > 1}
    assert {r[2] for r in met(80) if r[0] == 2} == {d for (a, _), d in firsts.items() if a in several}
    assert {r[2] for r in met(80) if r[0] == 1} == set(range(80)) - set(firsts.values())


def test_columns_of_any_name_and_long_texts(spark):
    rng = random.Random(9)
    p = "".join(rng.choice("abcdefgh") for _ in range(120))
    long = "y" * 300_000 + p + "".join(rng.choice("qrst") for _ in range(3_000_000))
    df = spark.createDataFrame([(1, p, 1, 2, 3, 4), (2, long, 1, 2, 3, 4)], "doc_id long, text string, _raw int, _ranges int, rid int, row int")
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert [got[2][c] for c in ("_raw", "_ranges", "rid", "row")] == [1, 2, 3, 4] and got[2]["text"] == long
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 299_999 + 120 and got[2]["n_spans"] == 1


def test_sliding():
    x = np.random.default_rng(1).integers(0, 99, 57)
    for w in (1, 5, 56, 57):
        assert list(sliding(x, w, np.minimum)) == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_edge_rows(spark):
    rng = random.Random(3)
    p, q = ("".join(rng.choice("abcdefgh") for _ in range(140)) for _ in range(2))
    data = [(5, p, 1), (1, "start " + p, 1), (2, None, 1), (3, "", 1), (None, p, 1), (7, q, 1), (7, q, 1)]
    got = remove_repeats(spark.createDataFrame(data, "doc_id long, text string, n_bytes int")).collect()
    assert len(got) == 7
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_removed"], r["n_spans"], bytes(r["kept"])))
    assert by[1] == [(0, 0, ("start " + p).encode())] and by[5] == by[None] == [(140, 1, b"")]
    assert sorted(x[0] for x in by[7]) == [0, 140] and by[2] == by[3] == [(0, 0, b"")]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
