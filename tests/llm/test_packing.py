import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm.packing import best_fill, pack, padding, plan_bins, tail_windows
from siltstone.llm.queries import queries

FILE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("seed", range(8))
def test_best_fill_is_optimal(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(24, dtype=np.int64)
    for _ in range(6):
        counts[rng.integers(1, 24)] += rng.integers(1, 3)
    capacity = int(rng.integers(5, 40))
    items = [k for k in range(24) for _ in range(counts[k])]
    brute = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= capacity)
    total, used = best_fill(np.resize(counts, max(24, capacity + 1)) * (np.arange(max(24, capacity + 1)) < 24), capacity)
    assert total == brute == sum(k * n for k, n in used.items())
    assert all(n <= counts[k] for k, n in used.items())


def test_plan_places_every_piece():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 65)
    counts[0] = 0
    plan, seen = plan_bins(counts, 64), np.zeros(65, dtype=np.int64)
    for used, times in plan:
        assert sum(k * n for k, n in used.items()) <= 64
        for k, n in used.items():
            seen[k] += n * times
    assert (seen == counts).all()
    assert tail_windows(64 * 2 + 37, 64) == [(0, 64), (64, 64), (128, 32), (160, 4), (164, 1)]


def verify(pieces, texts):
    tok = Tokenizer.from_file(FILE)
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in texts.items()}
    by = pieces.sort_values(["doc_id", "start"])
    for d, part in by.groupby("doc_id"):
        at = 0
        for r in part.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    lost = total = 0
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]]
        size = int(part.length.sum())
        assert size <= 2048
        lost, total = lost + padding(size, 2048), total + size
    return lost / total


def test_query_round_trip(spark):
    got = queries()["op9_minimum_bin_slack_packing"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    assert set(got.doc_id) == set(docs.doc_id)
    assert verify(got, dict(zip(docs.doc_id, docs.text))) < 0.01


def test_edge_rows(spark):
    texts = {1: None, 2: "", 3: "a<|endoftext|>b", 4: "ünïcode     ١٢٣ 漢字 \U0001f600 " * 900, 5: "\r\n\t  x'LL 12"}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, length string")
    assert verify(pack(df, FILE, RANKS).toPandas(), texts) == 0
    assert verify(pack(df, FILE).toPandas(), texts) == 0
    assert verify(pack(df, FILE, RANKS, ids=False).toPandas(), texts) == 0
    twice = pack(df.union(df), FILE, RANKS).toPandas()
    assert twice.groupby(["sequence_id", "offset"]).size().max() == 1
    assert pack(df.limit(0), FILE, RANKS).toPandas().empty


def test_pieces_are_not_sorted_to_their_offsets(spark):
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(50)], "doc_id long, text string")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if offsets of many tasks were too large
    try:
        out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() >= 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
