import hashlib
import zlib

import pytest

from siltstone.llm.queries import oracle_sql, queries
from siltstone.llm.sharding import histogram_sort
from tests.oracle import expect_same

SCHEMA = "doc_id long, text string, shard string, _piece int"


def rows(spark, data, **kw):
    return histogram_sort(spark.createDataFrame(data, SCHEMA), **kw).collect()


def test_query_is_whole_balanced_and_gapless(spark):
    got = queries()["op2_histogram_sort_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(got.doc_id) == sorted(docs.index)
    raw = docs.text.map(lambda t: (t or "").encode())
    assert (got["size"].values == got.doc_id.map(raw.map(len)).values + 8).all()
    assert (got.text_crc32.values == got.doc_id.map(raw.map(zlib.crc32)).values).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 24
    # a boundary lies within half a row, or the tolerance, of its exact place
    assert (sums - sums.mean()).abs().max() <= got["size"].max() + 0.04 * sums.mean()


def brute(docs, shards=24, tolerance=0.02):
    """(doc_id, shard, slot) of (doc_id, text) with distinct doc_ids."""
    rows = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16) if t is not None else -1, d, len((t or "").encode()) + 8) for d, t in docs)
    total, at, edges = sum(r[2] for r in rows), [0], []
    for r in rows:
        at.append(at[-1] + r[2])
    for j in range(1, shards):
        t = total * j / shards
        i = next(k for k in range(len(rows)) if at[k] <= t < at[k + 1])
        low, high = i, i + 1
        while low and rows[low - 1][0] == rows[i][0]:
            low -= 1
        while high < len(rows) and rows[high][0] == rows[i][0]:
            high += 1
        if min(t - at[low], at[high] - t) > tolerance * total / shards:
            low, high = i, i + 1
        edges.append(low if t - at[low] <= at[high] - t else high)
    out = set()
    for shard, (a, b) in enumerate(zip([0, *edges], [*edges, len(rows)])):
        out |= {(rows[k][1], shard, k - a) for k in range(a, b)}
    return out


@pytest.mark.parametrize("piece", [512 << 20, 3000])
def test_shards_and_slots_against_brute_force(spark, piece):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(10_000 + i, "copy " * 150) for i in range(300)] + [(20_000, None), (20_001, None), (20_002, ""), (20_003, "long " * 20_000)]
    got = histogram_sort(spark.createDataFrame(docs, "doc_id long, text string"), piece_bytes=piece).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == brute(docs)


def test_columns_of_any_name_pass_through(spark):
    names = ["_sub", "_piece", "row", "key", "w", "g"]
    df = spark.createDataFrame([(1, "a", *range(6), 9), (2, "b", *range(6), 9)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names) + ", slot int")
    got = histogram_sort(df, shards=2).collect()
    assert len(got) == 2 and all([r[n] for n in names] == list(range(6)) and r["slot"] == 0 for r in got)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    expect_same(queries()["op2_histogram_sort_sharding"](spark, sf), oracle_sql()["op2_histogram_sort_sharding"], sf)


def test_hot_group_is_cut_and_others_stay_whole(spark):
    data = [(i, "hot " * 20, None, None) for i in range(3000)] + [(10_000 + i, f"text {i % 900} " * 15, None, None) for i in range(3000)]
    got = rows(spark, data, shards=6)
    sums, where = {}, {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        where.setdefault(r["text"], set()).add(r["shard"])
    mean = sum(sums.values()) / 6
    assert len(got) == 6000 and max(sums.values()) < 1.06 * mean and min(sums.values()) > 0.94 * mean
    assert all(len(v) == 1 for k, v in where.items() if not k.startswith("hot"))
    assert len(where["hot " * 20]) > 1


@pytest.mark.parametrize("piece", [128 << 20, 700])
def test_pieces_agree(spark, piece):
    data = [(i, f"{i * 7919 % 83} words", None, None) for i in range(400)]
    got = {(r["doc_id"], r["shard"], r["slot"]) for r in rows(spark, data, shards=3, piece_bytes=piece)}
    for s in range(3):
        assert sorted(x[2] for x in got if x[1] == s) == list(range(sum(x[1] == s for x in got)))


def test_edge_rows(spark):
    data = [(None, None, "x", 1), (1, None, None, None), (2, "", None, None), (2, "", None, None), (3, "é" * 200_000, None, None)]
    got = rows(spark, data, shards=4)
    assert sorted(r["size"] for r in got) == [8, 8, 8, 8, 400008]
    assert rows(spark, [], shards=4) == []
