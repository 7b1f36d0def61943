import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import reads, writes
from siltstone.schema import MUTATION_SCHEMA


def batch(seed, n=400):
    rng = random.Random(seed)
    key = lambda: f"{rng.randrange(60):02d}".encode()
    out = []
    for i in range(n):
        op = rng.choice([0, 1, 2, 3])
        a, b = sorted((key(), key()))
        out.append((i * 3 + rng.randrange(3), op, a if op == 3 else key(), b"v" if op < 2 else None, b if op == 3 else None))
    return out


def brute(rows, live):
    """ord -> whether the key lives just before a point mutation."""
    live, out = set(live), {}
    for ord_, op, key, _, end in sorted(rows):
        if op == 3:
            live = {k for k in live if not key <= k < end}
            continue
        out[ord_] = key in live
        live = live - {key} if op == 2 else live | {key}
    return out


@pytest.mark.parametrize("seed, few, block", [(1, 64, 1 << 16), (2, 0, 1 << 16), (3, 5, 50)])
def test_live_before_against_brute_force(spark, monkeypatch, seed, few, block):
    monkeypatch.setattr(writes, "BLOCK", block)
    monkeypatch.setattr(writes, "ROWS_A_BUCKET", 20)  # ends of ranges lie in several buckets
    rows = batch(seed)
    live = [f"{k:02d}".encode() for k in range(0, 60, 3)]
    df = spark.createDataFrame(rows, MUTATION_SCHEMA)
    got = writes.live_before(df, spark.createDataFrame([(k,) for k in live], "key binary"), few=few)
    assert {r["ord"]: r["live_before"] for r in got.collect()} == brute(rows, live)


def test_no_nested_loop_over_many_ranges(spark):
    df = spark.createDataFrame(batch(4), MUTATION_SCHEMA)
    plan = writes.live_before(df, df.filter("op = 0").select("key"), few=3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_unsorted_in_blocks(spark, block):
    keys = [b"a", b"b", b"b", b"d", b"c", b"e", b"a", b"f", b"g"]
    df = spark.createDataFrame(list(enumerate(keys)), "ord long, key binary")
    got = sorted((r["ord"], bytes(r["previous"])) for r in reads.unsorted(df, block).collect())
    assert got == [(4, b"d"), (6, b"e")]
    assert reads.unsorted(df.filter(F.lit(False)), block).collect() == []
