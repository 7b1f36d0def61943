import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import compaction, reads, visibility
from siltstone.schema import ENTRY_SCHEMA


def log(spark, *rows):
    """Rows like ("P", key, seq), ("D", key, seq), ("R", start, end, seq)."""
    out = []
    for r in rows:
        if r[0] == "R":
            out.append((r[3], 2, r[1].encode(), None, r[2].encode()))
        else:
            out.append((r[2], 0 if r[0] == "P" else 1, r[1].encode(), f"v{r[2]}".encode() if r[0] == "P" else None, None))
    return spark.createDataFrame(out, ENTRY_SCHEMA)


def keys(df):
    return [bytes(r["key"]).decode() for r in df.collect()]


@pytest.mark.parametrize("rows, want", [
    ((("P", "c", 1), ("P", "a", 2), ("P", "b", 3)), "a b c"),
    ((("P", "b", 10), ("R", "a", "c", 11)), ""),
    ((("R", "a", "m", 5), ("R", "f", "z", 7), ("P", "g", 6)), ""),
    ((("P", "k", 10), ("D", "k", 20)), ""),
    ((("R", "a", "z", 10), ("P", "x", 12)), "x"),
    ((("P", "b", 10), ("R", "a", "c", 15)), ""),
    ((("D", "b", 50), ("R", "x", "z", 60), ("P", "b", 50), ("P", "y", 10)), ""),
    ((("R", "b", "d", 20), ("P", "c", 10)), ""),
    ((("P", "b", 10), ("R", "a", "d", 12), ("P", "c", 11)), ""),
    ((("P", "a", 5), ("R", "b", "d", 20), ("P", "c", 10), ("P", "e", 1)), "a e"),
    ((("P", "b", 1), ("P", "a", 2), ("P", "aa", 3)), "a aa b"),
    ((("P", "b", 9), ("R", "b", "c", 9)), "b"),
    ((("R", "c", "c", 9), ("R", "d", "a", 9), ("P", "c", 1), ("P", "b", 1)), "b c"),
    ((("R", "k", "l", 3), ("P", "k", 5)), "k"),
    ((("R", "a", "d", 1), ("R", "a", "c", 5), ("P", "b", 3), ("P", "c", 3)), "c"),
    ((), ""),
])
def test_golden(spark, rows, want):
    df = log(spark, *rows)
    assert keys(reads.scan(df)) == want.split()
    assert keys(visibility.visible(df, few=0, buckets=3).orderBy("key")) == want.split()


def test_bounds_limits_and_ranges_that_start_before_the_scan(spark):
    df = log(spark, *(("P", k, i) for i, k in enumerate("abcdef")), ("R", "a", "d", 50))
    assert keys(reads.scan(df, b"b", b"f")) == ["d", "e"]
    assert keys(reads.scan(df, limit=0)) == [] and keys(reads.scan(df, limit=2)) == ["d", "e"]
    assert keys(reads.scan(df, as_of_seq=49)) == list("abcdef")
    assert keys(reads.seek(df, b"e")) == ["e", "f"]
    assert reads.get(df, b"e") == b"v4" and reads.get(df, b"b") is None and not reads.exists(df, b"zz")
    asked = spark.createDataFrame([(b"e",), (b"b",), (b"e",)], "key binary")
    assert {(bytes(r["key"]), r["found"]) for r in reads.multi_get(df, asked).collect()} == {(b"e", True), (b"b", False)}


def test_covering_sequence(spark):
    df = visibility.ranges(log(spark, ("R", "a", "m", 10), ("R", "f", "z", 20)))
    probe = spark.createDataFrame([(b"f",), (b"b",), (b"z",), (b"",)], "key binary")
    for options in ({}, {"few": 0, "buckets": 2}):
        got = {bytes(r["key"]): r["cover_seq"] for r in visibility.covering_seq(probe, df, **options).collect()}
        assert got == {b"f": 20, b"b": 10, b"z": None, b"": None}


def model(rows):
    best, out = {}, {}
    for r in rows:
        if r[0] != "R" and (r[1] not in best or (r[2], r[0] == "D") >= (best[r[1]][2], best[r[1]][0] == "D")):
            best[r[1]] = r
    for k, r in best.items():
        if r[0] == "P" and not any(x[0] == "R" and x[1] <= k < x[2] and x[3] > r[2] for x in rows):
            out[k] = r[2]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_against_a_model(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    rows = []
    for seq in range(1, 220):
        kind = rng.choice("PPPDR")
        rows.append(("R", *sorted((word(), word())), seq) if kind == "R" else (kind, word(), seq))
    df, want = log(spark, *rows).cache(), model(rows)
    rest, part = df.filter(F.col("seq") % 3 == 0), df.filter(F.col("seq") % 3 != 0)
    state = lambda x, **o: {bytes(r["key"]).decode(): r["seq"] for r in visibility.visible_entries(x, **o).collect()}
    assert state(df) == want
    assert state(df, few=0, buckets=5) == want
    assert state(compaction.compact(df)) == want
    assert state(compaction.compact(df, bottom=True)) == want
    assert state(compaction.merge_runs(compaction.compact(part), rest)) == want
    bottom = compaction.compact(df, bottom=True)
    assert bottom.filter("kind <> 0").isEmpty()
    df.unpersist()


def test_compaction_keeps_tombstones(spark):
    got = {(r["kind"], bytes(r["key"]), r["seq"]) for r in compaction.compact(log(spark, ("P", "k", 10), ("D", "k", 20), ("R", "a", "z", 15), ("P", "x", 16), ("P", "b", 3))).collect()}
    assert got == {(1, b"k", 20), (2, b"a", 15), (0, b"x", 16)}


def test_floor_lookup(spark):
    idx = spark.createDataFrame([(f"{i:04d}".encode(), i) for i in range(0, 1000, 10)], "key binary, offset long")
    probes = spark.createDataFrame([(b"0000",), (b"0015",), (b"0",), (b"0990",), (b"9",), (b"0500",)], "key binary")
    got = {bytes(r["key"]): r["floor_offset"] for r in reads.floor_lookup(idx, probes).collect()}
    assert got == {b"0000": 0, b"0015": 10, b"0": 0, b"0990": 990, b"9": 990, b"0500": 500}
    ordered = spark.createDataFrame([(1, b"a"), (2, b"c"), (3, b"b")], "ord long, key binary")
    assert [r["ord"] for r in reads.unsorted(ordered).collect()] == [3]


def test_plans_push_filters_and_limit_groups(spark, tmp_path):
    log(spark, ("P", "a", 1), ("P", "b", 2)).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    newest = visibility.latest_points(visibility.points(df).filter(visibility.in_bounds(F.col("key"), b"a", b"b")))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # pushed filters in full
    plan = newest._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [" in plan and plan.count(">= 0x61") == 2 and plan.count("< 0x62") == 2  # in the filter and the scan
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1
