import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import minhash
from siltstone.llm.graph import components
from siltstone.llm.common import Scratch
from siltstone.llm.minhash import containments, distinct_texts, least_jaccard, near_duplicates, partitions, tune, word_hashes
from siltstone.llm.queries import queries


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts, ratio=2.0, threshold=0.8):
    """Class (least id) of each text: components of the containment links, by an inverted index."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i in sorted(sets):
        shared = {}
        for s in sets[i]:
            for j in index.get(s, ()):
                shared[j] = shared.get(j, 0) + 1
        for j, k in shared.items():
            a, b = sorted((len(sets[i]), len(sets[j])))
            if b <= ratio * a and k >= math.ceil(threshold * a - 1e-9):
                x, y = sorted((find(i), find(j)))
                root[y] = x
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    return {i: find(i) for i in sets}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op4_containment_ensemble"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    want = brute(dict(zip(docs.doc_id, docs.text)))
    own = dict(zip(got.doc_id, got.class_id))
    assert set(own) == set(want)
    missed = [d for d in want if own[d] != want[d]]
    assert len(missed) <= 0.0005 * len(want), missed[:5]
    assert (got[got.keep].doc_id == got[got.keep].class_id).all() and got.keep.sum() == got.class_id.nunique()


@pytest.mark.parametrize("small, part, block", [(8, 1 << 16, 1024), (2, 1 << 16, 7), (8, 10, 1024), (2, 10, 5)])
def test_large_buckets_lose_no_link(spark, monkeypatch, small, part, block):
    # families of edited copies that share a long passage: their buckets mix; small parts and blocks divide them
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "PART_ROWS", part)
    monkeypatch.setattr(minhash.cross_pairs, "__defaults__", (block,))
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared, texts = [word() for _ in range(60)], {}
    for f in range(12):
        base = shared + [word() for _ in range(rng.choice([15, 25, 60]))]
        for _ in range(15):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = word()
            texts[len(texts)] = " ".join(w + ([word() for _ in range(rng.choice([0, 0, 30]))]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == brute(texts)


def pairs_at_the_threshold(number):
    """Texts 2i and 2i + 1: 32 of 40 shingles of the one lie in the 80 of the other, which the bands miss now and then."""
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n)]
    texts = {}
    for i in range(number):
        own = words(44)
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join(own[:36] + words(48))
    return texts


def test_no_link_at_the_threshold_is_left_out(spark):
    texts = pairs_at_the_threshold(800)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d in texts}


def test_links_that_the_signatures_rule_out_are_found(spark, monkeypatch):
    monkeypatch.setattr(minhash, "may_link", lambda n1, x1, n2, x2, threshold, ratio: np.zeros(np.broadcast(n1, n2).shape, dtype=bool))
    texts = pairs_at_the_threshold(40)
    texts |= {100 + i: " ".join([*texts[0].split()[: 44 - i], "x"]) for i in range(40)}  # at one shingle: more than 32 sets
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts)


def test_containments_beyond_the_ratio_are_reported(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    notice = words(44)
    data = [(1, " ".join(notice)), (2, " ".join(notice)), (3, " ".join(notice[:-2] + ["x", "y"])), (4, "read on"), (5, None)]
    data += [(10 + i, " ".join(words(60) + notice[: 36 - (i % 2)] + words(60))) for i in range(50)]  # 32 and 31 of 40 shingles
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_duplicates(df).collect()}
    assert [got[d]["n_containers"] for d in (1, 2, 3, 4, 5)] == [25, 25, 25, 0, 0] and all(got[d]["n_containers"] == 0 for d in got if d >= 10)
    assert [got[d]["class_id"] for d in (1, 2, 3, 4)] == [1, 1, 1, 4] and all(got[d]["class_id"] == d for d in got if d >= 10)
    pairs = {(r["doc_id"], r["container_id"]): r["containment"] for r in containments(df).collect()}
    assert pairs == {(d, 10 + i): 0.8 for d in (1, 3) for i in range(0, 50, 2)}


def shuffled_bytes(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_texts_that_are_like_no_other_stay_where_they_are(spark):
    rng = random.Random(11)
    data = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1500))) for i in range(300)]
    data.append((300, data[0][1] + " more"))
    df = spark.createDataFrame(data, "doc_id long, text string")
    before, limit = shuffled_bytes(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_duplicates(df, columns=["doc_id"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {r["doc_id"]: r["class_id"] for r in got} == {d: d % 300 for d, _ in data}
    moved = sum(v for k, v in shuffled_bytes(spark).items() if k not in before)
    assert moved < 1.3 * sum(len(t) for _, t in data), moved  # the shingles' 5 bytes a word once, and the rest is small


def test_kept_rows_are_written_without_an_exchange(spark, tmp_path):
    data = [(d, t, d, "x", d % 2 == 0) for d, t in pairs_at_the_threshold(20).items()] + [(None, "a b", 1, "y", True), (None, "A b", 1, "y", True), (7000, None, 1, "y", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, rid int, row string, keep boolean")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = corpus_pipeline.near_dedup(spark, df, "")
        known = shuffled_bytes(spark)
        before.write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum(v for k, v in shuffled_bytes(spark).items() if k not in known) == 0
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == df.columns
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(([(d, t, *x) for d, t, *x in data if d is not None and (d >= 7000 or d % 2 == 0)] + [r for r in rows if r[0] is None]), key=str)
    assert [r[2:] for r in rows if r[0] is None] == [(1, "y", True)]
    assert sorted(r["doc_id"] or -1 for r in distinct_texts(df.drop("keep")).collect()) == sorted(r[0] or -1 for r in rows)


def plans(spark):
    """The number of joins of each query so far that the driver keeps the plan of."""
    store = spark._jsparkSession.sharedState().statusStore()
    found, joins = store.executionsList(), {}
    for i in range(found.size()):
        nodes = store.planGraph(k := found.apply(i).executionId()).allNodes()
        joins[k] = sum(nodes.apply(j).name().endswith("Join") for j in range(nodes.size()))
    return joins


def test_driver_holds_few_and_small_plans(spark):
    # near copies, and passages of texts twice their size: pairs to check on either way
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    data = []
    for i in range(60):
        base = [word() for _ in range(60)]
        data += [(4 * i, " ".join(base)), (4 * i + 1, " ".join(base[:-1] + [word()])), (4 * i + 2, " ".join(base + [word() for _ in range(120)])), (4 * i + 3, word())]
    before = plans(spark)
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] - (r["doc_id"] % 4 == 1) and r["n_containers"] == (r["doc_id"] % 4 < 2) for r in got)
    joins = {k: n for k, n in plans(spark).items() if k not in before}
    assert max(joins.values()) <= 8 and len(joins) <= 60, (max(joins.values()), len(joins))


@pytest.mark.parametrize("words", [1 << 20, 0])
def test_chosen_rows(spark, words):
    ids = [0, 1, 63, 64, 127, (5 << 33) + 62, (5 << 33) + 63, 1 << 62]
    rows = spark.createDataFrame([(i + k, f"t{i + k}") for i in ids for k in (0, 1, 64)], "rid long, raw string").distinct()
    got = minhash.chosen(rows, spark.createDataFrame([(i,) for i in ids + ids], "rid long"), Scratch(spark), "test", words)
    assert sorted(r["rid"] for r in got.collect()) == ids and got.columns == ["rid", "raw"]


@pytest.mark.parametrize("family", [256, 3])
def test_pairs_are_checked_by_families(spark, family):
    pairs = [(0, 1), (1, 2), (0, 2), (10, 11), (20, 21), (21, 22), (22, 23), (20, 24)]
    scratch = Scratch(spark)
    got = {(r["a"], r["b"]): r["bucket"] for r in minhash.gathered(spark.createDataFrame(pairs, "a long, b long"), scratch, "test", family).collect()}
    assert got == {(a, b): (a // 10 * 10 if family > 5 or a < 20 else b) for a, b in pairs}


def test_components(spark):
    n = 300
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 4000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + i] == 1000 for i in range(50)) and got[5000] == 4000


def test_tuning_reaches_its_recall():
    for n in (1, 3, 4, 5, 17, 64, 700, 20_000):
        for grid, number in partitions(n, 2.0):
            low, high = minhash.bounds(grid, number, 2.0)
            assert low <= n <= high
            j = least_jaccard(low, high, 0.8, 2.0)
            b, r = tune(j)
            assert b * r <= minhash.FUNCTIONS and 1 - (1 - j**r) ** b >= 0.985
    for q in range(1, 400):  # any two sizes within the ratio share a partition
        assert set(partitions(q, 2.0)) & set(partitions(2 * q, 2.0))


def test_word_hashes_are_position_free():
    h, n = word_hashes([b"aa bb\x0baa", b"", b" aa\n", b"b aa"])
    assert list(n) == [3, 0, 1, 2] and h[0] == h[2] == h[3] == h[5] and len(np.unique(h)) == 3


def test_edge_rows(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(20_000))
    data = [(1, "a b c", 0), (2, "A  b\nc", 0), (3, None, 0), (4, None, 0), (5, "", 0), (None, long, 0), (7, long + " end", 0), (7, long + " end", 0), (8, "a b d", 0)]
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string, class_id int")).collect()
    assert len(got) == 9 and sum(r["keep"] for r in got) == 6
    cls = {}
    for r in got:
        cls.setdefault(r["doc_id"], set()).add((r["class_id"], r["class_size"]))
    assert cls[1] == cls[2] == {(1, 2)} and cls[None] == cls[7] == {(7, 3)} and cls[3] == {(3, 1)} and cls[8] == {(8, 1)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 1, 2, 3, 4)], "doc_id long, text string, rid int, row int, class int, n int")
    got = near_duplicates(df).collect()
    assert [[r[c] for c in ("rid", "row", "class", "n")] for r in got] == [[1, 2, 3, 4]] * 2 and sum(r["keep"] for r in got) == 1
