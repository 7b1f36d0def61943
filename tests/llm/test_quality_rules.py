import math
import re
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import quality_rules as rules
from siltstone.llm.ngrams import HashArray, slabs
from siltstone.llm.quality_rules import KneserNey, base_features, quality_rules
from siltstone.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup, old = (text or "").split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in old
            old.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_query_base_and_verdicts(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op6_ngram_quality_rules"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert set(got.index) == set(docs.index)
    for d, t in docs.text.items():
        r = got.loc[d]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got.join(labels.set_index("doc_id"), how="inner")
    m = m[~m.base_failed]
    assert m[m.quality == 1].kept.mean() > 0.995 and m[m.quality == 0].kept.mean() < 0.1


class BruteModel:
    """Interpolated modified Kneser-Ney over byte 5-grams, in dictionaries."""

    def __init__(self, raws, order=5):
        self.order, levels = order, [Counter()]
        for raw in raws:
            x = bytes(order - 1) + raw + b"\0"
            levels[0].update(x[i : i + order] for i in range(len(x) - order + 1))
        for n in range(order - 1, 0, -1):
            levels.append(Counter(g[1:] for g in levels[-1]))
        self.levels = levels[::-1]
        self.discount, self.total, self.kinds = [], [], []
        for level in self.levels:
            n = [0, *(sum(c == k for c in level.values()) for k in (1, 2, 3, 4))]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
            self.discount.append([0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k, 0.05), k - 0.05) for k in (1, 2, 3)])
            total, cut = Counter(), Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                cut[g[:-1]] += self.discount[-1][min(c, 3)]
            self.total.append(total)
            self.kinds.append(cut)
        self.known = {}

    def prob(self, gram):
        if not gram:
            return 1 / 257
        if gram not in self.known:
            n, context = len(gram) - 1, gram[:-1]
            p = self.prob(gram[1:])
            if context in self.total[n]:
                c = self.levels[n].get(gram, 0)
                p = (c - self.discount[n][min(c, 3)] + self.kinds[n][context] * p) / self.total[n][context]
            self.known[gram] = p
        return self.known[gram]

    def log10_perplexity(self, raw):
        x = bytes(self.order - 1) + raw + b"\0"
        return -sum(math.log10(self.prob(x[i : i + self.order])) for i in range(len(raw) + 1)) / (len(raw) + 1)


def test_perplexities_and_verdicts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["lang"], (r["text"] or "").encode()) for r in docs.collect()]
    rows += [(10_000, "en", b"very long text, told again " * 20_000), (10_001, None, b"# $ % & | " * 30), (10_002, "en", b"")]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame([(d, g, x.decode()) for d, g, x in rows], "doc_id long, lang string, text string")).collect()}
    few = lambda x: 50 * sum(x.count(c) for c in b"#*$%&|<>") <= len(x)
    for lang in {g for _, g, _ in rows}:
        own = [(d, x) for d, g, x in rows if g == lang]
        model = BruteModel([x for _, x in own if few(x)] or [x for _, x in own])
        value = {d: model.log10_perplexity(x) for d, x in own}
        failed = {d: (lambda w: w[0] < 20 or 100 * w[4] > 30 * w[0])(brute(x.decode())) for d, x in own}
        good = sorted(math.floor(value[d] * 2000 + 0.5) for d, _ in own if not failed[d])
        middle = lambda v: sorted(v)[math.ceil(len(v) / 2) - 1]
        mid = middle(good) if good else None
        for d, x in own:
            r = got[d]
            assert abs(r["log10_perplexity"] - value[d]) < 1e-4 and r["base_failed"] == failed[d]
            kept = False
            if good and not failed[d]:
                slack = 10 * 1.4826 * middle([abs(b - mid) for b in good]) / 2000 + 3 / math.sqrt(len(x) + 1)
                away = abs(value[d] - mid / 2000) - slack
                kept = r["kept"] if abs(away) < 0.01 else away <= 0  # a bin's width either way
            assert r["kept"] == kept


def test_odd_spaces_and_widths():
    texts = ["a b c d\x1ce\x85f", "x " * 9, "\n\n a\n a\na\n", "", "漢字 \U0001f600 é"]
    got = base_features([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(got[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t)


@pytest.mark.parametrize("limit", [4, 7, 1 << 20])
def test_slabs_cover_whole_texts(limit):
    raws = [b"hello world", b"", b"abc", b"z" * 30]
    found = [[] for _ in raws]
    for grams, starts, docs in slabs(raws, 3, limit):
        for s, e, d in zip(starts, np.r_[starts[1:], len(grams)], docs):
            found[d].extend(grams[s:e].tolist())
    for raw, got in zip(raws, found):
        padded = b"\0\0" + raw + b"\0"
        assert got == [int.from_bytes(padded[i : i + 3], "big") for i in range(len(raw) + 1)]


def test_hash_array_finds_exactly():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 5000)).astype(np.uint64)
    table = HashArray(keys)
    at = table.find(keys)
    assert (keys[table.order[at]] == keys).all()
    assert (table.find(keys + np.uint64(2**41)) < 0).all()


def test_model_sums_to_one():
    raw = b"the cat sat on the mat and the dog sat on the cat " * 3
    levels, order = [], 3
    grams = np.concatenate([g for g, _, _ in slabs([raw], order)])
    k, n = np.unique(grams, return_counts=True)
    levels = [{"g": (k, n)}]
    for m in (2, 1):
        low = np.unique(levels[0]["g"][0])
        k, n = np.unique(low & np.uint64((1 << 8 * m) - 1), return_counts=True)
        levels.insert(0, {"g": (k, n)})
    model = KneserNey(levels)
    for context in (b"th", b"zz", b"e "):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        assert abs((10.0 ** model.log10("g", keys).astype(float)).sum() + 1 / 257 - 1) < 0.02


def test_edge_rows(spark):
    good = "The quick brown fox jumps over a lazy dog while many other animals watch from under the old oak tree near our river bank today"
    data = [(1, good, "en", 5), (2, None, "en", 1), (3, "", None, 1), (None, good, "en", 1), (1, good, "en", 5), (4, "w " * 60_000, "xx", 2)]
    got = quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, kept int")).collect()
    assert len(got) == 6
    assert sorted((r["doc_id"] or 0, r["base_failed"]) for r in got) == [(0, False), (1, False), (1, False), (2, True), (3, True), (4, True)]
    assert len({r["kept"] for r in got if r["text"] == good}) == 1
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_model_keeps_every_gram_beside_a_hot_language(spark, monkeypatch):
    rng, seen = np.random.default_rng(4), {}
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8)
    hot = [bytes(letters[rng.integers(0, 36, 250_000)]) for _ in range(20)]
    small = b"unto bread sky"
    monkeypatch.setattr(rules, "KneserNey", lambda levels: seen.update(top=levels[-1]) or "fitted")
    rows = [("hot", bytearray(r)) for r in hot] + [("small", bytearray(small))]
    assert rules.fit(spark.createDataFrame(rows, "g string, raw binary")) == "fitted"
    for g, raws in (("hot", hot), ("small", [small])):
        want, n = np.unique(np.concatenate([x for x, _, _ in slabs(raws, 5)]), return_counts=True)
        assert np.array_equal(seen["top"][g][0], want) and np.array_equal(seen["top"][g][1], n)
    assert len(seen["top"]["hot"][0]) > 1 << 22


def test_languages_without_reference_texts(spark):
    good = "The quick brown fox jumps over a lazy dog while many other animals watch from under the old oak tree near our river bank today"
    code = "if (*p && *q) { a = *p | *q; } else { b = *p & *q; } for (i = 0; i < n; i++) { sum += *x * *y; } while (a > b) { a = a | b; }"
    data = [(i, good, "en") for i in range(3)] + [(9, code, "c"), (10, code, "c"), (11, code, None)]
    schema = "doc_id long, text string, lang string"
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(data, schema)).collect()}
    alone = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(data[3:], schema)).collect()}
    assert len(got) == len(data) and set(alone) == {9, 10, 11}
    for d in (9, 10, 11):
        assert got[d]["kept"] and not got[d]["base_failed"] and got[d]["lower"] < 10 ** got[d]["log10_perplexity"] < got[d]["upper"]
        assert alone[d]["log10_perplexity"] == got[d]["log10_perplexity"]


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(1, "a b", "en", 1, 2, 3, 4, 5)], "doc_id long, text string, lang string, _g int, g int, mid int, raw int, kept int")
    got = quality_rules(df).first()
    assert [got[c] for c in ("_g", "g", "mid", "raw")] == [1, 2, 3, 4] and got["kept"] is False
