import re

import corpus_pipeline
from siltstone.llm.mixing import targets
from siltstone.llm.quality_rules import quality_rules
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_suffix_dedup import brute as repeat_brute

SF = "/root/testdata/sf0.01"


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, [docs.toPandas()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
        seen.append(docs.toPandas())
    raw, good, near, clean, mixed, pieces = seen
    verdict = quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert set(good.doc_id) == set(verdict[verdict.kept].doc_id) and len(good) < len(raw)
    classes = near_brute(dict(zip(good.doc_id, good.text)))
    assert set(near.doc_id) == set(classes.values())
    near = near.sort_values("doc_id")
    want = repeat_brute([(d, t.encode()) for d, t in zip(near.doc_id, near.text)])
    left = {d for d, t in zip(near.doc_id, near.text) if want[d][0] < len(t.encode())}
    assert set(clean.doc_id) == left and (clean.n_chars == clean.text.str.len()).all()
    before = dict(zip(near.doc_id, near.text))
    for d, t in zip(clean.doc_id, clean.text):
        assert t == before[d] if not want[d][0] else len(t.encode()) <= len(before[d].encode()) - want[d][0]
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in zip(clean.doc_id, clean.text)}
    sources = sorted(clean.source.unique())
    sums = [sum(size[d] for d in clean[clean.source == s].doc_id) for s in sources]
    for s, goal in zip(sources, targets(sums, [i % 3 + 1 for i in range(len(sources))], 3)):
        part = mixed[mixed.source == s]
        assert abs(sum(size[d] for d in part.doc_id) - goal) <= max(size.values()) / 2 + 1
    assert mixed.groupby("doc_id").size().max() <= 3
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert len(got) == len(pieces)
    assert sorted(got[["doc_id", "start", "length", "ids_crc32"]].values.tolist()) == sorted(pieces[["doc_id", "start", "length", "ids_crc32"]].values.tolist())
    once = pieces[~pieces.doc_id.duplicated(keep=False) | (pieces.doc_id.map(mixed.groupby("doc_id").size()) == 1)]
    single = {d: t for d, t in zip(mixed.doc_id, mixed.text) if (mixed.doc_id == d).sum() == 1}
    assert set(once[once.doc_id.isin(single)].doc_id) == set(single)
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        assert part.length.sum() <= 2048 and part.offset.iloc[0] == 0


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_lazy_results_outlive_later_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = corpus_pipeline.near_dedup(spark, docs, SF)
    two = corpus_pipeline.source_mix(spark, one, SF)
    assert 0 < one.count() <= docs.count() and {r["doc_id"] for r in two.select("doc_id").collect()} <= {r["doc_id"] for r in one.select("doc_id").collect()}
