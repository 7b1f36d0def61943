"""The corpus pipeline: from raw documents to packed token sequences.

Every stage works on all that the one before kept; each result is written as Parquet and
read again as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, table
from siltstone.llm.minhash import distinct_texts
from siltstone.llm.mixing import mix
from siltstone.llm.packing import pack
from siltstone.llm.quality_rules import quality_rules
from siltstone.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity bands."""
    return quality_rules(docs, scratch=scratch).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each class of near-duplicates, that with the least doc_id."""
    return distinct_texts(docs, scratch=scratch).select(*docs.columns)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier; emptied ones go."""
    out = remove_repeats(docs, columns=[c for c in docs.columns if c != "text"], scratch=scratch)
    out = out.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})
    return out.filter("n_removed < n_bytes").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Each document as often as the mix takes it."""
    out = mix(docs, scratch=scratch).filter("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), scratch=scratch)


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("repeat removal", repeat_removal),
    ("source mix", source_mix),
    ("packing", packing),
]
#: The models and tokenizers are not SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir.

    A stage's scratch tables go once its result is written. A stage called by itself leaves them to
    its caller: they go with the driver's process, or by `release(spark)`.
    """
    results, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        own = Scratch(spark)
        docs = results.keep(stage(spark, docs, sf_dir, own), f"stage{i}")
        own.drop()
        if i:
            results.drop(f"stage{i - 1}")
    return docs
