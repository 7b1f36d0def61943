"""The opN_ queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table


def op1_byte_conv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_net import classify

    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return out.select("doc_id", "held_out", "score", "predicted")


def op2_histogram_sort_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import histogram_sort

    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32("text"))  # null for a null text
    out = histogram_sort(docs, shards=24, columns=["doc_id", "text_crc32", "text"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_pitman_yor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpylm import score

    return score(table(spark, sf_dir, "documents"))


def op4_containment_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), columns=["doc_id"], keep=False).drop("kept", "kept_text")


def op6_ngram_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log10_perplexity", "n_bytes", "lower", "upper")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    out = license_scan(table(spark, sf_dir, "documents").withColumn("path", path), columns=["doc_id", "path"])
    return out.select("doc_id", "path", "own_license", "score", "license_file", "license", "licensed_by")


def op8_additive_quantisation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=False)


def op10_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def queries() -> dict:
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}

    def wrapped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return run

    return {k: wrapped(f) for k, f in own.items()}


def oracle_sql() -> dict[str, str]:
    from . import licenses, mixing, sharding, suffix_dedup

    return {
        "op2_histogram_sort_sharding": sharding.oracle(),
        "op5_suffix_array_dedup": suffix_dedup.oracle(),
        "op7_license_scan": licenses.oracle(),
        "op10_pareto_mixing": mixing.oracle(),
    }
