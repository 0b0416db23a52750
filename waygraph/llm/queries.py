"""The registered query of each operator, with its production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waygraph.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.ngram_join import similarity_groups

    return similarity_groups(table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.pii import personal_data, span_digest

    return span_digest(personal_data(table(spark, sf_dir, "documents")))


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("uid")


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from waygraph.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), percent=80)
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed=2024)


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from waygraph.llm.bpe import bpe_decode, bpe_encode

    vocabulary = "byte_bpe_50k.tiktoken"
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waygraph.llm.clustering import sorted_means

    return sorted_means(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256, seed=2)
