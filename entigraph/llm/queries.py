"""The registered query of each operator: ``opN_<name>(spark, sf_dir)``, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, clustering, decontaminate, lexical, linededup, mixing, secrets, simhash, substrings, tokens, toxicity, urlfilter, warc
from .common import documents, shared_path


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(documents(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir), shared_path(spark, "secret-ledger"))
    findings = F.col("findings")
    counts = [secrets.count_of(findings, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    spans = secrets.digest(findings)
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.7)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(documents(spark, sf_dir), tokenizer_path())


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_frequent_lines(documents(spark, sf_dir), least_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(documents(spark, sf_dir), least_words=50)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), k=4, most=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(documents(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64, salt="1")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), k=20)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(documents(spark, sf_dir, "pages"), urlfilter.rules_of(urlfilter.NAMED, urlfilter.HOSTS))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_warc_source": op2_warc_source,
    "op3_secret_scan": op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_token_output": op5_token_output,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_source_mixing": op7_source_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_lexical_search": op12_lexical_search,
    "op13_url_filters": op13_url_filters,
}

ORACLE = {
    "op2_warc_source": warc.ORACLE_SQL,
    "op3_secret_scan": secrets.ORACLE_SQL,
    "op8_line_dedup": linededup.ORACLE_SQL,
    "op11_centroid_clustering": clustering.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
    "op13_url_filters": urlfilter.ORACLE_SQL,
}
