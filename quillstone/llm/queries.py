"""The queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dart_minhash, decontaminate, license_scan, line_runs, mixing, ngram_resample, pii_crf, quality_lm, secret_forest, token_alignment, token_store, toxicity_chain, url_trust


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _with_id(df: DataFrame, *names: str, id_col: str = "doc_id") -> DataFrame:
    return df.select(F.col("row").getField(id_col).alias(id_col), *names)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    found = license_scan.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return _with_id(found, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document; the lowest id of a class stays."""
    return dart_minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "stays")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, perplexity and verdict of every document."""
    judged = quality_lm.quality(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return _with_id(judged, *quality_lm.STATS, "base_failed", "kept", "perplexity")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = pii_crf.find(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return _with_id(found, *[f"n_{k}" for k in pii_crf.KINDS], "base_sha256", "spans")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return _with_id(mixed, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdicts of the chain for every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity_chain.score(docs, toxicity_chain.train(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])
    return _with_id(scored, *[f"p_{c}" for c in toxicity_chain.CATEGORIES], *[f"is_{c}" for c in toxicity_chain.CATEGORIES])


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return _with_id(url_trust.judge(_table(spark, sf_dir, "pages"), keep=["page_id"]), "host", "path", "rule", "verdict", id_col="page_id")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that they contain."""
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return _with_id(found, "item_id", "n_shared", "n_item")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every document, with the forest's probability and verdict."""
    return _with_id(secret_forest.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"]), "start", "end", "probability", "is_secret", "sha256")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number of ids and checksum of every document in the token store."""
    return token_store.store_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those it loses, and the checksum of what is left."""
    found = line_runs.dedup(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return _with_id(found, "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document, drawn towards the benchmark's texts."""
    drawn = ngram_resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return _with_id(drawn, "n_features", "weight", "score", "rank")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document between a byte-level and a piece tokenizer."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(_table(spark, sf_dir, "documents"), *paths)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    return {
        f.__name__: f
        for f in (
            op1_license_scan,
            op2_near_duplicates,
            op3_quality_rules,
            op4_personal_data,
            op5_source_mix,
            op6_toxicity,
            op7_url_filter,
            op8_benchmark_leaks,
            op9_secret_scan,
            op10_token_store,
            op11_line_dedup,
            op12_target_resample,
            op13_token_alignment,
        )
    }


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, for the queries that SQL can express."""
    return {"op5_source_mix": mixing.oracle_sql(), "op8_benchmark_leaks": decontaminate.oracle_sql(), "op11_line_dedup": line_runs.oracle_sql(), "op12_target_resample": ngram_resample.oracle_sql()}
