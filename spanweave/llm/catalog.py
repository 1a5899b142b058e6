"""The registered queries opN_<name> and pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from spanweave.llm import crosstokens, jaccard, licenses, lines, mixing, packing, quality, secrets, spelling, suffixes, syncmers, topk, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_closed_syncmers": lambda spark, d: syncmers.fingerprint_digest(_documents(spark, d)),
        "op2_nb_svm_quality": lambda spark, d: quality.score_digest(_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op3_line_dedup": lambda spark, d: lines.line_dedup_digest(_documents(spark, d)),
        "op4_sainte_lague_mix": lambda spark, d: mixing.mix_digest(_documents(spark, d)),
        "op5_arc_to_warc": lambda spark, d: warc.warc_round_trip(spark.read.parquet(f"{d}/pages.parquet")),
        "op6_norm_bucket_topk": lambda spark, d: topk.topk_digest(spark.read.parquet(f"{d}/embeddings.parquet")),
        "op7_license_scan": lambda spark, d: licenses.license_digest(_documents(spark, d)),
        "op8_ngram_jaccard": lambda spark, d: jaccard.jaccard_join(_documents(spark, d)),
        "op9_configuration_packing": lambda spark, d: packing.pack(_documents(spark, d)),
        "op10_secret_scan": lambda spark, d: secrets.secret_digest(_documents(spark, d)),
        "op11_suffix_dedup": lambda spark, d: suffixes.suffix_dedup_digest(_documents(spark, d)),
        "op12_spelling_variants": lambda spark, d: spelling.spelling_variants(_documents(spark, d)),
        "op13_cross_tokenizer": lambda spark, d: crosstokens.align_tokens(_documents(spark, d)),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = {"op6_norm_bucket_topk": topk.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in known.items() if sql}
