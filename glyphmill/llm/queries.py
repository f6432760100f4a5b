"""One query for each operator of this folder, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_topk, lm_score, packing, permutation_ann, secret_scan, sentencepiece_nbest, sharding, simhash, toxicity, url_filter

#: Shards of op10; names as a storage layout would have them.
SHARDS = [f"shard-{i:03d}" for i in range(100)]

#: Vocabulary of op9: a public tokenizer's file, which every worker finds under this path.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: The vector searches take as queries every row whose id this divides, against all rows.
QUERY_EVERY = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, sf_dir, "embeddings"), k=10, query_every=QUERY_EVERY)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.score_urls(_table(spark, sf_dir, "pages"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_ann.neighbours(_table(spark, sf_dir, "embeddings"), k=10, query_every=QUERY_EVERY)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_documents(_table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode_n_best(_table(spark, sf_dir, "documents"), PIECES, n=3)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"), SHARDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_exact_topk, op2_secret_scan, op3_url_filter, op4_simhash_dedup, op5_toxicity, op6_permutation_ann, op7_lm_score, op8_packing, op9_sentencepiece_nbest, op10_sharding)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_topk": exact_topk.top_k_sql(k=10, query_every=QUERY_EVERY),
        "op7_lm_score": lm_score.score_sql(),
        "op10_sharding": sharding.place_sql(SHARDS),
    }
