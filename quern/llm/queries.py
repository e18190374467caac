"""The queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import arc_convert, decontaminate, divergence, line_dedup, lm_score, mixing, near_dup, pii, quality_rules, sharding, token_planes, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op1_redirect_filter(_table(spark, sf_dir, "pages"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_planes.op2_token_planes(_table(spark, sf_dir, "documents"), str(public_tokenizers.path(token_planes.TOKENIZER)))


def op3_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3_entropy_balance(_table(spark, sf_dir, "documents"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_convert.op4_arc_to_warc(_table(spark, sf_dir, "pages"))


def op5_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.op5_backoff_automaton(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op6_quality_rules(_table(spark, sf_dir, "documents"))


def op7_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op7_segment_edit_join(_table(spark, sf_dir, "documents"))


def op8_multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.op8_multi_index_minhash(_table(spark, sf_dir, "documents"))


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9_sampled_splitters(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10_decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op11_source_divergence(_table(spark, sf_dir, "documents"))


def op12_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op12_pii_boosting(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13_whitening(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_redirect_filter, op2_token_planes, op3_entropy_balance, op4_arc_to_warc, op5_backoff_automaton, op6_quality_rules, op7_segment_edit_join, op8_multi_index_minhash, op9_sampled_splitters, op10_decontaminate, op11_source_divergence, op12_pii_boosting, op13_whitening)}
