"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.kneser_ney import train_and_score

    return train_and_score(_documents(spark, sf_dir))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.ngram_join import similar

    return similar(_documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.license_scan import scan

    return scan(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.common import remainder
    from tracelake.llm.toxicity import score, train

    docs = _documents(spark, sf_dir)
    scores = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.secret_scan import scan

    return scan(_documents(spark, sf_dir))


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.telephony_audio import digest

    return digest(_documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tracelake.llm.bpe import digest

    return digest(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.source_mixing import mix

    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.html_extraction import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.quality_rules import quality

    return quality(_documents(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tracelake.llm.chat_format import digest

    rows, said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"), "</s>[INST] ok [/INST]"
    control = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return digest(rows.union(control), public_tokenizers.path("byte_bpe_50k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.whitening import components

    return components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.filter_audit import interactions

    return interactions(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kneser_ney, op2_ngram_join, op3_license_scan, op4_toxicity, op5_secret_scan, op6_telephony_audio, op7_bpe, op8_source_mixing, op9_html_extraction, op10_quality_rules, op11_chat_format, op12_whitening, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    from tracelake.llm import filter_audit, quality_rules

    return {"op10_quality_rules": quality_rules.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
