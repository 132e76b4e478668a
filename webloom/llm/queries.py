"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import chat, licenses, mixing, urls, warc
from webloom.llm.decontaminate import contamination
from webloom.llm.media import store_and_read
from webloom.llm.near_dedup import near_duplicates
from webloom.llm.substring import repeated_passages
from webloom.llm.toxicity import toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(_docs(spark, sf_dir)).drop("error")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.as_files(_docs(spark, sf_dir)))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_docs(spark, sf_dir))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.digests(chat.flatten(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_minhash_near_dedup, op3_warc_round_trip, op4_toxicity, op5_benchmark_decontamination, op6_license_scan, op7_url_filters, op8_source_mixing, op9_substring_dedup, op10_chat_formatting)}
ORACLE_SQL: dict[str, str] = {"op3_warc_round_trip": warc.WARC_SQL, "op8_source_mixing": mixing.MIX_SQL, "op10_chat_formatting": chat.CHAT_SQL}
