"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import (
    bpe,
    centroids,
    chat_format,
    curriculum,
    decontaminate,
    exact_dedup,
    jaccard_join,
    line_dedup,
    main_text,
    secret_scan,
    token_counts,
    toxicity,
    turn_repair,
)

CATALOGUE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    CATALOGUE[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op5_line_dedup(spark, sf):
    rows = line_dedup.dedup_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_exact_dedup(spark, sf):
    return exact_dedup.verdicts(_table(spark, sf, "documents"))


@query
def op1_jaccard_join(spark, sf):
    return jaccard_join.similar_components(_table(spark, sf, "documents"))


@query
def op10_decontaminate(spark, sf):
    return decontaminate.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


@query
def op8_toxicity(spark, sf):
    return toxicity.score(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query
def op2_bpe(spark, sf):
    return bpe.round_trip(_table(spark, sf, "documents"))


@query
def op4_main_text(spark, sf):
    pages = main_text.extract(_table(spark, sf, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op9_chat_format(spark, sf):
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_turns(chat_format.rows_to_turns(rows.unionByName(more))))


@query
def op3_token_counts(spark, sf):
    return token_counts.token_counts(_table(spark, sf, "documents"))


@query
def op6_secret_scan(spark, sf):
    found = secret_scan.scan(_table(spark, sf, "documents"))
    return found.select("doc_id", "place", F.sha2("secret", 256).alias("secret_sha256"), "score")


@query
def op13_centroids(spark, sf):
    return centroids.cluster(_table(spark, sf, "embeddings"))


@query
def op11_curriculum(spark, sf):
    return curriculum.mix(_table(spark, sf, "documents"))


@query
def op12_turn_repair(spark, sf):
    return turn_repair.digests(*turn_repair.repair(turn_repair.damage(_table(spark, sf, "conversations")), "times"))
