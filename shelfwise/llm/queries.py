"""The registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import oracles
from shelfwise.llm.conversations import structure
from shelfwise.llm.decontaminate import contamination
from shelfwise.llm.html_text import extracted
from shelfwise.llm.jaccard_join import jaccard_join
from shelfwise.llm.licenses import licenses
from shelfwise.llm.mixing import mixed
from shelfwise.llm.near_dups import near_duplicates
from shelfwise.llm.pii import personal_data
from shelfwise.llm.quality import quality, trained_chain
from shelfwise.llm.shipping import ship
from shelfwise.llm.spelling import spelling_variants
from shelfwise.llm.tables import doc_fold, table
from shelfwise.llm.token_counts import document_token_counts
from shelfwise.llm.topk import exact_top_k
from shelfwise.llm.toxicity import toxicity, trained_machine

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "kept"
    )


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return personal_data(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    documents = table(spark, sf_dir, "documents")
    machine = trained_machine(documents, table(spark, sf_dir, "labels"), doc_fold(4) != 2)
    scored = toxicity(documents, machine)
    return scored.select("doc_id", F.coalesce(doc_fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return extracted(table(spark, sf_dir, "pages"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    documents = table(spark, sf_dir, "documents")
    chain = trained_chain(documents, table(spark, sf_dir, "labels"), doc_fold(5) != 0)
    scored = quality(documents, chain)
    held_out = F.coalesce(doc_fold(5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return document_token_counts(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join(table(spark, sf_dir, "documents"), shingle_words=4, percent=85)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return structure(table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spelling_variants(table(spark, sf_dir, "documents"), misspell=97)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = [
        op1_mixing,
        op2_personal_data,
        op3_near_duplicates,
        op4_toxicity,
        op5_main_text,
        op6_exact_top_k,
        op7_quality,
        op8_decontamination,
        op9_token_counts,
        op10_licenses,
        op11_jaccard_join,
        op12_conversations,
        op13_spelling,
        pipeline,
    ]
    return {query.__name__: query for query in own}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
