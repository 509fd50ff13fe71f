"""The corpus pipeline: five stages from raw documents to a training mix.

Each stage takes the documents its predecessor kept and returns the documents it keeps,
with the same columns; the last adds topic, token count and probability. Between the
stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.decontaminate import decontaminated
from shelfwise.llm.mixing import sampled
from shelfwise.llm.near_dups import deduplicated
from shelfwise.llm.pii import masked
from shelfwise.llm.shipping import ship
from shelfwise.llm.tables import doc_fold, stage, table
from shelfwise.llm.toxicity import trained_machine, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    ship(spark)
    machine = trained_machine(docs, table(spark, sf_dir, "labels"), doc_fold(4) != 2)
    return without_toxic(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship(spark)
    return deduplicated(docs, shingle_words=2, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    ship(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    ship(spark)
    return masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that source, language and topic meet their target weights."""
    return sampled(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: The toxicity machine and the random field are trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
