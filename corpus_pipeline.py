"""A corpus pipeline: each stage is written as Parquet and reread as the next one's documents.

All stages take ``docs`` with the columns of documents and ignore others, also ones named like columns of their own; all
but the last return the columns of documents. Nulls in any column, empty and very long texts, ties and repeated rows
are treated as each stage says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetra.llm import jaccard, linededup, mixing, packing, toxicity
from kinetra.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go; labels of documents that are not in ``docs`` teach nothing. Null and empty
    texts score by the constants alone and stay while most labelled documents are clean; rows that repeat a text share
    its fate, whatever their doc_id."""
    return toxicity.drop_toxic(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on three sources or more stay in their first place only; no document goes. A document without a source counts
    for no line's sources, but loses lines like others; a null text stays null."""
    return linededup.drop_boilerplate(docs.select(COLUMNS)).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity 0.8 or more; the smallest doc_id of each group stays. Texts without words and rows without a
    doc_id stay; of rows that repeat a doc_id with equal texts all stay or all go."""
    return jaccard.keep_one_per_class(docs.select(COLUMNS), k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by Poisson counts of their source's rate, so that characters reach the target weights, and
    are shuffled globally. A null source is a source of its own; rows that repeat a doc_id get equal counts."""
    return mixing.mixed_documents(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones each, as pieces in sequences of 1024 tokens; a null text is the end id alone."""
    return packing.pack(docs.select(COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Stages fit a model and tokenise, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
