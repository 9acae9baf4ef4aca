"""The corpus pipeline: documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanledger.llm import decontaminate, linededup, near_dedup, packing, tokens, toxicity
from spanledger.llm.common import stash


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labels of those at hand, predicts to be toxic go.

    Null and empty texts and null doc_ids stay; repeated rows stay or go together; no rows give none.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and documents that had words but keep none: all of it stands in others.

    Null and empty texts, and rows with a null doc_id, stay as they are; repeated rows lose the same lines; no rows give none.
    """
    return linededup.drop_repeated_lines(docs, emptied=False)


def near_dedup_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Null and empty texts and null doc_ids stay; repeated rows stay or go together; no rows give none.
    """
    return near_dedup.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts and null doc_ids stay; repeated rows stay or go together; no rows give none.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: a row for each piece.

    A null or empty text is its end id alone; repeated rows and null doc_ids are packed like others; no rows give none.
    """
    return packing.pack(docs, tokens.default_tokenizer())


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup_groups),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: Learned scores, MinHash links and a genetic packing are not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
