"""From raw documents to a training mix: five stages, each on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``documents``; the last returns, for each document that the mix takes, how many of its
words it takes, repeats counted.

Defined cases: a null text is empty in all stages; rows that repeat count each, until exact dedup leaves one; a null id is an id like others
in exact dedup and near-dedup, where it loses to any other; of rows that differ only in other columns the same one stays whenever it is run;
a null source is a source of its own; an empty ``documents`` gives an empty result; without labels nothing is
toxic, without a benchmark nothing is contaminated; columns of ``documents`` beyond those named pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import common, es_mix, exthash, fm_decontam, jaccard, nb_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return nb_toxic.reject(docs, nb_toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exthash.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a Jaccard similarity of five-word shingles of 0.8 or more links, by SimHash and an exact join for the rest: the one with the least id."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return fm_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: doc_id, source, size, source_size, target, taken."""
    return es_mix.mix(docs).where("taken > 0")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: A learnt classifier and linked documents aren't expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.shared_table(docs, f"pipeline-{name}")
    return docs
