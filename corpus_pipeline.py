"""The corpus pipeline: toxicity, quality, near duplicates, packing.

Each stage takes all that its predecessor has kept and returns the columns of documents; the last
returns the packed pieces. Models are fitted on the labelled rows of the folder's whole tables.
Rows are told apart by numbers of their own, so repeated ids don't matter; a null doc_id is one that
any other precedes. Null and empty texts are no duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ngramjoin, packing, quality, toxicity
from tidemark.llm.common import table, written
from tidemark.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the smallest id."""
    return ngramjoin.single(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_poor), ("n-gram Jaccard join", drop_copies), ("packing", pack)]

#: The first two stages are trained models, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
