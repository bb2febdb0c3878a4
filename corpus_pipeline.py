"""A corpus pipeline: each stage is one of the operators, on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to the shared folder as Parquet and
reads it again for the next stage; what a stage has written for itself goes when its result is there. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewright.llm import decontaminate, jaccard, mixing, suffixes, toxicity
from sitewright.llm.common import Written, scoped
from sitewright.llm.queries import table


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier chain learns from the labels of the documents at hand; documents that it calls toxic go."""
    return toxicity.not_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingle similarity links, the one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def repeated_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """50-byte strings that a document with a smaller doc_id has too are cut out of the text; documents stay."""
    return suffixes.deduplicated(docs)


def benchmark_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sources_are_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("n-gram Jaccard join", one_of_each_group_stays),
    ("suffix-array dedup", repeated_passages_go),
    ("benchmark decontamination", benchmark_documents_go),
    ("mixing sources", sources_are_mixed),
]

#: SQL can express neither the classifier chain nor its training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scoped() as tables:
            out = Written(stage(spark, docs, sf_dir), f"pipeline-{k}")
            tables.remove(out)
        if before:
            before.drop()
        docs, before = out.df, out
    return STAGES[-1][1](spark, docs, sf_dir)
