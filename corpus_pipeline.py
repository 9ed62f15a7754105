"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes each result as a
table in the shared folder and reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import saved
from ledgerline.llm.decontaminate import drop_leaks
from ledgerline.llm.lines import line_duplicates, remove_lines
from ledgerline.llm.mixing import mix
from ledgerline.llm.near_duplicates import drop_near_duplicates
from ledgerline.llm.toxicity import drop_toxic, fit_toxicity, learnable


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go. The classifier learns from labelled documents of the corpus."""
    corpus, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return drop_toxic(docs, fit_toxicity(corpus, learnable(labels)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go; n_chars follows. A document that loses all its words is a copy, and goes."""
    return remove_lines(docs, saved(line_duplicates(docs)), drop_emptied=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of least doc_id."""
    return drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its own draw say; adds copy, counted from 0."""
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Learnt scores, similarity joins and edit distances are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
