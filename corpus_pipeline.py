"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, packing."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from stallwise.llm.common import bound_batches, cut, table
from stallwise.llm.decontaminate import drop_contaminated
from stallwise.llm.jaccard_join import keep_one_of_each
from stallwise.llm.packing import pack
from stallwise.llm.secrets import redact_secrets
from stallwise.llm.toxicity import drop_toxic
from stallwise.sources.session import ship_package


def _stage(f):
    """A stage may be called by itself, so each sees to it that workers can import the package and get batches of bounded size."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return f(spark, docs, sf_dir)

    return run


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id."""
    return keep_one_of_each(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return redact_secrets(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

#: Learned scores and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
