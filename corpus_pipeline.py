"""Corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last return the
columns of ``documents``. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata_spark.llm.decontaminate import keep_clean
from strata_spark.llm.line_dedup import dedup_lines
from strata_spark.llm.ngram_join import keep_one_of_each
from strata_spark.llm.packing import pack_documents
from strata_spark.llm.toxicity import fit_chain, keep_non_toxic
from strata_spark.session import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labels of documents still there, does not call toxic."""
    return keep_non_toxic(docs, fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated long lines; ``n_chars`` follows the text, a null text stays null."""
    found = dedup_lines(docs)
    kept = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return found.withColumns({"text": kept, "n_chars": F.when(F.col("n_dropped") > 0, F.length(kept).cast("bigint")).otherwise(
        F.col("n_chars"))}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets, the one with the smallest ``doc_id``."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and the sequences they lie in."""
    return pack_documents(docs, keep_ids=False).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fitted models, tokenizers and prefix trees are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
