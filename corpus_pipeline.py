"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written to the shared folder and read again, and what a stage wrote in between goes. All but the last return the columns of
documents, further ones too, whatever their names.

Defined cases, the same in all stages: a null text counts as empty and stays null; documents with null ids are kept by every
stage that could drop them by id; repeated rows share their fate; an empty table stays empty. A very long text is one row,
and each stage handles it whole within the bounds that its operator's docstring tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm import bpe, common, decontaminate, lines, neardup, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those whose own text scores 0.5 or more, rows without id as well. An empty text has
    the intercept's score, which is low unless most labelled documents are toxic."""
    return toxicity.keep_clean(docs, toxicity.train(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; n_chars follows the text where it changed, and stays as it was elsewhere. A null
    source is a site of its own. A document of nothing else becomes empty, and stays."""
    out = lines.drop_boilerplate(docs, F.col("source"), most_loss=None)
    size = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.withColumn("n_chars", size).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id: five-word shingles, a similarity of 0.8. Empty
    documents and those without id have no duplicates; repeated rows of the least id all stay."""
    return neardup.keep_one(docs, size=5, percent=80)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go. Empty ones have none, and those without id are never told to have one."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and decoded text, one row for each document; a null or empty text has no tokens."""
    return bpe.encode_digests(docs)


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", leak_stage), ("bpe", token_stage)]

#: A trained classifier and BPE have no SQL; tests/llm/test_odd.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = common.table(spark, sf_dir, "documents"), common.Scratch(spark)
    for name, stage in STAGES:
        with common.gathered(spark):
            docs = written.table(stage(spark, docs, sf_dir), name)
        written.drop(len(written.paths) - 1)
    return docs
