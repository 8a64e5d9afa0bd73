"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import read_table, stage_table
from lexspan.llm.language_id import keep_identified
from lexspan.llm.line_dedup import dedup_lines
from lexspan.llm.ngram_join import keep_one_of_each_group
from lexspan.llm.packing import pack_documents
from lexspan.llm.queries import ranks_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the model rejects go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; n_chars follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of near duplicates; rows, not ids, are dropped."""
    return keep_one_of_each_group(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack_documents(docs, ranks_file())


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_join), ("best-fit packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
