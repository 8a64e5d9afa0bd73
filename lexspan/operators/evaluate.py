"""Retrieval and grounding quality as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def mark_hits(ranked: DataFrame) -> DataFrame:
    """ranked (question_id, rank, document_id, section, text, gold_document, expected) -> adds hit."""
    body = F.lower(F.concat_ws("\n", "section", "text"))
    return ranked.withColumn("hit", F.coalesce((F.col("document_id") == F.col("gold_document")) & F.contains(body, F.lower("expected")), F.lit(False)))


def hit_rate_mrr(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(question_id), (question_id, rank, hit) -> questions, hit_rate, mrr, rounded to 3 places; a question without a hit counts 0."""
    first = hits.where(F.col("hit") & (F.col("rank") <= k)).groupBy("question_id").agg(F.min("rank").alias("first"))
    rows = questions.select("question_id").distinct().join(first, "question_id", "left")
    return rows.agg(F.count("*").alias("questions"), T.round_half_even(F.avg(F.col("first").isNotNull().cast("double"))).alias("hit_rate"), T.round_half_even(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("mrr"))


def rate_table(results: DataFrame) -> DataFrame:
    """results (answerable, abstained, citation_hit, claims, supported, numbers_ok, fact_hit) -> one row of rates.

    Each rate has its own denominator: answerable questions, claims, or unanswerable questions.
    """
    yes = lambda c: F.col(c).cast("double")
    can = F.col("answerable")
    per_claim = lambda c: F.sum(F.when(can, F.col(c))) / F.nullif(F.sum(F.when(can, F.col("claims"))), F.lit(0))
    rates = {
        "citation_hit_rate": F.avg(F.when(can, yes("citation_hit"))),
        "support_rate": per_claim("supported"),
        "numeric_rate": per_claim("numbers_ok"),
        "fact_rate": F.avg(F.when(can, yes("fact_hit"))),
        "abstain_rate": F.avg(F.when(~can, yes("abstained"))),
        "citation_hit_all": F.avg(F.when(can, yes("citation_hit")).otherwise(yes("abstained"))),
    }
    return results.agg(F.count("*").alias("questions"), *(T.round_half_even(v).alias(k) for k, v in rates.items()))
