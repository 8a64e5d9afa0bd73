"""Drafting and evidence gates: candidate spans, one extractive claim, quote and number gates, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CAUSAL_MARKS = ["due to", "driven by", "because", "primarily", "resulted"]
REASONS = ["UNCITED_CLAIM", "INSUFFICIENT_EVIDENCE", "NUMERIC_MISMATCH"]


def candidate_spans(hits: DataFrame) -> DataFrame:
    """hits (question_id, question, rank, chunk_id, chunk_type, text) -> a row for each span: lines of a table, sentences of prose."""
    table = F.col("chunk_type").isin("table", "table_summary")
    parts = F.when(table, F.split("text", r"\r\n|\n|\r")).otherwise(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"(?<=[.!?])\s+"))
    rows = hits.where(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("is_table", table)
    rows = rows.select("question_id", "question", "rank", "chunk_id", "is_table", "text", F.posexplode(parts).alias("at", "part"))
    rows = rows.withColumn("span", F.regexp_replace("part", r"^\s+|\s+$", "")).drop("part")
    head = F.lower("span")
    return rows.where((F.length("span") >= 12) & ~head.startswith("columns:") & ~head.startswith("[table]"))


def score_spans(spans: DataFrame) -> DataFrame:
    """Adds overlap and score to the admitted spans."""
    question, span = F.lower("question"), F.lower("span")
    causal = question.startswith("why ") | F.contains(question, F.lit("why did"))
    narrative = causal | question.startswith("which ") | question.startswith("who ")
    numeric = question.startswith("how much ") | question.startswith("how large ") | question.startswith("what was ")
    marked = F.lit(False)
    for mark in CAUSAL_MARKS:
        marked |= F.contains(span, F.lit(mark))
    values = F.exists(F.regexp_extract_all("span", F.lit(T.TERM), 0), lambda t: t.rlike("^[0-9]+$") & ~t.cast("double").between(1900, 2100))
    signs = F.col("span").rlike(r"[$%|]")
    rows = spans.withColumn("overlap", F.size(F.array_intersect(T.draft_terms("question"), T.terms("span"))))
    rows = rows.where((F.col("overlap") >= 2) | (F.col("overlap") >= 1) & F.col("span").rlike(r"\d"))
    score = F.col("overlap") * 2.0 + F.lit(2.0) / F.col("rank")
    score += F.when(causal & marked, 5.0).otherwise(0.0)
    score += F.when(narrative, F.when(F.col("is_table"), -2.0).otherwise(2.0)).otherwise(0.0)
    score += F.when(numeric, F.when(signs, 6.0).when(values, 2.0).otherwise(0.0)).otherwise(0.0)
    score += F.when(numeric & F.col("is_table"), 5.0).otherwise(0.0)
    return rows.withColumn("score", F.round(score, 9))


def extractive_claims(hits: DataFrame) -> DataFrame:
    """One claim a question: its best span whose quote the chunk contains -> question_id, chunk_id, claim, score."""
    rows = score_spans(candidate_spans(hits)).where(T.quote_in_chunk("span", "text"))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank", "at")
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("question_id", "chunk_id", F.col("span").alias("claim"), "score")


def gate_claims(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claims (run_id, at, text, quote, cited array, supported), chunks (run_id, chunk_id, chunk_text, ...)
    -> each claim with cited_ok, quote_ok, numbers_ok, ok, supported, reasons.

    Numbers of the claim must be among the quote's own.  A claim is supported only if all gates hold and the draft says so.
    """
    one = claims.withColumn("chunk_id", F.when(F.size("cited") == 1, F.try_element_at("cited", F.lit(1))))
    rows = one.join(chunks, ["run_id", "chunk_id"], "left")
    cited = F.col("chunk_text").isNotNull()
    quote, text = F.coalesce("quote", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.withColumns({"cited_ok": cited, "quote_ok": cited & T.quote_in_chunk(quote, F.col("chunk_text")), "numbers_ok": cited & T.numbers_supported(text, quote)})
    ok = F.col("quote_ok") & F.col("numbers_ok")
    reasons = F.when(~F.col("cited_ok"), F.array(F.lit(REASONS[0]))).otherwise(
        F.array_compact(F.array(F.when(~F.col("quote_ok"), REASONS[1]), F.when(~F.col("numbers_ok"), REASONS[2])))
    )
    return rows.withColumns({"ok": ok, "entailment": ok.cast("double"), "reasons": reasons, "supported": ok & F.coalesce(F.col("supported"), F.lit(False))})


def verdicts(runs: DataFrame, gated: DataFrame) -> DataFrame:
    """runs (run_id, draft_answer), gated claims -> run_id, passed, draft_answer, reason_codes, claims.

    A run passes with a claim at least, all supported, no reason; else its answer is null.
    """
    codes = gated.select("run_id", "at", F.posexplode_outer("reasons").alias("pos", "reason")).where("reason is not null")
    codes = codes.groupBy("run_id", "reason").agg(F.min(F.struct("at", "pos")).alias("first"))
    codes = codes.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "reason"))), lambda x: x["reason"]).alias("reason_codes"))
    sums = gated.groupBy("run_id").agg(F.bool_and("supported").alias("all_supported"), F.count("*").alias("claims"))
    rows = runs.join(sums, "run_id", "left").join(codes, "run_id", "left")
    none = F.coalesce("claims", F.lit(0)) == 0
    reason_codes = F.when(none, F.array(F.lit(REASONS[1]))).otherwise(F.coalesce("reason_codes", F.array().cast("array<string>")))
    rows = rows.withColumns({"reason_codes": reason_codes, "claims": F.coalesce("claims", F.lit(0))})
    passed = ~none & F.coalesce("all_supported", F.lit(False)) & (F.size("reason_codes") == 0)
    return rows.withColumn("passed", passed).select("run_id", "passed", F.when(F.col("passed"), F.col("draft_answer")).alias("draft_answer"), "reason_codes", "claims")


def rebuilt_citations(gated: DataFrame) -> DataFrame:
    """Citations of the claims that pass, from chunk rows, once for each chunk and quote, in claim order."""
    rows = gated.where("ok")
    first = Window.partitionBy("run_id", "chunk_id", "quote").orderBy("at")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    names = [c for c in ("document_id", "chunk_id", "filing_period", "page", "section", "quote") if c in rows.columns]
    return rows.select("run_id", "at", *names)


def draft_chain(providers: list, fallback):
    """generate(question, hits) -> (draft, tokens): the first provider that doesn't raise answers, else the fallback, an extractive draft.
    A question without hits gets an empty draft and asks no provider."""

    def generate(question: str, hits: list):
        if not hits:
            return {"draft_answer": None, "claims": [], "citations": [], "next_search_query": None}, 0
        for provider in providers:
            try:
                return provider(question, hits)
            except Exception:
                continue
        return fallback(question, hits), 0

    return generate
