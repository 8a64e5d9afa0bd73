"""The engine in a few calls: ingest, embed, inspect, ask, approve; with the limits on what callers may send."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import ledger, parse, search, shape, sinks, tables
from .sources import readers

MAX_QUESTION, MAX_PIN, MAX_APPROVER = 4000, 64, 128


def checked_question(question: str) -> str:
    """A question without blanks around it, of 1 to 4000 signs."""
    text = question.strip() if len(question) <= MAX_QUESTION else ""
    if not text:
        raise ValueError(f"a question has 1 to {MAX_QUESTION} signs and isn't blank")
    return text


def checked_approval(pin: str, approver: str, to_state: str) -> None:
    for value, most, name in ((pin, MAX_PIN, "PIN"), (approver, MAX_APPROVER, "approver")):
        if not 1 <= len(value) <= most:
            raise ValueError(f"{name} has 1 to {most} signs")
    if to_state not in ("RELEASED", "ABSTAINED"):
        raise ValueError("target must be RELEASED or ABSTAINED")


def ingest(fragments: DataFrame, filings: DataFrame, path: str | None = None, model: str = "hash-16", limits: shape.ChunkLimits = shape.ChunkLimits()) -> dict[str, DataFrame]:
    """Positioned fragments and a typed manifest -> blocks, tables, chunks, sections, records, skipped, summary; written to path
    if there is one, without vectors (a dry run otherwise)."""
    blocks = parse.parse_fragments(fragments, filings).withColumnRenamed("banner", "_banner")
    made = tables.describe_tables(blocks.where("kind = 'table'").withColumnRenamed("_banner", "banner"))
    text = made.select("table_id", "table_text")
    blocks = blocks.join(text, "table_id", "left").withColumn("block_text", F.coalesce("table_text", "block_text")).withColumn("n_tokens", T.count_tokens("block_text"))
    blocks = shape.block_offsets(blocks.drop("table_text", "_banner"))
    chunks = shape.chunk_blocks(blocks, limits)
    records = shape.build_records(chunks, filings.select("doc_id", "company_name", "ticker", "form_type", "fiscal_year", "fiscal_quarter", "period_end"), made, model)
    out = {"blocks": blocks, "tables": made, "chunks": chunks, "sections": shape.complete_sections(shape.section_index(blocks), chunks), "records": records, "skipped": shape.skipped_log(blocks), "summary": shape.build_summary(records)}
    if path is not None:
        sinks.write_artifacts({k: out[k] for k in ("tables", "sections", "skipped", "records")}, path)
    return out


def embed(records: DataFrame, cache: DataFrame, embedder: Callable, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with vectors, counts); the vectors are written to path if there is one."""
    out, counts = sinks.embed_incremental(records, cache, embedder)
    if path is not None:
        sinks.write_vectors(out, path)
    return out, counts


def inspect(records: DataFrame, doc_id: str, n: int = 5, content_type: str | None = None) -> DataFrame:
    return readers.sample_records(records.where(F.col("doc_id") == doc_id), n, content_type)


def ask(questions: DataFrame, corpus: DataFrame, vectors: DataFrame, embedder: Callable, dims: int, manifest: DataFrame, rerank_fn: Callable | None = None) -> DataFrame:
    """Hits for a question set, each question within its allowlist and period scope; questions out of the limits get none."""
    asked = questions.withColumn("question", F.trim("question")).where(F.length("question").between(1, MAX_QUESTION))
    return search.search(asked, corpus, vectors, search.embed_questions(asked, embedder, dims), rerank_fn, manifest=manifest)


def approve(run: ledger.Run, to_state: str, pin: str, expected_pin: str, key: str, approver: str = "presenter", last_hash: str | None = None) -> dict:
    checked_approval(pin, approver, to_state)
    return ledger.approve(run, to_state, pin, expected_pin, key, approver, last_hash=last_hash)
