"""Schemas of the engine's tables, and their empty tables in a folder: what a migration would set up."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S

from .readers import RECORD, TABLE

SCHEMAS = {
    "documents": "document_id string, source_uri string, sha256 string, mime_type string, form_type string, filing_period string, page_count int, ingest_status string, embedding_model string, embedding_dim int, chunk_count int",
    "records": RECORD,
    "tables": TABLE,
    "runs": "run_id string, version long, question string, state string, draft string, draft_sha256 string, answer string, reason_codes array<string>, stop_reason string, created_at timestamp, updated_at timestamp",
    "agent_steps": "step_id string, run_id string, step_number int, state string, event_type string, payload string, created_at timestamp",
    "approvals": "chain_id string, seq long, run_id string, from_state string, to_state string, step_id string, payload_sha256 string, approver_id string, unix_ts long, signature string, prev_audit_hash string, audit_hash string",
}
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def checked_name(name: str) -> str:
    """A table name that may stand in a statement."""
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def create_tables(spark: SparkSession, path: str, names: list[str] | None = None) -> list[str]:
    """Writes the empty tables that path lacks; returns their names.  Safe to run again."""
    made = []
    for name in names or list(SCHEMAS):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{checked_name(name)}")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], SCHEMAS[name]).write.parquet(f"{path}/{name}")
            made.append(name)
    return made


def schema_errors(table: DataFrame, name: str) -> list[str]:
    """What a table lacks of its schema: missing columns and other types."""
    have = dict(table.dtypes)
    wanted = {f.name: f.dataType.simpleString() for f in S._parse_datatype_string(SCHEMAS[checked_name(name)]).fields}
    return [f"{c}: missing" if c not in have else f"{c}: {have[c]}, not {t}" for c, t in wanted.items() if have.get(c) != t]
