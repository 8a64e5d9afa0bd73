"""Sources: filing manifest, allowlist, records, tables, vectors, evaluation sets, digests."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

MANIFEST = "ticker string, cik string, company_name string, form_type string, accession_no string, filing_date string, period_end string, fiscal_year string, fiscal_quarter string, source_url string, pdf_path string, amends string"
ALLOWLIST = "documents array<struct<document_id:string,source_uri:string,sha256:string,mime_type:string,form_type:string,filing_period:string,page_count:int,ingest_status:string,embedding_model:string,embedding_dim:int,chunk_count:int>>"
RECORD = (
    "id string, doc_id string, ticker string, cik string, company_name string, form_type string, accession_no string, filing_date date, fiscal_year int, fiscal_quarter int, period_end date,"
    " calendar_quarter string, source_url string, section_path array<string>, item_code string, content_type string, parent_id string, table_id string, units string, durations array<string>,"
    " char_start int, char_end int, pdf_page_start int, pdf_page_end int, page_label string, n_tokens int, embed_text string, raw_text string, content_hash string, embedding_model string,"
    " pipeline_version string, embedding array<float>"
)
TABLE = (
    "table_id string, doc_id string, title string, caption string, caption_source string, units string, units_note string, durations array<string>, columns array<string>,"
    " rows array<struct<label:string,full_label:string,indent:int,values:array<struct<raw:string,num:double>>>>, section_path array<string>, item_code string, pdf_page int, page_label string"
)
REQUIRED = ["ticker", "cik", "company_name", "form_type", "filing_date", "period_end", "fiscal_year", "pdf_path"]


def read_manifest_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows, trimmed, blanks as null."""
    names = [f.name for f in S._parse_datatype_string(MANIFEST).fields]
    rows = spark.read.csv(path, header=True, mode="PERMISSIVE")
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"manifest lacks columns {', '.join(missing)}")
    clean = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return rows.select(*(clean(F.col(c)).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names))


def type_manifest(rows: DataFrame) -> DataFrame:
    form = F.upper("form_type")
    typed = rows.withColumns({"form_type": form, "filing_date": F.col("filing_date").try_cast("date"), "period_end": F.col("period_end").try_cast("date"), "fiscal_year": F.col("fiscal_year").try_cast("int"), "fiscal_quarter": F.col("fiscal_quarter").try_cast("int")})
    return typed.withColumns({"doc_id": T.document_id("ticker", "form_type", "period_end"), "is_annual": T.is_annual("form_type"), "calendar_quarter": T.calendar_quarter("period_end"), "period_label": T.period_label("form_type", "fiscal_year", "fiscal_quarter")})


def manifest_errors(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """raw rows -> doc_id, error: values that don't parse, forms and quarters out of range, repeated ids, files (path) missing."""
    t = type_manifest(rows)
    bad = F.array_compact(F.array(
        *(F.when(F.col(c).isNull(), f"{c}: missing or not readable") for c in REQUIRED),
        F.when(~F.col("form_type").rlike(r"^10-[QK](/A)?$"), F.concat(F.lit("unsupported form_type "), F.col("form_type"))),
        F.when(~F.col("fiscal_quarter").between(1, 4), "fiscal_quarter must be 1 to 4"),
        F.when(~F.col("is_annual") & F.col("fiscal_quarter").isNull(), "fiscal_quarter needed unless annual"),
    ))
    out = t.select("doc_id", F.explode(bad).alias("error"))
    out = out.unionByName(t.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit("repeated doc_id").alias("error")))
    if files is not None:
        lost = t.join(files, t["pdf_path"] == files["path"], "left_anti").select("doc_id", F.concat(F.lit("file missing: "), F.col("pdf_path")).alias("error"))
        out = out.unionByName(lost)
    return out


def load_manifest(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Typed manifest; raises one error that lists everything wrong.  A manifest has a row for each filing; its errors are text for a person."""
    rows = read_manifest_rows(spark, path)
    wrong = manifest_errors(rows, files).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "doc_id", "error"))), "; ")).first()[0]
    if wrong:
        raise ValueError(f"manifest: {wrong}")
    return type_manifest(rows)


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ALLOWLIST).json(path, multiLine=True).select(F.inline("documents"))
    return rows.withColumns({"mime_type": F.coalesce("mime_type", F.lit("application/pdf")), "ingest_status": F.coalesce("ingest_status", F.lit("pending"))})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(RECORD).json(path).where(F.col("id").isNotNull())


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file for each table; path may be a glob."""
    return spark.read.schema(TABLE).json(path, multiLine=True)


def read_skipped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("reason string, item_code string, page int, kind string, preview string").json(path, multiLine=True).withColumn("file", F.input_file_name())


def document_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents by the name of the folder that holds their files."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("doc_id")).distinct()


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, content_hash string, embedding array<float>").parquet(path)


def search_index(records: DataFrame, ready: DataFrame) -> DataFrame:
    """Records of ready documents with the text that search reads."""
    allowed = ready.select(F.col("document_id").alias("doc_id"))
    return records.join(F.broadcast(allowed), "doc_id", "left_semi").withColumn("search_text", F.concat_ws("\n", "embed_text", "raw_text"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_questions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question string, ticker string, fiscal_year int, fiscal_quarter int, expected string").csv(path, header=True)


def read_questions_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question string, document_id string, expected string, out_of_corpus boolean").json(path).withColumn("out_of_corpus", F.coalesce("out_of_corpus", F.lit(False)))


def read_test_script(spark: SparkSession, path: str) -> DataFrame:
    """Blocks headed ``Test n`` -> test_no, question."""
    parts = F.split("value", r"(?m)^(?=Test\s+\d+)")
    rows = spark.read.text(path, wholetext=True).select(F.explode(parts).alias("part"))
    rows = rows.select(F.regexp_extract("part", r"^Test\s+(\d+)", 1).try_cast("int").alias("test_no"), F.trim(F.regexp_extract("part", r"(?is)Question\s*:?\s*(.*?)\s*(?:\n\s*Answer\b|$)", 1)).alias("question"))
    return rows.where("test_no is not null and question <> ''")


def sample_records(records: DataFrame, n: int, content_type: str | None = None, seed: int = 0) -> DataFrame:
    """n rows in a fixed pseudo-random order."""
    rows = records if content_type is None else records.where(F.col("content_type") == content_type)
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def read_env(text: str, env: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines; values that are set, or come first, win."""
    out = dict(env)
    for line in text.splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and key and not key.startswith("#"):
            out.setdefault(key.strip(), value.strip().strip("'\""))
    return out


@dataclass(frozen=True)
class Settings:
    """Engine settings; from_env reads LEXSPAN_<NAME>."""

    min_tokens: int = 100
    target_tokens: int = 500
    max_tokens: int = 800
    overlap_tokens: int = 50
    trivial_item_tokens: int = 15
    embedding_model: str = "hash-16"

    @classmethod
    def from_file(cls, path: str, env: dict[str, str] | None = None) -> Settings:
        """Settings of a file of ``name: value`` lines (flat YAML; # begins a comment); the environment wins."""
        with open(path, encoding="utf-8") as file:
            pairs = (line.split("#")[0].partition(":") for line in file)
            given = {k.strip(): v.strip().strip("'\"") for k, colon, v in pairs if colon and k.strip()}
        known = {f"LEXSPAN_{f.name.upper()}": given[f.name] for f in fields(cls) if f.name in given}
        return cls.from_env(known | (dict(os.environ) if env is None else env))

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        given = {f.name: env[f"LEXSPAN_{f.name.upper()}"] for f in fields(cls) if f"LEXSPAN_{f.name.upper()}" in env}
        return cls(**{k: v if k == "embedding_model" else int(v) for k, v in given.items()})


def page_lines(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, line_no, line: text between tags, scripts and styles dropped."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(/?(p|div|br|li|tr|h[1-6]|ul|ol|table|title|nav|footer|header|article|section)\b)[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    parts = F.filter(F.transform(F.split(text, "\n"), T.normalize_space), lambda x: x != "")
    return pages.select("page_id", F.posexplode(parts).alias("line_no", "line"))
