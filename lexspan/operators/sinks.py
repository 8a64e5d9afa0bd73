"""Writers: partition replacement, upsert, incremental embedding, integrity audit."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK_TYPES = {"narrative": "prose", "table_summary": "table", "footnote": "note"}


BUCKETS = 64  # folders of a table; a document's rows all lie in one


def replace_documents(records: DataFrame, path: str, key: str = "doc_id", documents: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Replaces the rows of some documents and of no others, in a table of buckets folders by hash of the key.

    documents (a column named as key): those to replace; one that has no row in records is removed.  Without it, those in records.  Only folders
    that hold such a document are rewritten, by one dynamic overwrite; the rows of other documents in them are carried over.
    The rows to write are put beside the table first, since a job can't overwrite what it reads.
    """
    spark = records.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    gone = (records if documents is None else documents.select(key).unionByName(records.select(key))).select(key).distinct()
    rows = records.withColumn("_bucket", bucket)
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = table.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(table) and any(f.isDirectory() and f.getPath().getName().startswith("_bucket=") for f in files.listStatus(table)):
        old = spark.read.parquet(path)
        touched = [r[0] for r in gone.select(bucket.alias("b")).distinct().collect()]  # at most buckets rows
        kept = old.where(F.col("_bucket").isin(touched)).join(gone, key, "left_anti").select(*old.columns)
        aside = f"{path.rstrip('/')}__next"
        rows.unionByName(kept, allowMissingColumns=True).write.mode("overwrite").parquet(aside)
        rows = spark.read.parquet(aside)
        empty = sorted(set(touched) - {r[0] for r in rows.select("_bucket").distinct().collect()})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
        for b in [spark._jvm.org.apache.hadoop.fs.Path(path, f"_bucket={b}") for b in empty]:  # folders that lost all rows
            files.delete(b, True)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
        return
    rows.write.mode("append").partitionBy("_bucket").parquet(path)


def write_allowlist(manifest: DataFrame, path: str) -> None:
    """The allowlist as one JSON document, sorted by document id; its size is that of a manifest, a row for each filing."""
    rows = F.array_sort(F.collect_list(F.struct("document_id", *(c for c in manifest.columns if c != "document_id"))))
    manifest.agg(F.to_json(F.struct(rows.alias("documents"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_artifacts(tables: dict[str, DataFrame], path: str) -> None:
    """Clean text, tables, sections, skipped blocks, records without vectors: one folder each."""
    for name, table in tables.items():
        replace_documents(table.drop("embedding"), f"{path}/{name}")


def write_vectors(vectors: DataFrame, path: str) -> None:
    replace_documents(vectors.select("doc_id", "id", "content_hash", "embedding"), path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows of new, and those of old whose key new lacks.  Columns in keep fall back on the old value where new has null.
    Of repeated keys in new the last by all columns wins."""
    order = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in new.columns if c not in keys))
    fresh = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    if keep:
        before = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep))
        fresh = fresh.join(before, keys, "left").withColumns({c: F.coalesce(c, f"_old_{c}") for c in keep}).select(*new.columns)
    return fresh.unionByName(old.join(fresh.select(*keys), keys, "left_anti"))


def embed_todo(records: DataFrame, cache: DataFrame) -> DataFrame:
    """content_hash, embed_text of the records that the cache lacks, equal texts once."""
    return records.select("content_hash", "embed_text").dropDuplicates(["content_hash"]).join(cache.select("content_hash"), "content_hash", "left_anti")


def coverage(records: DataFrame, keys: list[str], *facts) -> DataFrame:
    """Which keys the store holds, with the number of chunks of each and further aggregates."""
    return records.groupBy(*keys).agg(F.count("*").alias("chunks"), *facts)


def embed_incremental(records: DataFrame, cache: DataFrame, embed: Callable) -> tuple[DataFrame, DataFrame]:
    """(records with embedding, counts): only rows whose content hash the cache lacks go through embed, a pandas UDF of text.

    Equal texts are embedded once.
    """
    known = cache.select("content_hash", "embedding").dropDuplicates(["content_hash"])
    made = embed_todo(records, known).select("content_hash", embed(F.col("embed_text")).alias("embedding"))
    out = records.drop("embedding").join(known.unionByName(made), "content_hash", "left")
    counts = records.join(known.select("content_hash", F.lit(1).alias("hit")), "content_hash", "left").agg(F.count_if(F.col("hit").isNull()).alias("embedded"), F.count_if(F.col("hit").isNotNull()).alias("reused"))
    return out, counts


def batch_embedder(call: Callable[[list[str]], list[list[float]]], batch: int = 64, tries: int = 6, longest_wait: float = 30.0, fatal: tuple = (), sleep: Callable[[float], None] = time.sleep):
    """An embed function for embed_incremental from call(texts) -> vectors in the same order, a remote service or a local model.

    Texts go in batches; a call that fails is tried again after 1, 2, 4, ... seconds, at most longest_wait, tries times in all; errors in
    fatal aren't tried again.  A model that call loads is loaded once for each Python worker.
    """

    def attempt(texts: list[str]) -> list[list[float]]:
        for turn in range(tries):
            try:
                return call(texts)
            except fatal:
                raise
            except Exception:
                if turn == tries - 1:
                    raise
                sleep(min(2.0**turn, longest_wait))
        return []

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            made = [v for at in range(0, len(texts), batch) for v in attempt(texts[at : at + batch])]
            yield pd.Series(made, index=part.index)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


def hash_embedder(dims: int = 16):
    """A test double: a unit vector from a text's digest, without a Python worker."""

    def embed(text):
        raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(T.sha256(text), i * 2 + F.lit(1), F.lit(2)), 16, 10).cast("double") - 127.5)
        return F.transform(T.l2_normalize(raw), lambda x: x.cast("float"))

    return embed


def canonical_chunks(records: DataFrame, namespace=None) -> DataFrame:
    """Records -> rows of the canonical chunk table."""
    kind = F.lit("prose")
    for a, b in CHUNK_TYPES.items():
        kind = F.when(F.col("content_type") == a, b).otherwise(kind)
    text = F.when(F.coalesce("raw_text", F.lit("")) != "", F.col("raw_text")).otherwise(F.col("embed_text"))
    name = T.uuid5("id", namespace) if namespace else T.uuid5("id")
    return records.select(
        name.alias("chunk_id"), F.col("doc_id").alias("document_id"), F.greatest(F.coalesce("pdf_page_start", F.lit(1)), F.lit(1)).alias("page"),
        F.when(F.size("section_path") > 0, F.array_join("section_path", " > ")).alias("section_path"), kind.alias("chunk_type"), text.alias("chunk_text"),
        T.sha256(F.concat(F.col("id"), F.lit("\n"), text)).alias("sha256"), *(["embedding"] if "embedding" in records.columns else []),
    )


def document_registry(records: DataFrame) -> DataFrame:
    """A row for each document: page count, chunk count, form, period, digest of its records."""
    first = F.min_by(F.struct("form_type", "period_end", "embedding_model"), "id")
    digest = T.sha256(F.array_join(F.array_sort(F.collect_list("content_hash")), "\n"))
    return records.groupBy(F.col("doc_id").alias("document_id")).agg(F.max("pdf_page_end").alias("page_count"), F.count("*").alias("chunk_count"), first.alias("f"), digest.alias("sha256")).select(
        "document_id", F.col("f.form_type").alias("form_type"), F.col("f.period_end").alias("filing_period"), F.col("f.embedding_model").alias("embedding_model"), "page_count", "chunk_count", "sha256"
    )


def corpus_errors(manifest: DataFrame, records: DataFrame, vectors: DataFrame) -> DataFrame:
    """manifest (document_id, ingest_status, chunk_count, embedding_model, embedding_dim) against records (doc_id, embedding_model)
    and vectors (doc_id, embedding) -> document_id, error.  Only ready documents are audited."""
    r = records.groupBy(F.col("doc_id").alias("document_id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("embedding_model")).alias("models"))
    v = vectors.groupBy(F.col("doc_id").alias("document_id")).agg(F.count("*").alias("m"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"))
    rows = manifest.where(F.col("ingest_status") == "ready").join(r, "document_id", "left").join(v, "document_id", "left")
    text = lambda c: F.col(c).cast("string")
    checks = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "records missing"),
        F.when(F.col("n") != F.col("chunk_count"), F.concat(F.lit("manifest chunks="), text("chunk_count"), F.lit(", processed="), text("n"))),
        F.when(F.col("embedding_model").startswith("openai:") & (F.col("models") != F.array("embedding_model")), F.concat(F.lit("manifest model="), F.col("embedding_model"))),
        F.when(F.col("n").isNotNull() & F.col("m").isNull(), "vectors missing"),
        F.when(F.col("m") != F.col("n"), F.concat(F.lit("vector rows="), text("m"), F.lit(", records="), text("n"))),
        F.when((F.col("lo") != F.col("embedding_dim")) | (F.col("hi") != F.col("embedding_dim")), F.concat(F.lit("manifest dim="), text("embedding_dim"), F.lit(", processed="), text("hi"))),
    ))
    return rows.select("document_id", F.explode(checks).alias("error"))
