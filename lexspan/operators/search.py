"""Retrieval over question sets: scope, lexical and vector candidates, weighted rank fusion, caps.

Every function takes all questions of a set at once and ranks within a question by windows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T

CANDIDATES, RRF_K, RRF_CAP, FUSION_FLOOR = 20, 60, 30, 0.40
VECTOR_WEIGHT, LEXICAL_WEIGHT, BIGRAM_BONUS = 1.0, 2.0, 1.5
RERANK_FLOOR, CONTEXT_CAP, TABLE_CAP = 0.20, 6, 8
MAX_QUERY_BYTES = 64 << 20
TABLE_TYPES = ["table", "table_summary"]


def ready_documents(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("ingest_status") == "ready").select("document_id").distinct()


def question_scopes(questions: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question_id, question) x manifest (document_id, filing_period, ingest_status) -> (question_id, scope), (scope, document_id).

    A scope is a month of ready filings, 'latest' (the one latest filing) or, without dated filings, 'all'.
    The first of these that matches a ready filing decides: the first fiscal quarter and year, a month name with a year
    (months in calendar order), an ISO date, else the latest filing.
    """
    ready = manifest.where(F.col("ingest_status") == "ready").select("document_id", F.col("filing_period").cast("string").alias("period")).distinct()
    dated = ready.where(F.col("period").isNotNull() & (F.col("period") != ""))
    q = F.lower("question")
    quarter = F.regexp_extract(q, r"\b(?:fiscal\s+)?q([1-4])\s+(20\d{2})\b", 1)
    year = F.regexp_extract(q, r"\b(?:fiscal\s+)?q([1-4])\s+(20\d{2})\b", 2).try_cast("int")
    month = F.when(quarter == "1", "12").when(quarter == "2", "03").when(quarter == "3", "06").when(quarter == "4", "09")
    tries = [F.concat(F.when(quarter == "1", year - 1).otherwise(year).cast("string"), F.lit("-"), month)]
    for n, name in enumerate(T.MONTHS, 1):
        found = F.regexp_extract(q, rf"\b{name}(?:\s+\d{{1,2}},?)?\s+(20\d{{2}})\b", 1)
        tries.append(F.when(found != "", F.concat(found, F.lit(f"-{n:02d}"))))
    iso = F.regexp_extract(q, r"\b(20\d{2}-\d{2})-\d{2}\b", 1)
    tries.append(F.when(iso != "", iso))
    months = dated.select(F.substring("period", 1, 7).alias("scope"), "document_id")
    asked = questions.select("question_id", F.posexplode(F.array(*tries)).alias("priority", "scope")).where("scope is not null")
    named = asked.join(months.select("scope").distinct(), "scope", "left_semi").groupBy("question_id").agg(F.min_by("scope", "priority").alias("scope"))
    latest = dated.agg(F.max(F.struct("period", "document_id"))["document_id"].alias("document_id")).where("document_id is not null").withColumn("scope", F.lit("latest"))
    # a table has either dated filings, then one latest, or none, then all ready ones
    every = ready.withColumn("scope", F.lit("all")).join(latest.select(F.lit("all").alias("scope")), "scope", "left_anti")
    documents = months.select("scope", "document_id").unionByName(latest.select("scope", "document_id")).unionByName(every.select("scope", "document_id"))
    default = F.when(dated.agg(F.count("*") > 0).scalar(), "latest").otherwise("all")
    scopes = questions.select("question_id").join(named, "question_id", "left").select("question_id", F.coalesce("scope", default).alias("scope"))
    return scopes, documents


def document_scope(questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """(question_id, document_id): the documents that each question is about."""
    scopes, documents = question_scopes(questions, manifest)
    return scopes.join(documents, "scope").select("question_id", "document_id")


def lexical_candidates(questions: DataFrame, corpus: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """questions (question_id, question, scope?), corpus (doc_id, text, scope?) -> question_id, doc_id, lexical_score, keyword_rank.

    Sum over the question's distinct terms of idf times saturated term frequency, plus a bonus for each adjacent pair of
    question tokens that the document's space-joined terms contain.  With a column scope on both sides a question meets only documents
    of its scope, and the numbers of documents behind idf are the scope's own; a document has a row for each of its scopes.
    """
    if "scope" not in questions.columns:
        questions, corpus = questions.withColumn("scope", F.lit("")), corpus.withColumn("scope", F.lit(""))
    asked = questions.select("scope", "question_id", T.query_tokens("question").alias("tokens"))
    wanted = asked.select("scope", "question_id", F.explode(F.array_distinct("tokens")).alias("term"))
    docs = corpus.select("scope", "doc_id", T.terms("text").alias("terms"))
    total = corpus.groupBy("scope").agg(F.count("*").alias("n"))
    vocabulary = wanted.select("scope", "term").distinct()
    tf = docs.select("scope", "doc_id", F.explode("terms").alias("term")).join(vocabulary, ["scope", "term"], "left_semi").groupBy("scope", "doc_id", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("scope", "term").agg(F.count("*").alias("df")).join(total, "scope").select("scope", "term", T.idf(F.col("n"), "df").alias("idf"))
    # one row for a term of a question, with its weight, meets the documents that hold the term
    by_terms = tf.join(wanted.join(idf, ["scope", "term"]), ["scope", "term"]).select("question_id", "doc_id", (F.col("idf") * T.tf_saturation("tf")).alias("w"))

    # 'a b' lies in the joined terms where a term ends in a and the next one begins with b.  Which terms do is found once for
    # each distinct term, not at each of its places.
    pairs = F.when(F.size("tokens") > 1, F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.struct(F.element_at("tokens", i).alias("a"), F.element_at("tokens", i + 1).alias("b"))))
    bigrams = asked.select("scope", "question_id", F.explode(pairs).alias("p")).groupBy("scope", "question_id", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("times"))
    words = docs.select(F.explode(F.array_distinct("terms")).alias("t")).distinct()
    ends = words.select(F.col("t").alias("l"), F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring("t", i, F.length("t")))).alias("a"))
    ends = ends.join(bigrams.select("a").distinct(), "a", "left_semi")
    begins = words.select(F.col("t").alias("r"), F.explode(F.transform(F.sequence(F.lit(3), F.length("t")), lambda n: F.substring("t", 1, n))).alias("b"))
    begins = begins.join(bigrams.select("b").distinct(), "b", "left_semi")
    follow = docs.select("scope", "doc_id", F.explode(F.when(F.size("terms") > 1, F.arrays_zip(F.slice("terms", 1, F.size("terms") - 1).alias("l"), F.expr("slice(terms, 2, size(terms) - 1)").alias("r")))).alias("x"))
    follow = follow.select("scope", "doc_id", F.col("x.l").alias("l"), F.col("x.r").alias("r"))
    held = follow.join(ends, "l").join(begins, "r").select("scope", "doc_id", "a", "b").distinct()
    by_pairs = held.join(bigrams, ["scope", "a", "b"]).select("question_id", "doc_id", (F.lit(BIGRAM_BONUS) * F.col("times")).alias("w"))

    scored = by_terms.unionByName(by_pairs).groupBy("question_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("lexical_score")).where("lexical_score > 0")
    order = Window.partitionBy("question_id").orderBy(F.desc("lexical_score"), "doc_id")
    return scored.withColumn("keyword_rank", F.row_number().over(order)).where(F.col("keyword_rank") <= k)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def vector_candidates(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, group: str | None = None, per_group: int | None = None, same: str | None = None) -> DataFrame:
    """queries (question_id, vector), vectors (id, vector) -> question_id, id, similarity, vector_rank.

    Cosine dot / (|v| (|q| + 1e-9) + 1e-9) in double precision, larger id first of equals.  The query set is a matrix shipped
    to every task (at most MAX_QUERY_BYTES, which is counted before anything is fetched; beyond, a ValueError asks to split the set);
    a batch of vectors yields its own best k, so what is shuffled is k rows a question and batch.  A query meets the vectors
    of its own dimension; queries of several dimensions are answered side by side.
    group / per_group: at most so many of a group before the best k are taken; same: only vectors whose
    value of that column is the query's.
    """
    extra = group or same
    asked = queries.select("question_id", F.col("vector").cast("array<double>").alias("vector"), *([same] if same else [])).where(F.size("vector") > 0)
    sizes = asked.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64), F.lit(0)).alias("bytes"), F.array_sort(F.collect_set(F.size("vector"))).alias("dims")).first()
    if sizes["bytes"] > MAX_QUERY_BYTES:
        raise ValueError("query set too large for one pass: split it")
    if not sizes["dims"]:
        kind = dict(vectors.dtypes)["id"]
        return queries.select("question_id").limit(0).selectExpr("question_id", f"cast(null as {kind}) as id", "cast(null as double) as similarity", "cast(null as int) as vector_rank")
    if len(sizes["dims"]) > 1:
        parts = [vector_candidates(queries.where(F.size("vector") == d), vectors, k, group, per_group, same) for d in sizes["dims"]]
        return reduce(DataFrame.unionByName, parts)
    dims, rows = sizes["dims"][0], asked.collect()  # MAX_QUERY_BYTES at most
    ids, q = [r["question_id"] for r in rows], np.array([r["vector"] for r in rows], np.float64)
    q_norm = np.linalg.norm(q, axis=1) + 1e-9
    want = np.array([r[same] for r in rows], object) if same else None
    kind = to_arrow_type(queries.schema["question_id"].dataType)
    kinds = dict(vectors.dtypes) | {"question_id": dict(queries.dtypes)["question_id"]}

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column(1), dims)
            sim = np.round((q @ v.T) / (np.linalg.norm(v, axis=1)[None, :] * q_norm[:, None] + 1e-9), 6)
            own = np.array(batch.column(0).to_pylist())
            tags = np.array(batch.column(2).to_pylist(), object) if extra else None
            qi, vi = [], []
            for i in range(len(ids)):
                at = np.flatnonzero(tags == want[i]) if same else np.arange(len(own))
                at = at[np.lexsort((own[at], sim[i, at]))[::-1]]
                if group:
                    seen: dict = {}
                    at = np.array([x for x in at if seen.setdefault(tags[x], []).append(x) or len(seen[tags[x]]) <= per_group], np.int64)
                else:
                    at = at[:k]
                qi.append(np.full(len(at), i)), vi.append(at)
            qi, vi = np.concatenate(qi), np.concatenate(vi)
            cols = [pa.array([ids[i] for i in qi], kind), batch.column(0).take(pa.array(vi)), pa.array(sim[qi, vi])]
            names = ["question_id", "id", "similarity"]
            if group:
                cols.append(batch.column(2).take(pa.array(vi))), names.append("grp")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"question_id {kinds['question_id']}, id {kinds['id']}, similarity double" + (f", grp {kinds[group]}" if group else "")
    source = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), *([extra] if extra else [])).where(F.size("vector") == dims)
    found = source.mapInArrow(run, schema)
    best = [F.desc("similarity"), F.desc("id")]
    if group:
        within = Window.partitionBy("question_id", "grp").orderBy(*best)
        found = found.withColumn("n", F.row_number().over(within)).where(F.col("n") <= per_group).drop("n", "grp")
    order = Window.partitionBy("question_id").orderBy(*best)
    return found.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)


def fuse(vector: DataFrame, lexical: DataFrame, k: int = RRF_K, cap: int = RRF_CAP, floor: float = FUSION_FLOOR, weights: tuple[float, float] = (VECTOR_WEIGHT, LEXICAL_WEIGHT)) -> DataFrame:
    """(question_id, id, vector_rank) and (question_id, id, keyword_rank) -> question_id, id, fusion, vector_rank, keyword_rank, rank.

    Weighted reciprocal ranks are summed; the best cap are scaled to [0, 1] by their least and largest (all equal: 1)
    and kept from floor on.  Of equal sums those of the vector list come first, by its rank, then by the other's.
    """
    both = vector.select("question_id", "id", F.col("vector_rank"), F.lit(None).cast("int").alias("keyword_rank"), (F.lit(weights[0]) / (k + F.col("vector_rank"))).alias("s"))
    both = both.unionByName(lexical.select("question_id", "id", F.lit(None).cast("int").alias("vector_rank"), "keyword_rank", (F.lit(weights[1]) / (k + F.col("keyword_rank"))).alias("s")))
    sums = both.groupBy("question_id", "id").agg(F.round(F.sum("s"), 12).alias("s"), F.max("vector_rank").alias("vector_rank"), F.max("keyword_rank").alias("keyword_rank"))
    w = Window.partitionBy("question_id")
    order = w.orderBy(F.desc("s"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"))
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
    low, high = F.min("s").over(w), F.max("s").over(w)
    scaled = top.withColumn("fusion", F.when(high <= low, 1.0).otherwise((F.col("s") - low) / (high - low)))
    return scaled.where(F.col("fusion") >= floor).select("question_id", "id", F.round("fusion", 6).alias("fusion"), "vector_rank", "keyword_rank", "rank")


def reranker(score: Callable):
    """A rerank_fn from score(questions, texts) -> scores, a function of lists.  Where it raises, or gives another number of
    scores, the rows have no score, so that their questions keep the fused order."""

    @F.pandas_udf("double")
    def run(question: pd.Series, text: pd.Series) -> pd.Series:
        try:
            scores = list(score(question.tolist(), text.tolist()))
        except Exception:
            scores = []
        return pd.Series(scores if len(scores) == len(question) else [None] * len(question), dtype="float64")

    return run


def embed_questions(questions: DataFrame, embed: Callable, dims: int) -> DataFrame:
    """(question_id, vector): embed is a pandas UDF of text.  A vector of another dimension than the corpus has is null, which leaves the
    question to the lexical list."""
    made = questions.select("question_id", embed(F.col("question")).alias("vector"))
    return made.withColumn("vector", F.when(F.size("vector") == dims, F.col("vector")))


def _reranked(hits: DataFrame, texts: DataFrame, rerank_fn: Callable | None) -> DataFrame:
    """hits with rerank and mode, before any is dropped."""
    if rerank_fn is None:
        return hits.withColumns({"rerank": F.lit(None).cast("double"), "mode": F.lit("rrf_only")})
    scored = hits.join(texts, "id").withColumn("rerank", rerank_fn(F.col("question"), F.substring("text", 1, 4000))).drop("text")
    return scored.withColumn("mode", F.when(F.count("rerank").over(Window.partitionBy("question_id")) > 0, "cloud_rerank").otherwise("rrf_only"))


def _best_reranked(scored: DataFrame, top: int, floor: float) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc_nulls_last("rerank"), "rank"))
    return scored.withColumn("place", place).where((F.col("mode") == "rrf_only") | (F.col("rerank") >= floor) & (F.col("place") <= top)).drop("place")


def rerank(hits: DataFrame, texts: DataFrame, rerank_fn: Callable | None, top: int = CONTEXT_CAP, floor: float = RERANK_FLOOR) -> DataFrame:
    """Adds rerank scores by rerank_fn (a pandas UDF of question and text, at most 4000 signs) and keeps the best from floor on.
    A question whose scores are all null keeps its fused order and mode rrf_only; without rerank_fn all do."""
    return _best_reranked(_reranked(hits, texts, rerank_fn), top, floor)


def context_cap(hits: DataFrame, cap: int = CONTEXT_CAP) -> DataFrame:
    """Keeps cap hits a question, or 8 if the first 8 (or fewer) are all tables; reranked hits are capped alone.
    hits: question_id, rank, chunk_type, mode."""
    w = Window.partitionBy("question_id")
    hits = hits.withColumn("place", F.row_number().over(w.orderBy("rank")))
    all_tables = F.min(F.when(F.col("place") <= TABLE_CAP, F.col("chunk_type").isin(*TABLE_TYPES).cast("int"))).over(w) == 1
    hits = hits.withColumn("keep", F.when((F.col("mode") != "cloud_rerank") & all_tables, TABLE_CAP).otherwise(cap))
    return hits.where("place <= keep").drop("place", "keep")


def _scored(questions: DataFrame, corpus: DataFrame, vectors: DataFrame, queries: DataFrame, rerank_fn, manifest: DataFrame | None) -> DataFrame:
    asked = questions.where(~T.out_of_corpus_issuer("question")).select("question_id", "question")
    scoped = corpus
    if manifest is not None:
        scopes, documents = question_scopes(asked, manifest)
        asked = asked.join(scopes, "question_id")
        used = documents.join(scopes.select("scope").distinct(), "scope", "left_semi")
        scoped = corpus.join(used, "document_id")
    lexical = lexical_candidates(asked, scoped).select("question_id", F.col("doc_id").alias("id"), "keyword_rank")
    tags = ["scope"] if manifest is not None else []
    own = vectors.join(scoped.select(F.col("doc_id").alias("id"), *tags), "id")
    vector = vector_candidates(queries.join(asked.select("question_id", *tags), "question_id"), own, same=tags[0] if tags else None).select("question_id", "id", "vector_rank")
    hits = fuse(vector, lexical).join(corpus.select(F.col("doc_id").alias("id"), "chunk_type"), "id")
    if rerank_fn is not None:
        hits = hits.join(asked.select("question_id", "question"), "question_id")
    return _reranked(hits, corpus.select(F.col("doc_id").alias("id"), "text"), rerank_fn)


def search(questions: DataFrame, corpus: DataFrame, vectors: DataFrame, queries: DataFrame, rerank_fn=None, cap: int = CONTEXT_CAP, manifest: DataFrame | None = None) -> DataFrame:
    """All stages for a question set: guard, allowlist and period scope, candidates, fusion, optional rerank, cap.

    questions (question_id, question), corpus (doc_id, text, chunk_type, and document_id with a manifest), vectors (id, vector), queries
    (question_id, vector) -> question_id, id, fusion, vector_rank, keyword_rank, rank, rerank, mode.  With a manifest (document_id,
    filing_period, ingest_status) both lists of a question are over the ready documents of its scope.  A guarded question has no hits.
    """
    hits = _best_reranked(_scored(questions, corpus, vectors, queries, rerank_fn, manifest), CONTEXT_CAP, RERANK_FLOOR)
    return context_cap(hits, cap).select("question_id", "id", "fusion", "vector_rank", "keyword_rank", "rank", "rerank", "mode")


def search_modes(questions: DataFrame, corpus: DataFrame, vectors: DataFrame, queries: DataFrame, rerank_fn=None, manifest: DataFrame | None = None) -> DataFrame:
    """question_id, mode: out_of_corpus, empty, rrf_only or cloud_rerank.  A question whose hits the reranker scored is
    cloud_rerank even where all scores lie under the floor."""
    seen = _scored(questions, corpus, vectors, queries, rerank_fn, manifest).groupBy("question_id").agg(F.max("mode").alias("mode"))
    return questions.join(seen, "question_id", "left").select("question_id", F.when(T.out_of_corpus_issuer("question"), "out_of_corpus").otherwise(F.coalesce("mode", F.lit("empty"))).alias("mode"))


def normalize_hits(rows: DataFrame) -> DataFrame:
    """Hits of any source in one form: page at least 1 (1 where it is no number), type prose where there is none."""
    page = F.greatest(F.coalesce(F.col("page").cast("string").try_cast("int"), F.lit(1)), F.lit(1))
    kind = F.coalesce(F.nullif("chunk_type", F.lit("")), F.lit("prose"))
    return rows.withColumns({"page": page, "chunk_type": kind})


def any_of_scope(corpus: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The keyword fallback where a question has no term: k documents of a scope, the first by id."""
    order = Window.partitionBy("scope").orderBy("doc_id")
    return corpus.withColumn("keyword_rank", F.row_number().over(order)).where(F.col("keyword_rank") <= k).select("scope", "doc_id", "keyword_rank")


def similarity(distance):
    return F.lit(1.0) - T._c(distance)


def get_chunk(corpus: DataFrame, ready: DataFrame, chunk_id) -> DataFrame:
    """Point lookup under the allowlist; no row if the document isn't ready."""
    return corpus.where(F.col("chunk_id") == chunk_id).join(ready, "document_id", "left_semi")


def get_document_meta(manifest: DataFrame, document_id) -> DataFrame:
    return manifest.where((F.col("document_id") == document_id) & (F.col("ingest_status") == "ready")).select("document_id", "form_type", "filing_period", "page_count", "ingest_status", "mime_type")
