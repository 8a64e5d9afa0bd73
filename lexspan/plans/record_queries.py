"""More registered queries: cells and labels of text, sections, records, registries, drafts, retrieval by scope; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, ledger, search, shape, sinks, tables
from ..sources import readers
from .queries import _LEX_SQL, _READY_SQL, _STOP, _corpus, _questions, _query_vectors, _t, _vectors, query

# ---- cells and labels of text


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber % 6 AS form, CAST(l_quantity AS INT) AS q, CAST(l_suppkey AS INT) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, form < 5 AS is_number_cell, CASE form WHEN 0 THEN q * 1000.0::DOUBLE + 7 WHEN 1 THEN -(q + 0.5::DOUBLE) WHEN 2 THEN q::DOUBLE WHEN 4 THEN s::DOUBLE END AS value,
  CASE form WHEN 0 THEN CAST(q * 1000 + 7 AS VARCHAR) WHEN 1 THEN q || '.5' WHEN 2 THEN CAST(q AS VARCHAR) WHEN 4 THEN CAST(s AS VARCHAR) END AS plain FROM c""")
def numeric_cells(spark, d):
    q, s, form = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 6
    cell = F.when(form == 0, F.concat(F.lit("$ "), q, F.lit(",007"))).when(form == 1, F.concat(F.lit("("), q, F.lit(".5)"))).when(form == 2, F.concat(q, F.lit("%"))).when(form == 3, "—").when(form == 4, s).otherwise(F.concat(F.lit("note "), s))
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))
    value = T.parse_number("cell")
    return rows.select("l_orderkey", "l_linenumber", T.is_numeric_cell("cell").alias("is_number_cell"), value.alias("value"), T.normalize_number(value).alias("plain"))


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct([CAST(CAST(l_quantity AS INT) AS VARCHAR), CAST(CAST(l_suppkey AS INT) * 1000 + 25 AS VARCHAR), CAST(CAST(l_partkey AS INT) AS VARCHAR) || '.5'])), ' ') AS numbers FROM lineitem""")
def numbers_in_sentences(spark, d):
    n = lambda c: F.col(c).cast("int").cast("string")
    grouped = F.format_number(F.col("l_suppkey") * 1000 + 25, 0)
    text = F.concat(F.lit("Sold "), n("l_quantity"), F.lit(" of A7, x1.25 at $"), grouped, F.lit(", down ("), n("l_partkey"), F.lit(".50)%; again "), n("l_quantity"), F.lit(".00"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(T.numbers_in_text(text), " ").alias("numbers"))


@query("""WITH s AS (SELECT p_partkey, [p_brand, p_type, p_name] AS a, [p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Type' END] AS b FROM part),
c AS (SELECT *, CASE WHEN a[2] = b[2] THEN 2 ELSE 1 END AS n FROM s)
SELECT p_partkey, array_to_string(a[1:n], '/') AS shared, n = 2 AS below, n >= 2 AND NOT regexp_matches(a[3], '^Note') AND NOT length(regexp_replace(a[3], '[^A-Z]', '', 'g')) > 0.7 * greatest(length(regexp_replace(a[3], '[^A-Za-z]', '', 'g')), 1) AS related,
  'd' || p_partkey || '#I1#' || rtrim(substr(trim(regexp_replace(lower(a[3]), '[^a-z0-9]+', '-', 'g'), '-'), 1, 28), '-') AS parent FROM c""")
def section_paths(spark, d):
    a, b = F.array("p_brand", "p_type", "p_name"), F.array("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("Type"))
    rows = _t(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    parent = T.parent_id(F.concat(F.lit("d"), F.col("p_partkey").cast("string")), F.lit("I1"), "a")
    return rows.select("p_partkey", F.array_join(T.common_prefix("a", "b"), "/").alias("shared"), T.is_descendant("a", "b").alias("below"), T.are_related("a", "b").alias("related"), parent.alias("parent"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 4 = 0 THEN '10-K/A' ELSE '10-Q' END AS form, o_orderkey % 4 AS q, 'Firm' || (o_custkey % 5) || ', Inc.' AS name FROM orders)
SELECT o_orderkey, 'T' || q || '_' || replace(form, '/', '') || '_' || strftime(day, '%Y-%m-%d') AS document_id, CASE WHEN q = 0 THEN 'Fiscal Year ' || year(day) ELSE 'Fiscal Q' || q || ' ' || year(day) END AS period, replace(name, ', Inc.', '') AS company,
  'Item ' || q || ' > x' AS section, 'T' || q || '_' || replace(form, '/', '') || '_' || strftime(day, '%Y-%m-%d') || ', p. ' || (q + 1) || ', Item ' || q || ' > x' AS citation,
  '[chunk_id=' || o_orderkey || ' document_id=D period=' || strftime(day, '%Y-%m-%d') || ' page=' || (q + 1) || ' section=S]' || chr(10) || 'body' AS block, 'Ask: ' || name || ' {{x}}' AS prompt FROM o""")
def filing_labels(spark, d):
    q, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    rows = _t(spark, d, "orders").select("o_orderkey", day.alias("day"), q.alias("q"), F.when(q == 0, "10-K/A").otherwise("10-Q").alias("form"), F.concat(F.lit("Firm"), (F.col("o_custkey") % 5).cast("string"), F.lit(", Inc.")).alias("name"))
    rows = rows.withColumn("document_id", T.document_id(F.concat(F.lit("T"), F.col("q").cast("string")), "form", "day"))
    path = F.array(F.lit("Part I"), F.lit("Item"), F.concat(F.lit("Item "), F.col("q").cast("string")), F.lit("x"))
    page, section = F.col("q") + 1, T.section_display(path)
    block = T.context_block(F.col("o_orderkey"), F.lit("D"), T.period_prefix("day"), page, F.lit("S"), F.lit("body"))
    return rows.select("o_orderkey", "document_id", T.period_label("form", F.year("day").cast("string"), F.col("q").cast("string")).alias("period"), T.short_company("name").alias("company"), section.alias("section"), T.citation_label("document_id", page, section).alias("citation"), block.alias("block"), T.fill_prompt("Ask: {question} {{x}}", "name").alias("prompt"))


@query("""SELECT doc_id, '{"citations":[' || (doc_id % 3) || '],"claims":[],"draft_answer":' || CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE '"' || lang || '"' END || '}' AS draft, sha256('{"citations":[' || (doc_id % 3) || '],"claims":[],"draft_answer":' || CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE '"' || lang || '"' END || '}') AS digest,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS answer, contains(lower('1,2' || source), lower('12SRC')) IS NOT NULL AND contains(lower('12' || source), '12src') AS loose FROM documents""")
def draft_digests(spark, d):
    answer = F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    draft = F.struct(F.array(F.col("doc_id") % 3).alias("citations"), F.array().cast("array<string>").alias("claims"), answer.alias("draft_answer"))
    rows = _t(spark, d, "documents").withColumn("draft", T.canonical_json(draft))
    noisy = T.salvage_json(F.concat(F.lit("Sure: "), F.col("draft"), F.lit(" done")), "draft_answer string")
    return rows.select("doc_id", "draft", ledger.payload_hash(draft).alias("digest"), noisy["draft_answer"].alias("answer"), T.loose_contains(F.concat(F.lit("1,2"), F.col("source")), F.lit("12SRC")).alias("loose"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first,
  round(1 - CAST(embedding[2] AS DOUBLE), 6) AS similarity FROM embeddings""")
def unit_vectors(spark, d):
    e = _t(spark, d, "embeddings")
    return e.select("vec_id", F.round(T.l2_norm("embedding"), 6).alias("norm"), F.round(F.element_at(T.l2_normalize("embedding"), 1), 6).alias("first"), F.round(search.similarity(F.element_at("embedding", 2).cast("double")), 6).alias("similarity"))


# ---- manifest and allowlist


def _manifest_rows(spark, d) -> DataFrame:
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("2024-01-31").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")
    form = F.when(k % 7 == 0, "8-K").when(k % 5 == 0, "10-k").otherwise("10-Q")
    return c.select(
        F.concat(F.lit("T"), k.cast("string")).alias("ticker"), F.lpad(k.cast("string"), 10, "0").alias("cik"), F.col("c_name").alias("company_name"), form.alias("form_type"), F.lit(None).cast("string").alias("accession_no"), day.alias("filing_date"),
        F.when(k % 11 == 0, "soon").otherwise(day).alias("period_end"), F.lit("2024").alias("fiscal_year"), F.when(k % 13 == 0, "9").when(k % 5 != 0, "2").alias("fiscal_quarter"), F.lit(None).cast("string").alias("source_url"), F.concat(F.lit("f"), (k % 17).cast("string")).alias("pdf_path"), F.lit(None).cast("string").alias("amends"),
    )


_MANIFEST_SQL = """m AS (SELECT c_custkey AS k, 'T' || c_custkey AS ticker, CASE WHEN c_custkey % 7 = 0 THEN '8-K' WHEN c_custkey % 5 = 0 THEN '10-K' ELSE '10-Q' END AS form, DATE '2024-01-31' + CAST(c_custkey % 300 AS INT) AS day, c_custkey % 11 = 0 AS soon,
  CASE WHEN c_custkey % 13 = 0 THEN 9 WHEN c_custkey % 5 <> 0 THEN 2 END AS q, c_custkey % 17 AS f FROM customer),
t AS (SELECT *, ticker || '_' || form || CASE WHEN soon THEN '' ELSE '_' || strftime(day, '%Y-%m-%d') END AS doc_id FROM m)"""


@query(f"""WITH {_MANIFEST_SQL}
SELECT doc_id, 'period_end: missing or not readable' AS error FROM t WHERE soon UNION ALL SELECT doc_id, 'unsupported form_type 8-K' FROM t WHERE form = '8-K' UNION ALL SELECT doc_id, 'fiscal_quarter must be 1 to 4' FROM t WHERE q = 9
UNION ALL SELECT doc_id, 'fiscal_quarter needed unless annual' FROM t WHERE form <> '10-K' AND q IS NULL UNION ALL SELECT doc_id, 'file missing: f' || f FROM t WHERE f >= 12""")
def manifest_errors(spark, d):
    files = spark.range(12).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    return readers.manifest_errors(_manifest_rows(spark, d), files)


@query(f"WITH {_MANIFEST_SQL} SELECT doc_id, form = '10-K' AS is_annual, CASE WHEN form = '10-K' THEN 'Fiscal Year 2024' WHEN q IS NOT NULL THEN 'Fiscal Q' || q || ' 2024' END AS period_label FROM t")
def typed_manifest(spark, d):
    return readers.type_manifest(_manifest_rows(spark, d)).select("doc_id", "is_annual", "period_label")


@query(f"WITH {_READY_SQL}, r AS (SELECT doc_id, lang || chr(10) || coalesce(text, '') AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM ready)) SELECT doc_id, md5(t) AS search_md5 FROM r")
def ready_search_index(spark, d):
    labels = _t(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ready").otherwise("pending").alias("ingest_status"))
    records = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("embed_text"), F.coalesce("text", F.lit("")).alias("raw_text"))
    return readers.search_index(records, search.ready_documents(labels)).select("doc_id", F.md5("search_text").alias("search_md5"))


# ---- chunks, records, registries


@query(r"""WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
n AS (SELECT doc_id, i, t, len(regexp_extract_all(t, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n, CAST(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 2 AS BIGINT) AS s FROM lines),
f AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM n),
p AS (SELECT doc_id, i, n, s, length(t) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f WHERE total >= 15),
r AS (SELECT doc_id, k, CAST(n AS BIGINT) AS size, CAST(0 AS BIGINT) AS pack, s, s + l AS e FROM p WHERE k = 1
  UNION ALL SELECT p.doc_id, p.k, CASE WHEN r.size >= 60 THEN p.n ELSE r.size + p.n END, CASE WHEN r.size >= 60 THEN r.pack + 1 ELSE r.pack END, p.s, p.s + p.l FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pack AS INTEGER) AS pack, CAST(min(s) AS INTEGER) AS char_start, CAST(max(e) AS INTEGER) AS char_end FROM r GROUP BY doc_id, pack""")
def chunk_spans(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    b = shape.block_offsets(shape.line_blocks(docs)).withColumns({"kind": F.lit("paragraph"), "item_code": F.lit("I1"), "section_path": F.array(F.lit("Part I"), F.lit("Item 1.")), "n_tokens": T.count_tokens("block_text"), "page_start": F.lit(1), "page_end": F.lit(1), "skip_reason": F.lit(None).cast("string"), "is_caption": F.lit(False), "table_id": F.lit(None).cast("string")})
    chunks = shape.chunk_blocks(b, shape.ChunkLimits(minimum=1, target=60, maximum=10**8, overlap=0))
    return chunks.select("doc_id", F.element_at(F.split("chunk_id", "#"), -1).cast("int").alias("pack"), "char_start", "char_end")


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, i, i // 4 AS sec, CASE WHEN i % 9 = 5 THEN 'table' WHEN i % 9 = 7 THEN 'heading' ELSE 'paragraph' END AS kind, len(regexp_extract_all(t, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM lines),
w AS (SELECT *, sum(CASE WHEN kind = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS walls FROM b), m AS (SELECT * FROM w WHERE kind = 'paragraph'),
c AS (SELECT *, CASE WHEN lag(walls) OVER o IS DISTINCT FROM walls OR lag(sec) OVER o IS DISTINCT FROM sec THEN 1 ELSE 0 END AS new FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM c), a AS (SELECT doc_id, unit, min(i) AS first_block, sum(n) AS tokens, min(walls) AS walls FROM u GROUP BY ALL)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, CAST(tokens AS INTEGER) AS tokens, lag(walls) OVER (PARTITION BY doc_id ORDER BY unit) IS DISTINCT FROM walls AS parted FROM a""")
def prose_units(spark, d):
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", "text")
    i = F.col("block_seq")
    b = shape.line_blocks(docs).withColumns({"kind": F.when(i % 9 == 5, "table").when(i % 9 == 7, "heading").otherwise("paragraph"), "item_code": F.lit("I1"), "section_path": F.array(F.lit("P"), F.lit("I"), F.floor(i / 4).cast("string")), "skip_reason": F.lit(None).cast("string"), "is_caption": F.lit(False), "table_id": F.lit("t"), "n_tokens": T.count_tokens("block_text")})
    return shape.prose_units(b)[1].select("doc_id", "unit", "tokens", "parted")


_RECORD_SQL = """r AS (SELECT doc_id, 'Co' || chr(32) || '(TK) | Form 10-Q | Fiscal Q2 2024 (period ended 2024-06-29; calendar 2024-Q2) | Part I > Item 2. > ' || lang AS header, coalesce(text, '') AS raw, doc_id % 5 = 0 AS tab FROM documents),
e AS (SELECT doc_id, tab, raw, CASE WHEN tab THEN header || chr(10) || 'Table: Sales (USD millions; 3M, 9M)' || chr(10) || 'Columns: 2024 | 2023' || chr(10) || 'Rows: net: a, b' ELSE header || chr(10) || raw END AS embed_text FROM r)"""


def _records(spark, d) -> DataFrame:
    docs, table = _t(spark, d, "documents"), F.col("doc_id") % 5 == 0
    chunks = docs.select(F.lit("F1").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.when(table, "table_summary").otherwise("narrative").alias("content_type"), F.array(F.lit("Part I"), F.lit("Item 2."), "lang").alias("section_path"), F.lit("I2").alias("item_code"), F.coalesce("text", F.lit("")).alias("raw_text"), F.when(table, "t1").alias("table_id"), (F.col("doc_id") % 9).cast("int").alias("pdf_page_start"), (F.col("doc_id") % 9 + 1).cast("int").alias("pdf_page_end"))
    filings = spark.sql("select 'F1' doc_id, 'Co' company_name, 'TK' ticker, '10-Q' form_type, '2024' fiscal_year, '2' fiscal_quarter, date'2024-06-29' period_end")
    own = spark.sql("select 't1' table_id, 'Sales' title, 'USD millions' units, array('3M', '9M') durations, array('2024', '2023') columns, array(named_struct('label', 'net', 'full_label', 'net', 'indent', 0, 'values', cast(array() as array<struct<raw:string,num:double>>)), named_struct('label', 'a', 'full_label', 'net: a', 'indent', 1, 'values', array(named_struct('raw', '1', 'num', 1D))), named_struct('label', 'b', 'full_label', 'b', 'indent', 0, 'values', array(named_struct('raw', '2', 'num', 2D)))) rows")
    return shape.build_records(chunks, filings, own, "m")


@query(f"WITH {_RECORD_SQL} SELECT CAST(doc_id AS VARCHAR) AS id, md5(embed_text) AS embed_md5, sha256('m' || chr(0) || embed_text) AS content_hash, CASE WHEN tab THEN 'USD millions' END AS units, '2024-Q2' AS calendar_quarter FROM e")
def embed_records(spark, d):
    return _records(spark, d).select("id", F.md5("embed_text").alias("embed_md5"), "content_hash", "units", "calendar_quarter")


@query("SELECT 'F1' AS doc_id, count(*) AS chunks, count(*) FILTER (doc_id % 5 = 0) AS tables, count(*) FILTER (doc_id < 0) AS footnotes, count(*) FILTER (doc_id % 5 <> 0) AS narrative FROM documents")
def build_summary(spark, d):
    return shape.build_summary(_records(spark, d))


@query(f"""WITH {_RECORD_SQL}, h AS (SELECT doc_id, sha256('m' || chr(0) || embed_text) AS c FROM e)
SELECT 'F1' AS document_id, '10-Q' AS form_type, DATE '2024-06-29' AS filing_period, 'm' AS embedding_model, CAST(max(doc_id % 9 + 1) AS INTEGER) AS page_count, count(*) AS chunk_count, sha256(string_agg(c, chr(10) ORDER BY c)) AS sha256 FROM h""")
def document_registry(spark, d):
    return sinks.document_registry(_records(spark, d))


@query(f"""WITH {_RECORD_SQL}, x AS (SELECT doc_id, tab, CASE WHEN raw <> '' THEN raw ELSE embed_text END AS t, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS h FROM e)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id,
  CAST(greatest(doc_id % 9, 1) AS INTEGER) AS page, CASE WHEN tab THEN 'table' ELSE 'prose' END AS chunk_type, sha256(doc_id || chr(10) || t) AS sha256 FROM x""")
def canonical_chunks(spark, d):
    return sinks.canonical_chunks(_records(spark, d)).select("chunk_id", "page", "chunk_type", "sha256")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, lang, source, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE CAST(doc_id % 7 AS INTEGER) END AS page, CASE WHEN doc_id % 4 = 0 THEN 'prose' ELSE lang END AS chunk_type FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 > 0")
def normalized_hits(spark, d):
    page = F.when(F.col("doc_id") % 3 == 0, "n/a").otherwise((F.col("doc_id") % 7).cast("string"))
    rows = _t(spark, d, "documents").where("doc_id % 3 = 0 or doc_id % 7 > 0").select(F.col("doc_id").cast("string").alias("key"), "lang", "source", page.alias("page"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("chunk_type"))
    return search.normalize_hits(rows)


# ---- tables: columns, heads, labels, groups, cells, from visual rows


def _cell(text, x0, x1, y, size=9.0, bold=False):
    s = lambda v: v if hasattr(v, "_jc") else F.lit(v)
    return F.struct(s(text).alias("text"), s(float(x0)).alias("x0"), s(float(x1)).alias("x1"), s(y).cast("double").alias("y0"), F.lit(size).alias("size"), F.lit(bold).alias("bold"), F.lit(0).alias("lead"))


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), l AS (SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_suppkey) AS INT) AS n, CAST(l_quantity AS INT) AS q, CAST(l_suppkey + 1 AS INT) AS s FROM lineitem)
SELECT CAST(k AS VARCHAR) AS table_id, 0 AS row_no, 'Sales:' AS label, 'Sales:' AS full_label, 0 AS indent, '' AS cells, 'June 30, ' || (2000 + k % 20) || '|June 30, 1999' AS heads FROM o
UNION ALL SELECT CAST(k AS VARCHAR), n, 'line ' || n, 'Sales: line ' || n, 1, q || '|' || CASE WHEN n % 2 = 1 THEN '(' || s || ')=-' || s ELSE '—=' END, 'June 30, ' || (2000 + k % 20) || '|June 30, 1999' FROM l""")
def built_tables(spark, d):
    l = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_suppkey")).alias("n"), F.col("l_quantity").cast("int").cast("string").alias("q"), (F.col("l_suppkey") + 1).cast("int").cast("string").alias("s"))  # noqa: E741
    o = l.select("k").distinct()
    year = F.concat(F.lit("June 30, "), (F.col("k") % 20 + 2000).cast("string"))
    heads = o.select("k", F.lit(-2).alias("row_no"), F.array(_cell(year, 200, 260, F.lit(0), 8.0, True), _cell("June 30, 1999", 300, 360, F.lit(0), 8.0, True)).alias("frags"))
    group = o.select("k", F.lit(0).alias("row_no"), F.array(_cell("Sales:", 20, 50, F.lit(10))).alias("frags"))
    other = F.when(F.col("n") % 2 == 1, F.concat(F.lit("("), F.col("s"), F.lit(")"))).otherwise("—")
    y = F.lit(10) + F.col("n") * 12
    body = l.select("k", F.col("n").alias("row_no"), F.array(_cell(F.concat(F.lit("line "), F.col("n").cast("string")), 30, 60, y), _cell("$", 215, 220, y), _cell(F.col("q"), 230, 260, y), _cell(other, 330, 360, y)).alias("frags"))
    lines = heads.unionByName(group).unionByName(body).select(F.col("k").cast("string").alias("table_id"), "row_no", "frags", F.lit(9.0).alias("body_size"))
    made = tables.build_tables(lines)
    facts = made.select("table_id", F.array_join("columns", "|").alias("heads"), F.posexplode("rows").alias("p", "r"))
    num = lambda v: F.coalesce(v["num"].cast("int").cast("string"), F.lit(""))
    cells = F.array_join(F.transform("r.values", lambda v: F.when(v["raw"] == num(v), v["raw"]).otherwise(F.concat(v["raw"], F.lit("="), num(v)))), "|")
    row_no = F.when(F.col("r.label") == "Sales:", 0).otherwise(F.regexp_extract("r.label", r"(\d+)$", 1).cast("int"))
    return facts.select("table_id", row_no.alias("row_no"), F.col("r.label").alias("label"), F.col("r.full_label").alias("full_label"), F.col("r.indent").alias("indent"), cells.alias("cells"), "heads")


# ---- drafts and ledger


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), g AS (SELECT conv_id, turn, turn % 3 <> 2 AS ok, 'k' || (turn % 2) AS chunk_id, 'q' || (turn % 4) AS quote FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk_id, quote ORDER BY turn) AS n FROM g WHERE ok) SELECT conv_id AS run_id, turn AS at, chunk_id, quote FROM f WHERE n = 1""")
def rebuilt_citations(spark, d):
    t = F.col("turn")
    gated = _t(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), t.alias("at"), (t % 3 != 2).alias("ok"), F.concat(F.lit("k"), (t % 2).cast("string")).alias("chunk_id"), F.concat(F.lit("q"), (t % 4).cast("string")).alias("quote"))
    return evidence.rebuilt_citations(gated)


@query("""SELECT user_id AS run_id, min(event_id) AS step_id, event_type, CAST(min(ts) AS VARCHAR) IS NOT NULL AS seen, arg_max(event_id, event_id) AS last_id FROM events GROUP BY user_id, event_type""")
def upserted_steps(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.lit(1).alias("step_number"), "event_type", F.col("event_id").alias("step_id"), F.lit("RECEIVED").alias("state"), F.col("event_id").cast("string").alias("payload"), F.col("event_id").alias("arrival"))
    return ledger.upsert_steps(e).select("run_id", "step_id", "event_type", (F.col("state") == "RECEIVED").alias("seen"), F.col("payload").cast("long").alias("last_id"))


@query("""WITH v AS (SELECT o_custkey AS run_id, o_orderkey AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'RELEASED' ELSE 'AWAITING_HUMAN' END AS state, 'a' || o_orderkey AS answer FROM orders)
SELECT run_id, max(version) AS version, arg_max(state, version) AS state, CASE WHEN arg_max(state, version) = 'RELEASED' THEN arg_max(answer, version) END AS answer FROM v GROUP BY run_id""")
def current_runs(spark, d):
    k = F.col("o_orderkey")
    v = _t(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), k.alias("version"), F.when(k % 2 == 0, "RELEASED").otherwise("AWAITING_HUMAN").alias("state"), F.concat(F.lit("a"), k.cast("string")).alias("answer"))
    return ledger.current_runs(ledger.append_events(v.where(k % 3 == 0), v))


@query("""SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0""")
def wrong_answers(spark, d):
    k = F.col("o_orderkey")
    answer = F.concat(F.lit("a"), k.cast("string"))
    runs = _t(spark, d, "orders").select(k.alias("run_id"), F.when(k % 2 == 0, "RELEASED").otherwise("FAILED").alias("state"), F.when(k % 3 == 0, answer).otherwise("x").alias("answer"), F.to_json(F.struct(answer.alias("draft_answer"))).alias("draft"))
    return ledger.wrong_answers(runs).select("run_id")


@query("""SELECT 'steps' AS table_name, l_orderkey || '|' || l_linenumber || '|e' AS key, 'missing run' AS error FROM lineitem WHERE l_orderkey % 10 = 3
UNION ALL SELECT 'steps', l_orderkey || '|' || l_linenumber || '|e', 'repeated key' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'approvals', o_orderkey || '|s' || (o_custkey % 3), 'missing run' FROM orders WHERE o_orderkey % 10 = 3""")
def ledger_integrity(spark, d):
    runs = _t(spark, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("run_id"))
    steps = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_number"), F.lit("e").alias("event_type"))
    approvals = _t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")).alias("signature"))
    return ledger.integrity_errors(runs, steps, approvals)


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS c, o_orderkey AS seq, 's' || o_orderkey AS sig, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT c, seq, n, NULL::VARCHAR AS p, sha256('|' || sig) AS h FROM s WHERE n = 1 UNION ALL SELECT s.c, s.seq, s.n, r.h, sha256(r.h || '|' || s.sig) FROM r JOIN s ON s.c = r.c AND s.n = r.n + 1)
SELECT c AS chain_id, seq, p AS prev_audit_hash, h AS audit_hash FROM r""")
def appended_approvals(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("chain_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("signature"))
    first = F.row_number().over(Window.partitionBy("chain_id").orderBy("seq")) <= 2
    store = ledger.audit_chain(rows.withColumn("_first", first).where("_first").drop("_first"))
    return ledger.append_approvals(store, rows).select("chain_id", "seq", "prev_audit_hash", "audit_hash")


# ---- retrieval under allowlist and period scope: a source is a filing of a month of 2024


def _filings(spark, d) -> DataFrame:
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return _t(spark, d, "documents").select("source").distinct().select(F.col("source").alias("document_id"), F.format_string("2024-%02d-28", n % 12 + 1).alias("filing_period"), F.when(n % 7 == 3, "pending").otherwise("ready").alias("ingest_status"))


def _dated_questions(spark, d) -> DataFrame:
    i = F.col("question_id")
    quarter = (i % 4 + 1).cast("string")
    ask = F.when(i % 3 == 0, F.format_string(" as of 2024-%02d-10", i % 12 + 1)).when(i % 3 == 1, F.concat(F.lit(" in fiscal Q"), quarter, F.when(i % 4 == 0, " 2025").otherwise(" 2024"))).otherwise("")
    return _questions(spark, d).withColumn("question", F.concat(F.coalesce("question", F.lit("")), ask))


_SCOPE_SQL = f"""src AS (SELECT DISTINCT source AS document_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n FROM documents), man AS (SELECT document_id, printf('2024-%02d', n % 12 + 1) AS ym FROM src WHERE n % 7 <> 3),
lastdoc AS (SELECT document_id FROM man ORDER BY ym DESC, document_id DESC LIMIT 1),
asked AS (SELECT item_id AS question_id, CASE WHEN item_id % 3 = 0 THEN printf('2024-%02d', item_id % 12 + 1) WHEN item_id % 3 = 1 THEN ['2024-12', '2024-03', '2024-06', '2024-09'][item_id % 4 + 1] END AS ym FROM benchmark),
qs AS (SELECT question_id, CASE WHEN ym IN (SELECT ym FROM man) THEN ym ELSE 'latest' END AS scope FROM asked),
sd AS (SELECT ym AS scope, document_id FROM man UNION ALL SELECT 'latest', document_id FROM lastdoc), {_READY_SQL},
corpus AS (SELECT scope, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}') AS terms FROM documents JOIN sd ON sd.document_id = source WHERE doc_id IN (SELECT doc_id FROM ready) AND scope IN (SELECT scope FROM qs)),
q AS (SELECT scope, item_id AS question_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}'), lambda t: t NOT IN ({_STOP}) AND NOT regexp_full_match(t, '20[0-9][0-9]')) AS tokens FROM benchmark JOIN qs ON question_id = item_id),
want AS (SELECT DISTINCT scope, question_id, unnest(tokens) AS term FROM q),
tf AS (SELECT scope, doc_id, term, count(*) AS tf FROM (SELECT scope, doc_id, unnest(terms) AS term FROM corpus) GROUP BY ALL),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT scope, count(*) AS n FROM corpus GROUP BY scope),
w1 AS (SELECT question_id, doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE)) AS w FROM tf JOIN df USING (scope, term) JOIN want USING (scope, term) JOIN n USING (scope)),
big AS (SELECT scope, question_id, ab, count(*) AS times FROM (SELECT scope, question_id, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS ab FROM q) GROUP BY ALL),
joined AS (SELECT scope, doc_id, array_to_string(terms, ' ') AS s FROM corpus),
w2 AS (SELECT question_id, doc_id, 1.5::DOUBLE * times AS w FROM big JOIN joined ON big.scope = joined.scope AND contains(s, ab)),
lex0 AS (SELECT question_id, doc_id, round(sum(w), 6) AS lexical_score FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY lexical_score DESC, doc_id) AS INTEGER) AS keyword_rank FROM lex0 WHERE lexical_score > 0) WHERE keyword_rank <= 20),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
sim AS (SELECT qs.question_id, c.vec_id AS id, round(list_dot_product(a.x, c.x) / (sqrt(list_dot_product(c.x, c.x)) * (sqrt(list_dot_product(a.x, a.x)) + 1e-9) + 1e-9), 6) AS similarity FROM qs JOIN v a ON a.vec_id = qs.question_id JOIN corpus k ON k.scope = qs.scope JOIN v c ON c.vec_id = k.doc_id),
vec AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, id DESC) AS INTEGER) AS vector_rank FROM sim) WHERE vector_rank <= 20),
s AS (SELECT question_id, id, round(sum(x), 12) AS s, max(vr) AS vector_rank, max(kr) AS keyword_rank FROM (SELECT question_id, id, 1.0::DOUBLE / (60 + vector_rank) AS x, vector_rank AS vr, NULL AS kr FROM vec UNION ALL SELECT question_id, doc_id, 2.0::DOUBLE / (60 + keyword_rank), NULL, keyword_rank FROM lex) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY s DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST) AS INTEGER) AS rank FROM s) WHERE rank <= 30),
sc AS (SELECT *, min(s) OVER (PARTITION BY question_id) AS lo, max(s) OVER (PARTITION BY question_id) AS hi FROM top),
fused AS (SELECT question_id, id, round(f, 6) AS fusion, vector_rank, keyword_rank, rank FROM (SELECT *, CASE WHEN hi <= lo THEN 1.0::DOUBLE ELSE (s - lo) / (hi - lo) END AS f FROM sc) WHERE f >= 0.4),
h AS (SELECT f.*, CASE WHEN d.lang = 'en' THEN 'table' ELSE 'prose' END AS chunk_type FROM fused f JOIN documents d ON d.doc_id = f.id),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM h),
c AS (SELECT *, min(CASE WHEN place <= 8 THEN CAST(chunk_type = 'table' AS INT) END) OVER (PARTITION BY question_id) AS t FROM p)"""


def _scoped(spark, d):
    corpus = _corpus(spark, d).withColumns({"chunk_type": F.when(F.col("lang") == "en", "table").otherwise("prose"), "document_id": F.col("source")})
    return _dated_questions(spark, d), corpus, _vectors(spark, d).drop("label"), _query_vectors(spark, d).drop("label")


@query(f"WITH {_SCOPE_SQL} SELECT question_id, id, fusion, vector_rank, keyword_rank, rank, NULL::DOUBLE AS rerank, 'rrf_only' AS mode FROM c WHERE place <= CASE WHEN t = 1 THEN 8 ELSE 6 END")
def hybrid_search(spark, d):
    return search.search(*_scoped(spark, d), manifest=_filings(spark, d))


@query(f"WITH {_SCOPE_SQL} SELECT item_id AS question_id, CASE WHEN item_id IN (SELECT question_id FROM fused) THEN 'rrf_only' ELSE 'empty' END AS mode FROM benchmark")
def search_modes(spark, d):
    return search.search_modes(*_scoped(spark, d), manifest=_filings(spark, d))


@query(f"WITH {_SCOPE_SQL}, k AS (SELECT source AS scope, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS keyword_rank FROM documents WHERE doc_id IN (SELECT doc_id FROM ready)) SELECT scope, doc_id, CAST(keyword_rank AS INTEGER) AS keyword_rank FROM k WHERE keyword_rank <= 20")
def keyword_fallback(spark, d):
    return search.any_of_scope(_corpus(spark, d).withColumnRenamed("source", "scope"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'f' AS form_type, CAST(o_orderdate AS VARCHAR)[1:4] AS filing_period FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0)")
def document_meta(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders")
    m = o.select(k.cast("string").alias("document_id"), F.lit("f").alias("form_type"), F.substring(F.col("o_orderdate").cast("string"), 1, 4).alias("filing_period"), F.lit(1).alias("page_count"), F.when(k % 2 == 0, "ready").otherwise("pending").alias("ingest_status"), F.lit("x").alias("mime_type"))
    last = o.where(k % 2 == 0).agg(F.max(k).cast("string")).scalar()
    return search.get_document_meta(m, last).select("document_id", "form_type", "filing_period")


@query(f"WITH {_READY_SQL} SELECT doc_id AS chunk_id, source AS document_id FROM documents WHERE doc_id = (SELECT min(doc_id) FROM ready)")
def chunk_lookup(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"))
    first = _corpus(spark, d).agg(F.min("doc_id")).scalar()
    return search.get_chunk(docs, docs.select("document_id").distinct(), first)
