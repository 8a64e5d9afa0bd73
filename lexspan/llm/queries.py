"""One thin query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .common import read_table
from .language_id import identify_language
from .line_dedup import dedup_lines
from .ngram_join import ngram_jaccard_join
from .packing import pack_documents
from .sharding import shard_by_bytes
from .token_counts import count_tokens
from .topk_search import exact_top_k
from .url_filter import filter_urls
from .vector_dedup import near_duplicate_vectors


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS s
  FROM words),
classes AS (SELECT min(doc_id) AS head, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT head, n, unnest(s) AS x FROM classes),
overlap AS (
  SELECT a.head AS p, b.head AS q, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.head < b.head AND 4 * b.n >= 3 * a.n AND 4 * a.n >= 3 * b.n GROUP BY 1, 2),
links AS (SELECT p, q FROM overlap WHERE 100 * c >= 75 * (n + m - c)),
sym AS (SELECT p, q FROM links UNION SELECT q, p FROM links),
reach(a, b) AS (SELECT head, head FROM classes UNION SELECT r.a, s.q FROM reach r JOIN sym s ON r.b = s.p),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(comp.c, t.doc_id) AS component_id
FROM sets t LEFT JOIN classes ON t.s = classes.s LEFT JOIN comp ON comp.a = classes.head
"""

def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"), ranks_file())


# Fixed values of the task: rules (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def _op3_sql() -> str:
    out = r"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(translate(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '123456789_:&#=', '000000000-/???'), '[^a-z0/.?-]', '*', 'g') AS signs
  FROM cut),
ruled AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    substr(md5(url), 1, 1) IN ('0', '1', '2', '3') AS held FROM parts),
lab AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS says FROM ruled),
pos AS (SELECT page_id, url, says, held, signs, unnest(range(1, length(signs) + 1)) AS i FROM lab),
gram AS (SELECT page_id, url, says, held, signs, substr('^^^' || signs, i, 4) AS g FROM pos),
per AS (SELECT g, count(*) FILTER (says = 'allow' AND NOT held) AS allow, count(*) FILTER (says = 'block' AND NOT held) AS block FROM gram GROUP BY g),
counts AS (SELECT g, 'allow' AS says, allow AS n FROM per UNION ALL SELECT g, 'block', block FROM per),
n1 AS (SELECT says, right(g, 1) AS g, sum(n) AS n FROM counts GROUP BY 1, 2),
t1 AS (SELECT says, sum(n) AS seen, count(*) FILTER (n > 0) AS d FROM n1 GROUP BY 1),
p1 AS (SELECT says, g, CASE WHEN seen = 0 THEN 1.0::DOUBLE / 32 ELSE (n::DOUBLE + d / 32.0::DOUBLE) / (seen + d) END AS p FROM n1 JOIN t1 USING (says))"""
    for k in (2, 3, 4):
        out += f""",
n{k} AS (SELECT says, right(g, {k}) AS g, sum(n) AS n FROM counts GROUP BY 1, 2),
t{k} AS (SELECT says, left(g, {k - 1}) AS h, sum(n) AS seen, count(*) FILTER (n > 0) AS d FROM n{k} GROUP BY 1, 2),
p{k} AS (SELECT n.says, n.g, CASE WHEN seen = 0 THEN q.p ELSE (n.n::DOUBLE + d * q.p) / (seen + d) END AS p
  FROM n{k} n JOIN t{k} t ON t.says = n.says AND t.h = left(n.g, {k - 1}) JOIN p{k - 1} q ON q.says = n.says AND q.g = right(n.g, {k - 1}))"""
    return out + """,
ratio AS (SELECT g, sum(CASE WHEN says = 'allow' THEN ln(p) ELSE -ln(p) END) AS r FROM p4 GROUP BY g),
score AS (SELECT signs, sum(r) / count(*) AS score FROM (SELECT DISTINCT signs, i FROM pos) JOIN ratio ON g = substr('^^^' || signs, i, 4) GROUP BY signs),
scored AS (SELECT lab.*, coalesce(score, 0) AS score FROM lab LEFT JOIN score USING (signs)),
known AS (SELECT says, avg(score) AS m, stddev_pop(score) AS s FROM scored WHERE says IS NOT NULL AND held GROUP BY says),
w AS (SELECT max(m) FILTER (says = 'allow') AS ma, max(m) FILTER (says = 'block') AS mb, max(s) FILTER (says = 'allow') AS sa, max(s) FILTER (says = 'block') AS sb FROM known),
c AS (SELECT coalesce(CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END, 0) AS cut FROM w)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score >= (SELECT cut FROM c) THEN 'allow' ELSE 'block' END) AS verdict FROM scored
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read_table(spark, sf_dir, "documents"), 24)


OP4_SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
rows AS (SELECT doc_id, text, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size, coalesce(md5(text), '') AS g FROM documents),
bytes AS (SELECT text, hex(encode(text)) AS h FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
crc AS (SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS c FROM bytes, tab),
placed AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY g) AS own, sum(size) OVER (ORDER BY g, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY g, doc_id NULLS FIRST) AS rank FROM rows),
cut AS (SELECT *, CASE WHEN own * 2400 > total THEN 2 * upto - size ELSE min(upto - size) OVER (PARTITION BY g) + max(upto) OVER (PARTITION BY g) END AS twice FROM placed),
sharded AS (SELECT *, CAST(least(23, twice * 24 // (2 * total)) AS INTEGER) AS shard FROM cut)
SELECT doc_id, size, CAST(coalesce(c, 0) AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY rank) - 1 AS BIGINT) AS slot, NULL::INTEGER AS grown_shard FROM sharded LEFT JOIN crc USING (text)
"""


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), 0.93)


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS p, b.vec_id AS q FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.q FROM reach r JOIN links l ON r.b = l.p),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
deg AS (SELECT p, count(*) AS n FROM links GROUP BY p)
SELECT e.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, e.vec_id) AS component_id, coalesce(comp.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp ON comp.a = e.vec_id LEFT JOIN deg ON deg.p = e.vec_id
"""


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), 5, 50)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), ranks_file())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5("text").alias("kept_md5"))


OP9_SQL = r"""
WITH split AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, source, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM split),
full_lines AS (SELECT * FROM lines WHERE length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) > 0),
marks AS (SELECT line, arg_min(doc_id, (doc_id, i)) AS d, arg_min(i, (doc_id, i)) AS p FROM full_lines GROUP BY line HAVING count(DISTINCT source) >= 10),
cuts AS (SELECT f.doc_id, f.i FROM full_lines f JOIN marks USING (line) WHERE (f.doc_id, f.i) <> (d, p)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text, count(*) AS n FROM lines l ANTI JOIN cuts c ON c.doc_id = l.doc_id AND c.i = l.i GROUP BY l.doc_id)
SELECT s.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(parts), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
  CASE WHEN s.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS kept_md5
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), ranks_file())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_bpe": op2_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_sharding": op4_sharding,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_topk": op8_topk,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": OP1_SQL,
    "op3_url_filter": _op3_sql(),
    "op4_sharding": OP4_SQL,
    "op5_vector_dedup": OP5_SQL,
    "op8_topk": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
}
