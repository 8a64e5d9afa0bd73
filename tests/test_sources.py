import json

import pytest
from pyspark.sql import functions as F

from lexspan import api
from lexspan.operators import evidence, ledger, search, sinks
from lexspan.sources import readers, schemas
from lexspan.streaming import ledger_stream

HEAD = "ticker,cik,company_name,form_type,accession_no,filing_date,period_end,fiscal_year,fiscal_quarter,source_url,pdf_path,amends"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_manifest(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text(f"{HEAD}\nAAPL, 0000320193 ,Apple Inc.,10-q,,2026-07-31,2026-06-27,2026,3,,a.pdf,\n")
    bad.write_text(f"{HEAD}\nA,1,A,8-K,,x,2026-06-27,2026,7,,a.pdf,\nA,1,A,8-K,,2026-07-31,2026-06-27,2026,,,b.pdf,\n")
    files = spark.createDataFrame([("a.pdf",)], "path string")
    m = readers.load_manifest(spark, str(good), files).first()
    assert (m["doc_id"], m["cik"], m["fiscal_quarter"], m["calendar_quarter"], m["accession_no"], m["is_annual"]) == ("AAPL_10-Q_2026-06-27", "0000320193", 3, "2026-Q2", None, False)
    with pytest.raises(ValueError) as error:
        readers.load_manifest(spark, str(bad), files)
    for part in ("filing_date: missing", "unsupported form_type 8-K", "must be 1 to 4", "needed unless annual", "repeated doc_id", "file missing: b.pdf"):
        assert part in str(error.value)
    (tmp_path / "short.csv").write_text("ticker,cik\nA,1\n")
    with pytest.raises(ValueError, match="company_name"):
        readers.read_manifest_rows(spark, str(tmp_path / "short.csv"))


def test_files(spark, tmp_path):
    (tmp_path / "allow.json").write_text(json.dumps({"documents": [{"document_id": "a", "ingest_status": "ready"}, {"document_id": "b"}]}))
    allow = readers.read_allowlist(spark, str(tmp_path / "allow.json"))
    assert sorted((r["document_id"], r["mime_type"], r["ingest_status"]) for r in allow.collect()) == [("a", "application/pdf", "ready"), ("b", "application/pdf", "pending")]
    folder = tmp_path / "processed" / "a"
    folder.mkdir(parents=True)
    (folder / "records.jsonl").write_text('{"id": "r1", "doc_id": "a", "embed_text": "e", "raw_text": "t"}\n\n{"id": "r2", "doc_id": "z"}\n')
    records = readers.read_records(spark, str(folder / "records.jsonl"))
    assert records.count() == 2
    assert rows(readers.search_index(records, search.ready_documents(allow)).select("id", "search_text")) == [("r1", "e\nt")]
    assert rows(readers.document_ids(spark, str(tmp_path / "processed" / "*"))) == [("a",)]
    (folder / "T1.json").write_text(json.dumps({"table_id": "T1", "rows": [{"label": "x", "values": [{"raw": "1", "num": 1.0}]}]}, indent=1))
    assert readers.read_tables(spark, str(folder / "T*.json")).first()["rows"][0]["values"][0]["num"] == 1.0
    (folder / "skipped.json").write_text(json.dumps([{"reason": "trivial_item", "page": 2}]))
    assert readers.read_skipped(spark, str(folder / "skipped.json")).select("reason", "page").first() == ("trivial_item", 2)
    import hashlib

    digest = readers.file_digests(spark, str(folder / "T1.json")).first()["sha256"]
    assert digest == hashlib.sha256((folder / "T1.json").read_bytes()).hexdigest()
    (tmp_path / "q.csv").write_text("question,ticker,fiscal_year,fiscal_quarter,expected\nWhat?,AAPL,2026,3,5\n")
    (tmp_path / "q.jsonl").write_text('{"question": "What?", "document_id": "a"}\n{"question": "Who?", "out_of_corpus": true}\n')
    (tmp_path / "t.txt").write_text("Test 1\nQuestion: What was it?\nAnswer: 5\nTest 2\nQuestion\nWho?\n\nAnswer\nx\n")
    assert readers.read_questions_csv(spark, str(tmp_path / "q.csv")).first()["fiscal_quarter"] == 3
    assert [r["out_of_corpus"] for r in readers.read_questions_json(spark, str(tmp_path / "q.jsonl")).collect()] == [False, True]
    assert rows(readers.read_test_script(spark, str(tmp_path / "t.txt"))) == [(1, "What was it?"), (2, "Who?")]
    assert readers.sample_records(records, 1).count() == 1 and rows(readers.sample_records(records, 2)) == rows(readers.sample_records(records, 2))
    spark.createDataFrame([("r1", "h", [1.0])], "id string, content_hash string, embedding array<float>").write.parquet(str(tmp_path / "v"))
    assert readers.read_vectors(spark, str(tmp_path / "v")).first()["embedding"] == [1.0]


def test_settings(tmp_path):
    assert readers.read_env("A=1\n# B=2\nA=3\nC='x'\nD", {"C": "set"}) == {"A": "1", "C": "set"}
    (tmp_path / "s.yaml").write_text("max_tokens: 700  # most\nembedding_model: 'm'\nother: 1\n")
    made = readers.Settings.from_file(str(tmp_path / "s.yaml"), {"LEXSPAN_MAX_TOKENS": "600"})
    assert (made.max_tokens, made.embedding_model, made.min_tokens) == (600, "m", 100)


def test_replaced_documents(spark, tmp_path):
    at = str(tmp_path / "t")
    made = lambda *own: spark.createDataFrame(list(own), "doc_id string, v int")
    stored = lambda: sorted(rows(spark.read.parquet(at).select("doc_id", "v")))
    sinks.replace_documents(made(("x", 1), ("y", 2), ("z", 3)), at, buckets=2)
    sinks.replace_documents(made(("y", 4)), at, documents=spark.createDataFrame([("x",), ("y",)], "doc_id string"), buckets=2)
    assert stored() == [("y", 4), ("z", 3)]
    sinks.replace_documents(made(), at, documents=spark.createDataFrame([("y",)], "doc_id string"), buckets=2)
    assert stored() == [("z", 3)]
    sinks.replace_documents(made(), at, documents=spark.createDataFrame([("z",)], "doc_id string"), buckets=2)
    sinks.replace_documents(made(("w", 5)), at, buckets=2)
    assert stored() == [("w", 5)]
    sinks.write_allowlist(spark.createDataFrame([("b", "ready"), ("a", "pending")], "document_id string, ingest_status string"), str(tmp_path / "allow"))
    assert [r["document_id"] for r in readers.read_allowlist(spark, str(tmp_path / "allow")).collect()] == ["a", "b"]


def test_tables_of_the_engine(spark, tmp_path):
    assert schemas.create_tables(spark, str(tmp_path), ["runs", "approvals"]) == ["runs", "approvals"] and schemas.create_tables(spark, str(tmp_path), ["runs"]) == []
    assert schemas.schema_errors(spark.read.parquet(str(tmp_path / "runs")), "runs") == []
    assert schemas.schema_errors(spark.sql("select 1 run_id"), "runs")[0] == "run_id: int, not string"
    with pytest.raises(ValueError):
        schemas.checked_name("runs; drop")


def test_embedder_tries_again(spark):
    def call(texts, seen={"n": 0}):
        seen["n"] += 1
        if seen["n"] == 1:
            raise TimeoutError
        return [[float(len(t))] for t in texts]

    embed = sinks.batch_embedder(call, batch=2, sleep=lambda s: None)
    records = spark.createDataFrame([("a", "h1"), ("bb", "h2"), ("ccc", "h3")], "embed_text string, content_hash string").coalesce(1)
    out, _ = api.embed(records, spark.createDataFrame([], "content_hash string, embedding array<float>"), embed)
    assert sorted((r["embed_text"], r["embedding"][0]) for r in out.collect()) == [("a", 1.0), ("bb", 2.0), ("ccc", 3.0)]


def test_reranker_and_question_vectors(spark):
    hits = spark.createDataFrame([(1, "q", "a", 1, "prose"), (1, "q", "b", 2, "prose"), (2, "q", "a", 1, "prose")], "question_id int, question string, id string, rank int, chunk_type string")
    texts = spark.createDataFrame([("a", "low"), ("b", "high")], "id string, text string")
    good = search.reranker(lambda q, t: [0.9 if x == "high" else 0.1 for x in t])
    assert sorted((r["question_id"], r["id"], r["mode"]) for r in search.rerank(hits, texts, good).collect()) == [(1, "b", "cloud_rerank")]
    broken = search.reranker(lambda q, t: 1 / 0)
    assert sorted((r["question_id"], r["id"], r["mode"]) for r in search.rerank(hits, texts, broken).collect()) == [(1, "a", "rrf_only"), (1, "b", "rrf_only"), (2, "a", "rrf_only")]
    q = spark.createDataFrame([(1, "q")], "question_id int, question string")
    embed = sinks.hash_embedder(16)
    assert search.embed_questions(q, embed, 8).first()["vector"] is None and len(search.embed_questions(q, embed, 16).first()["vector"]) == 16


def test_vectors_of_several_dimensions(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0])], "id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, None)], "question_id int, vector array<double>")
    assert sorted((r["question_id"], r["id"]) for r in search.vector_candidates(q, v, k=1).collect()) == [(1, "a"), (2, "c")]


def test_modes_under_the_rerank_floor(spark):
    corpus = spark.createDataFrame([(1, "alpha beta words", "prose"), (2, "gamma delta words", "prose")], "doc_id long, text string, chunk_type string")
    questions = spark.createDataFrame([(1, "alpha beta"), (2, "nothing known zzz"), (3, "microsoft alpha")], "question_id long, question string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "question_id long, vector array<double>")
    low = search.reranker(lambda q, t: [0.01] * len(t))
    assert search.search(questions, corpus, vectors, queries, low).count() == 0
    assert dict(rows(search.search_modes(questions, corpus, vectors, queries, low))) == {1: "cloud_rerank", 2: "empty", 3: "out_of_corpus"}


def test_draft_chain_falls_through():
    def down(question, hits):
        raise TimeoutError

    chain = evidence.draft_chain([down, lambda q, h: ({"draft_answer": "b"}, 7)], lambda q, h: {"draft_answer": "x"})
    assert chain("q", [1]) == ({"draft_answer": "b"}, 7)
    assert evidence.draft_chain([down], lambda q, h: {"draft_answer": "x"})("q", [1]) == ({"draft_answer": "x"}, 0)
    assert chain("q", [])[0]["claims"] == []


def test_limits():
    assert api.checked_question("  why? ") == "why?"
    for wrong in ("", "  ", "x" * 4001):
        with pytest.raises(ValueError):
            api.checked_question(wrong)
    with pytest.raises(ValueError):
        api.checked_approval("1" * 65, "me", "RELEASED")


def test_approvals_continue_their_chain(spark):
    run = ledger.Run("r", "q", state="AWAITING_HUMAN", draft={"draft_answer": "a"})
    first = api.approve(run, "RELEASED", "1", "1", "k", last_hash=None)
    chain = ledger.audit_chain(spark.createDataFrame([("c", 1, first["signature"])], "chain_id string, seq int, signature string")).first()
    assert (first["prev_audit_hash"], first["audit_hash"]) == (None, chain["audit_hash"])
    envelope = run.envelope()
    assert envelope["answer"] == "a" and set(envelope) == {"run_id", "state", "answer", "reason_codes", "stop_reason", "usage", "visited"}


def test_streams(spark, tmp_path):
    schema = "run_id string, step_id string, ts timestamp, state string"
    steps = [("r", "1", "2026-01-01 10:00:00", "RECEIVED"), ("r", "2", "2026-01-01 10:01:00", "RETRIEVING"), ("r", "2", "2026-01-01 10:01:00", "RETRIEVING"), ("r", "3", "2026-01-01 10:02:00", "RELEASED"), ("s", "4", "2026-01-01 10:07:00", "RECEIVED")]
    spark.createDataFrame(steps, "run_id string, step_id string, ts string, state string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))

    def result(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return rows(spark.table(name))

    assert len(result(ledger_stream.dedup_steps(stream), "once", "append")) == 4
    moves = result(ledger_stream.watch_transitions(stream), "moves", "append")
    assert sorted((r[2], r[3], r[4]) for r in moves) == [("RECEIVED", "RETRIEVING", True), ("RETRIEVING", "RELEASED", False)]
    counts = result(ledger_stream.step_counts(stream), "counts", "complete")
    assert sorted((r[1], r[2]) for r in counts) == [("RECEIVED", 1), ("RECEIVED", 1), ("RELEASED", 1), ("RETRIEVING", 2)]


def test_page_lines(spark):
    html = "<html><script>var x;</script><p>One &amp; two</p><div>three<br>four</div><!-- no --></html>"
    assert [r["line"] for r in readers.page_lines(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).orderBy("line_no").collect()] == ["One & two", "three", "four"]
