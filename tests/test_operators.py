import pytest
from pyspark.sql import functions as F

from lexspan.operators import evidence, ledger, parse, search, shape, sinks, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def ranked(spark, name, col, ids):
    return spark.createDataFrame([(1, x, i) for i, x in enumerate(ids, 1)], f"question_id int, id string, {col} int")


def test_fusion_never_keeps_a_vector_only_hit_beside_lexical_ones(spark):
    v = ranked(spark, "v", "vector_rank", ["a", "b", "c"])
    k = ranked(spark, "k", "keyword_rank", ["b", "d", "e"])
    out = search.fuse(v, k).orderBy("rank").collect()
    assert [r["id"] for r in out][0] == "b" and {r["id"] for r in out} <= {"b", "d", "e"}
    assert out[0]["fusion"] == 1.0


def test_fusion_singleton_is_one(spark):
    out = search.fuse(ranked(spark, "v", "vector_rank", ["a"]), ranked(spark, "k", "keyword_rank", []))
    assert [(r["id"], r["fusion"]) for r in out.collect()] == [("a", 1.0)]


def test_context_cap(spark):
    hits = spark.createDataFrame([(q, i, t if i != 3 or q == 1 else "prose", "rrf_only") for q, t in ((1, "table"), (2, "table")) for i in range(1, 11)], "question_id int, rank int, chunk_type string, mode string")
    assert {r[0]: r[1] for r in search.context_cap(hits).groupBy("question_id").count().collect()} == {1: 8, 2: 6}


def test_gates(spark):
    chunks = spark.createDataFrame([("r", "c1", "Revenue was $1,000 in total. Costs were 7.")], "run_id string, chunk_id string, chunk_text string")
    claims = spark.createDataFrame(
        [("r", 0, "It was 1000", "Revenue was $1,000", ["c1"], True), ("r", 1, "It was 7", "Revenue was $1,000", ["c1"], True), ("r", 2, "x", "y", ["zz"], True), ("r", 3, "x", "not there", ["c1"], True), ("r", 4, "It was 1000", "Revenue was $1,000", ["c1"], None)],
        "run_id string, at int, text string, quote string, cited array<string>, supported boolean",
    )
    gated = evidence.gate_claims(claims, chunks)
    got = {r["at"]: (r["ok"], r["supported"], r["reasons"]) for r in gated.collect()}
    assert got[0] == (True, True, []) and got[1] == (False, False, ["NUMERIC_MISMATCH"]) and got[2] == (False, False, ["UNCITED_CLAIM"])
    assert got[3][2] == ["INSUFFICIENT_EVIDENCE"] and got[4] == (True, False, [])
    runs = spark.createDataFrame([("r", "a"), ("s", "b")], "run_id string, draft_answer string")
    out = {r["run_id"]: r for r in evidence.verdicts(runs, gated).collect()}
    assert not out["r"]["passed"] and out["r"]["reason_codes"] == ["NUMERIC_MISMATCH", "UNCITED_CLAIM", "INSUFFICIENT_EVIDENCE"]
    assert out["s"]["reason_codes"] == ["INSUFFICIENT_EVIDENCE"] and out["s"]["draft_answer"] is None
    assert evidence.rebuilt_citations(gated).count() == 1


def test_ledger_moves(spark):
    steps = spark.createDataFrame([("r", 1, "a", "RECEIVED"), ("r", 2, "b", "RETRIEVING"), ("r", 3, "c", "RELEASED")], "run_id string, step_number int, step_id string, state string")
    assert [r["to_state"] for r in ledger.illegal_moves(steps, ledger.edges(spark)).collect()] == ["RELEASED"]
    assert ledger.latest_state(steps).first()["state"] == "RELEASED"


HIT = [{"chunk_id": "c", "text": "one two"}]


def run(mode="rrf_only", hits=HIT, passed=True, clock=None, draft=None):
    times = iter(clock or [0.0] * 100)
    verdict = {"passed": passed, "draft_answer": "a" if passed else None, "claims": [], "citations": [], "reason_codes": [] if passed else ["NUMERIC_MISMATCH"]}
    return ledger.bounded_run(ledger.Run("r", "q"), {"search_chunks": lambda query: (mode, hits)}, lambda q, h: (draft or {"claims": [1]}, 3), lambda d, h: verdict, clock=lambda: next(times))


def test_bounded_run():
    assert (run().state, run().stop) == ("AWAITING_HUMAN", "awaiting_human")
    assert run(mode="out_of_corpus").reasons == ["OUT_OF_CORPUS", "INSUFFICIENT_EVIDENCE"]
    assert run(hits=[]).stop == "empty_retrieve"
    assert run(passed=False, draft={"claims": [], "next_search_query": "more"}).stop == "no_new_chunks"
    late = run(clock=[0.0] + [99.0] * 50)
    assert (late.state, late.stop) == ("FAILED", "timeout")
    with pytest.raises(PermissionError):
        ledger.call_tool({"drop": lambda: 1}, "drop")


def test_approval():
    done = run()
    with pytest.raises(ledger.LedgerError):
        ledger.approve(done, "RELEASED", "0", "1", "k")
    row = ledger.approve(done, "RELEASED", "1", "1", "k", unix_ts=10)
    assert done.envelope()["answer"] == "a" and row["from_state"] == "AWAITING_HUMAN"
    failed = run(clock=[0.0] + [99.0] * 50)
    with pytest.raises(ledger.LedgerError):
        ledger.approve(failed, "RELEASED", "1", "1", "k")
    ledger.approve(failed, "ABSTAINED", "1", "1", "k")
    assert failed.state == "ABSTAINED"


def frag(page, y, x, text, x1=None, size=10.0, bold=False, italic=False):
    return ("d", page, text, float(x), float(y), float(x1 if x1 is not None else x + 5 * len(text)), float(y + 10), size, bold, italic, 0)


def test_parse_and_chunk(spark):
    body = "plain words that run on for a while and say little of note"
    # the only page's first and last lines count as running heads
    frags = [frag(1, 2, 20, "running head"), frag(1, 500, 20, "running foot"), frag(1, 10, 20, "PART I", bold=True), frag(1, 40, 20, "Item 2. Results", bold=True), frag(1, 70, 20, body + " about"), frag(1, 82, 20, "the quarter."), frag(1, 120, 20, "The following table shows net sales (dollars in millions):"),
             frag(1, 150, 200, "June 27, 2026", 260, bold=True, size=8.0), frag(1, 150, 300, "June 28, 2025", 360, bold=True, size=8.0), frag(1, 165, 20, "iPhone"), frag(1, 165, 230, "54,252", 260), frag(1, 165, 330, "44,582", 360),
             frag(1, 177, 20, "Total"), frag(1, 177, 230, "60,000", 260), frag(1, 177, 330, "(5)", 360), frag(1, 400, 20, "SIGNATURES"), frag(1, 420, 20, "signed words here")]
    filings = spark.createDataFrame([("d", "10-Q", "Co")], "doc_id string, form_type string, company_name string")
    blocks = parse.parse_fragments(spark.createDataFrame(frags, parse.FRAGMENT), filings).cache()
    got = [r.asDict(recursive=True) for r in blocks.orderBy("block_seq").collect()]
    assert [b["kind"] for b in got] == ["heading", "heading", "paragraph", "paragraph", "table", "paragraph", "paragraph"]
    assert got[2]["block_text"] == body + " about the quarter." and got[2]["item_code"] == "10Q-P1-I2"
    assert got[3]["is_caption"] and got[5]["skip_reason"] == "signatures_and_certifications"
    table = got[4]
    assert table["columns"] == ["June 27, 2026", "June 28, 2025"] and table["rows"][0]["values"][0]["num"] == 54252.0 and table["rows"][1]["values"][1]["num"] == -5.0
    seen = tables.describe_tables(blocks.where("kind = 'table'")).first()
    assert seen["title"] == "Net sales" and seen["units"] == "USD millions" and seen["durations"] == ["instant"]
    b = blocks.withColumns({"block_text": F.when(F.col("kind") == "table", "T | 1").otherwise(F.col("block_text")), "n_tokens": F.lit(20)})
    chunks = shape.chunk_blocks(shape.block_offsets(b)).collect()
    text = shape.clean_text(b).first()["clean_text"]
    assert {c["content_type"] for c in chunks} == {"narrative", "table_summary"}
    assert all(text[c["char_start"] : c["char_end"]] == c["raw_text"] for c in chunks)


def test_packing_limits(spark):
    piece = "array<struct<begin:int,stop:int,n:int,back:int,back_n:int,page_start:int,page_end:int>>"
    packs = lambda limits, *own: [tuple(p) for p in spark.createDataFrame([(list(own),)], f"pieces {piece}").select(shape.pack_pieces("pieces", limits).alias("p")).first()["p"]]
    plain = shape.ChunkLimits(maximum=10, target=8, overlap=0)
    assert packs(plain, *((i, i + 1, 4, None, None, i, i) for i in range(5))) == [(0, 2, 0, 1), (2, 4, 2, 3), (4, 5, 4, 4)]
    # the next pack begins at the last piece's back, and has its tokens and pages
    assert packs(shape.ChunkLimits(maximum=10, target=9), (0, 50, 9, 40, 2, 1, 2), (52, 90, 7, 80, 2, 3, 3), (92, 95, 1, None, None, 4, 4)) == [(0, 50, 1, 2), (40, 90, 1, 3), (80, 95, 3, 4)]
    assert packs(plain) == []


def test_chunks_of_sections(spark):
    """Small sections join their kin, a table is a wall and a chunk, a footnote knows the table before it, overlap is whole sentences."""
    path = ["Part I", "Item 1."]
    long = " ".join(f"Sentence number {i} has six words." for i in range(140))
    own = [("heading", "Item 1.", path), ("paragraph", "Short intro here.", path), ("paragraph", "Alpha text.", [*path, "Alpha"]), ("paragraph", "Beta text.", [*path, "Beta"]), ("table", "T | 1", [*path, "Beta"]), ("footnote", "(1) a note to it", [*path, "Beta"]), ("paragraph", long, [*path, "Beta"])]
    b = spark.createDataFrame([("d", i, k, t, p, "I1", 1, 1, None, False, "d-T001" if k == "table" else None) for i, (k, t, p) in enumerate(own)], "doc_id string, block_seq int, kind string, block_text string, section_path array<string>, item_code string, page_start int, page_end int, skip_reason string, is_caption boolean, table_id string")
    b = shape.block_offsets(b.withColumn("n_tokens", F.length(F.regexp_replace("block_text", r"[^ .]", ""))))
    chunks = shape.chunk_blocks(b, shape.ChunkLimits(minimum=10, target=100, maximum=200, overlap=20)).orderBy("char_start", "chunk_id").collect()
    text = shape.clean_text(b).first()["clean_text"]
    assert all(text[c["char_start"] : c["char_end"]] == c["raw_text"] for c in chunks)
    assert chunks[0]["raw_text"].startswith("Short intro") and chunks[0]["raw_text"].endswith("Beta text.") and chunks[0]["section_path"] == path
    assert [(c["content_type"], c["table_id"]) for c in chunks[1:3]] == [("table_summary", "d-T001"), ("footnote", "d-T001")]
    prose = chunks[3:]
    assert len(prose) > 3 and all(a["char_end"] > b["char_start"] and text[b["char_start"] :].startswith("Sentence") for a, b in zip(prose, prose[1:]))


def test_incremental_embed_is_idempotent(spark):
    embed = sinks.hash_embedder()
    r = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("b", "h2")], "embed_text string, content_hash string")
    first, counts = sinks.embed_incremental(r, spark.createDataFrame([], "content_hash string, embedding array<float>"), embed)
    assert rows(counts) == [(3, 0)] and first.where("size(embedding) = 16").count() == 3
    _, counts = sinks.embed_incremental(r, first.select("content_hash", "embedding"), embed)
    assert rows(counts) == [(0, 3)]


def test_replace_documents(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.replace_documents(spark.createDataFrame([("x", 1), ("y", 2)], "doc_id string, v int"), at)
    sinks.replace_documents(spark.createDataFrame([("y", 3)], "doc_id string, v int"), at)
    assert sorted(rows(spark.read.parquet(at).select("doc_id", "v"))) == [("x", 1), ("y", 3)]


def test_scope(spark):
    m = spark.createDataFrame([("a", "2025-12-27", "ready"), ("b", "2026-06-27", "ready"), ("c", "2026-09-01", "pending")], "document_id string, filing_period string, ingest_status string")
    q = spark.createDataFrame([(1, "sales in fiscal Q1 2026"), (2, "June 2026?"), (3, "on 2025-12-01"), (4, "now"), (5, "Q4 2026")], "question_id int, question string")
    assert dict(rows(search.document_scope(q, m))) == {1: "a", 2: "b", 3: "a", 4: "b", 5: "b"}
