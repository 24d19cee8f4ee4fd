"""Runs over a corpus, evaluation runs, acquired files, and what stands beside answers."""

import gzip
import hashlib
import json

import pytest

from arpent.operators import chunking, conversation
from arpent.plans import corpus, tools
from arpent.sources import fetch


def docs_of(spark, texts):
    rows = [(k, t, f"raw-{t}") for k, t in texts.items()]
    return chunking.text_documents(spark.createDataFrame(rows, "doc_id string, text string, raw string"))


def status(manifest):
    return {r.source_id: r.status for r in manifest.collect()}


def test_chunking_run(spark, tmp_path):
    root = f"{tmp_path}/corpus"
    first = corpus.chunking_run(spark, docs_of(spark, {"a": "Some words of a text. " * 200, "b": "Short.", "c": ""}), root)
    assert status(first) == {"doc-a": "chunked", "doc-b": "chunked", "doc-c": "failed"}
    second = corpus.chunking_run(spark, docs_of(spark, {"a": "Some words of a text. " * 200, "b": "Longer now."}), root)
    assert status(second) == {"doc-a": "unchanged", "doc-b": "updated", "doc-c": "failed"}
    chunks = corpus.corpus(spark, root).collect()
    assert [r.text for r in chunks if r.source_id == "doc-b"] == ["Longer now."]
    assert [(r.source_id, r.chunk_index) for r in chunks] == sorted((r.source_id, r.chunk_index) for r in chunks) and len(chunks) > 3
    total = corpus.corpus_totals(second).first()
    assert (total.total_sources, total.total_chunks, total.total_characters) == (2, len(chunks), sum(len(r.text) for r in chunks))
    assert status(corpus.chunking_run(spark, docs_of(spark, {"b": "Longer now."}), root, force=True)) == {"doc-a": "unchanged", "doc-b": "updated", "doc-c": "failed"}
    other = corpus.chunking_run(spark, docs_of(spark, {"b": "Longer now."}), root, chunking.Sizes(overlap=100))
    assert status(other)["doc-b"] == "updated"


def test_document_run(spark, tmp_path):
    page = "<html><body><main><h1>Title</h1>" + "".join(f"<p>Paragraph {i} with some words of text.</p>" for i in range(12)) + "</main></body></html>"
    pages = spark.createDataFrame([("a", page), ("b", "<p>short</p>"), ("c", page), ("e", page)], "source_id string, html string")
    sha = {r.source_id: r.sha for r in pages.selectExpr("source_id", "sha2(html, 256) AS sha").collect()}
    noted = [("a", "new", sha["a"]), ("b", "new", sha["b"]), ("c", "new", "0" * 64), ("d", "new", None), ("e", "failed", None)]
    manifest = spark.createDataFrame(noted, "source_id string, status string, sha256 string")
    registered = spark.createDataFrame([(k,) for k in "abcdef"], "source_id string")
    want = {"a": ("processed", None), "b": ("failed", "too short"), "c": ("failed", "checksum differs"), "d": ("failed", "no file"), "e": ("failed", "failed before"), "f": ("failed", "no manifest entry")}
    got = {r.source_id: (r.status, r.error) for r in corpus.document_run(spark, registered, manifest, pages, f"{tmp_path}/out").collect()}
    assert got == want
    again = {r.source_id: (r.status, r.error) for r in corpus.document_run(spark, registered, manifest, pages, f"{tmp_path}/out").collect()}
    assert again == want | {"a": ("unchanged", None)}
    forced = {r.source_id: (r.status, r.error) for r in corpus.document_run(spark, registered, manifest, pages, f"{tmp_path}/out", force=True).collect()}
    assert forced == want
    stored = corpus.documents(spark, f"{tmp_path}/out").collect()
    assert len(stored) == 1 and stored[0].elements[0].text == "Title" and stored[0].total_characters == sum(len(e.text) for e in stored[0].elements)
    assert chunking.chunk_rows(corpus.documents(spark, f"{tmp_path}/out")).count() >= 1


def test_embedding_run(spark, tmp_path):
    schema = "chunk_id string, source_id string, content_sha256 string, text string"
    chunks = spark.createDataFrame([("1", "s", "x", "aa"), ("2", "s", "y", "b")], schema)
    known = spark.createDataFrame([("1", "s", "x", "m", 1, [9.0]), ("0", "s", "w", "m", 1, [8.0]), ("z", "t", "q", "m", 1, [7.0])], "chunk_id string, source_id string, content_sha256 string, model string, dimensions int, embedding array<float>")
    one = corpus.embedding_run(chunks, known, lambda texts: [[float(len(t))] for t in texts], "m", 1, f"{tmp_path}/index").first()
    assert (one.total_chunks, one.embedded_chunks, one.unchanged_chunks, one.deleted_stale_chunks, one.source_count) == (2, 1, 1, 1, 1)
    assert {r.chunk_id: r.embedding for r in spark.read.parquet(f"{tmp_path}/index").collect()} == {"1": [9.0], "2": [1.0], "z": [7.0]}
    with pytest.raises(Exception, match="repeats"):
        corpus.embedding_run(chunks.union(chunks), known, None, "m", 1, f"{tmp_path}/other")
    with pytest.raises(Exception, match="empty"):
        corpus.embedding_run(chunks.limit(0), known, None, "m", 1, f"{tmp_path}/other")


def test_evaluation_run(spark, tmp_path):
    def case(name, **more):
        return {"case_id": name, "category": "market", "question": name, "history": [], "expected_route": "market", "required_tools": ["get_market_overview"], "allowed_tools": ["get_market_overview"], "citations_required": False, "expected_charts": [], "memory_expected": False, "required_terms": ["prix"], **more}

    (tmp_path / "suite.json").write_text(json.dumps({"cases": [case("good"), case("fails"), case("wrong"), case("other", category="dpe")]}))
    cases = conversation.suite(spark, f"{tmp_path}/suite.json")
    chosen = conversation.selected_cases(cases, category="market")
    assert [r.case_id for r in chosen.collect()] == ["good", "fails", "wrong"]
    assert [r.case_id for r in conversation.selected_cases(cases, ids=("wrong", "good"), most=1).collect()] == ["good"]
    for bad in ({"ids": ("none",)}, {"most": 0}, {"category": "none"}):
        with pytest.raises(ValueError):
            conversation.selected_cases(cases, **bad)

    def answer(question, history):
        if question == "fails":
            raise KeyError(question)
        route = "market" if question == "good" else "dpe"
        return {"route": route, "successful_tools": ["get_market_overview"], "failed_tools": [], "n_citations": 0, "charts": [], "memory_used": False, "model": "m", "answer": "Le prix"}

    one = conversation.evaluation_run(chosen, answer, f"{tmp_path}/out").first()
    assert (one.cases, one.passed_cases) == (3, 1)
    results = {r.case_id: (r.passed, r.error_type) for r in spark.read.json(f"{tmp_path}/out/results").collect()}
    assert results == {"good": (True, None), "fails": (False, "KeyError"), "wrong": (False, None)}


@pytest.mark.parametrize("shared", [False, True])
def test_acquired_files(spark, tmp_path, shared):
    store, folder = (fetch.Shared(spark), f"file://{tmp_path}") if shared else (fetch.Local(), f"{tmp_path}")
    body, calls = gzip.compress(b"a,b\n1,2\n"), []

    def transport(url):
        calls.append(url)
        return 200, {}, body if url != "bad" else body[:-9]

    first = fetch.acquired_years(transport, {2021: "u"}, folder, files=store)
    again = fetch.acquired_years(transport, {2021: "u"}, folder, {2021: first[2021][1]}, files=store)
    assert first[2021][2] == "downloaded" and again[2021][2] == "reused" and calls == ["u"]
    with pytest.raises(fetch.FetchError):
        fetch.acquired_years(transport, {2022: "bad"}, folder, files=store)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["2021.csv.gz"] and (tmp_path / "2021.csv.gz").read_bytes() == body
    big = gzip.compress(bytes(range(256)) * 40_000, 0)  # several pieces
    assert store.kept(f"{folder}/big", big) == store.sha256(f"{folder}/big") == hashlib.sha256(big).hexdigest() and store.sha256(f"{folder}/none") is None


def test_acquired_snapshot(tmp_path):
    def transport(url, total=3):
        page = {"u": {"results": [{"a": 1}, {"a": 2}], "next": "v"}, "v": {"results": [{"a": 3}]}}[url]
        return 200, {}, json.dumps({"total": total, **page}).encode()

    folder = f"{tmp_path}/s"
    assert not fetch.snapshot_is_valid(folder)
    assert fetch.acquired_snapshot(transport, "u", folder) == "downloaded" and fetch.snapshot_is_valid(folder)
    assert fetch.acquired_snapshot(None, "u", folder) == "reused"
    with pytest.raises(fetch.FetchError):
        fetch.acquired_snapshot(lambda u: transport(u, 4), "u", folder, refresh=True)
    assert fetch.snapshot_is_valid(folder)
    (tmp_path / "s" / "snapshot.json").write_text("{}")
    assert not fetch.snapshot_is_valid(folder)


def test_beside_answers(spark):
    marks = [("[INSUFFICIENT_CONTEXT] : no", True, "no"), (" yes\n", False, "yes"), ("[INSUFFICIENT_CONTEXT]", True, None), (None, False, None)]
    got = corpus.checked_answers(spark.createDataFrame([(m[0],) for m in marks], "text string"), "text").collect()
    assert [(r.insufficient, r.text) for r in got] == [m[1:] for m in marks]
    given = ['{"a": 1}', '{"a": ', "[1]", None, "", "3"]
    read = tools.checked_arguments(spark.createDataFrame([(g,) for g in given], "arguments string")).collect()
    assert [r.arguments for r in read] == ['{"a": 1}', tools.INVALID_ARGUMENTS, tools.INVALID_ARGUMENTS, "{}", tools.INVALID_ARGUMENTS, tools.INVALID_ARGUMENTS]
    rows = spark.createDataFrame([(0, 13, 5.0), (1, 1, None), (2, 1, 4.0)], "position int, arrondissement int, median double")
    assert [tuple(r) for r in tools.tool_chart("compare_arrondissements", rows).collect()] == [(0, "Paris 13e", 5.0), (1, "Paris 1er", 4.0)]
    assert tools.tool_chart("rank_arrondissements", rows) is None
