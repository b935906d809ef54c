import json

import pytest
from pyspark.sql import functions as F

from lodestrata import cli
from lodestrata.operators import answers, evaluate, retrieval
from lodestrata.plugins import EchoGenerator, HashingEmbedder, embedding
from lodestrata.sources.keywords import KeywordIndex

from .test_sources import chunk, write


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"c{i}", i, "5.1" if i % 2 else "5.0", "a-B51.pdf", ["6"], "Bus", f"the bus width {i} of a card" + " wide" * (i % 3), "text", i, i) for i in range(12)]
    c = spark.createDataFrame(rows, "id string, pos long, version string, source string, section_path array<string>, section_title string, raw_text string, content_type string, page_start int, page_end int")
    return c.withColumn("text", F.col("raw_text"))


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "bus width 3"), (2, "what is the bus"), (3, "compare 5.0 and 5.1 wide"), (4, "zzz")]
    return spark.createDataFrame(rows, "query_id int, query string").withColumn("vector", embedding(HashingEmbedder, F.col("query")))


def test_stored_index_is_the_unstored_search(spark, tmp_path, chunks, asked):
    index = KeywordIndex(spark, str(tmp_path / "k"))
    assert index.size() == 0
    with pytest.raises(ValueError, match="no keyword index"):
        index.terms()
    assert index.append(chunks.filter("pos < 5"), F.col("raw_text")) == 5
    assert index.append(chunks, F.col("raw_text")) == 7 and index.append(chunks, F.col("raw_text")) == 0
    again = KeywordIndex(spark, str(tmp_path / "k"))
    want = retrieval.bm25_search(asked, chunks, F.col("raw_text"), 5)
    show = lambda df: sorted((r.query_id, r.pos, round(r.score, 9), r.rank) for r in df.collect())
    assert show(again.search(asked, 5)) == show(want) and again.size() == 12
    assert "pushed" in again.scores(asked)._jdf.queryExecution().executedPlan().toString().lower()


def test_index_of_no_text(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "k"))
    assert index.append(spark.createDataFrame([(1, None), (2, "")], "pos int, raw string"), F.col("raw")) == 2
    with pytest.raises(ValueError, match="no keyword index"):
        index.search(spark.createDataFrame([(1, "a")], "query_id int, query string"))


def _retrieve(chunks, use_bm25):
    vectors = chunks.select("id", "version", embedding(HashingEmbedder, F.col("raw_text")).alias("vector"))
    return lambda q: retrieval.hybrid(q, chunks, vectors, "", use_bm25, most=9.0)


def test_pipelines(spark, chunks, asked):
    glossary = chunks.filter("pos < 2").withColumn("document", F.col("text")).withColumn("vector", embedding(HashingEmbedder, F.col("text"))).select("id", "document", "source", "page_start", "vector")
    got = answers.evaluated(asked, {"dense_rag": _retrieve(chunks, False), "hybrid_rag": _retrieve(chunks, True)}, chunks, EchoGenerator, glossary, ["5.0", "5.1"]).collect()
    assert sorted((r.pipeline, r.query_id) for r in got) == sorted((p, i) for p in ("agent", "dense_rag", "hybrid_rag") for i in (1, 2, 3, 4))
    by = {(r.pipeline, r.query_id): r for r in got}
    assert by["hybrid_rag", 1].response == "Question: bus width 3" and by["hybrid_rag", 1].contexts[0].startswith("the bus width 3 ")
    assert all(len(r.contexts) <= answers.CONTEXTS for r in got if r.pipeline != "agent")
    agent = by["agent", 3].contexts
    assert any("[5.0]" in c and "[5.1]" in c for c in agent) and any("Cite-as" in c for c in agent)
    assert any(c.startswith("[1] a-B51.pdf p.") for c in by["agent", 2].contexts)
    hits = _retrieve(chunks, True)(asked)
    n = answers.retrieval_counts(hits).first()
    assert n.n_docs == len({r.id for r in hits.collect()}) and n.n_queries == len({r.query_id for r in hits.collect()})
    assert [r.query_id for r in answers.first_questions(asked, 2, "query_id").collect()] == [1, 2]


def test_report_and_totals(spark, chunks):
    rows = [("dense_rag", "q1", "factual", "a long question about the bus width of a card", 0.5, 1.0, None, float("nan")), ("hybrid_rag", "q1", "factual", "a long question about the bus width of a card", 0.75, 0.5, None, 1.0), ("hybrid_rag", "q2", "edge_case", "short", 0.25, None, None, 0.0)]
    results = spark.createDataFrame(rows, "pipeline string, id string, type string, question string, " + ", ".join(f"{m} double" for m in evaluate.METRICS))
    lines = answers.report(results)
    assert "| dense_rag | 0.5000 | 1.0000 | — | — |" in lines and "| hybrid_rag | 0.5000 | 0.5000 | — | 0.5000 |" in lines
    assert "| factual | 1 | 0.7500 | 0.5000 | — | 1.0000 |" in lines and "| answer_relevancy | 1.0000 | 0.5000 | -0.5000 |" in lines and "| faithfulness | 0.5000 | 0.5000 | +0.0000 |" in lines
    assert "| q1 | factual | 0.7500 | 0.5000 | — | 1.0000 | a long question about the bus … |" in lines
    got = {r.version: (r.total, r.searchable, r.skipped) for r in answers.index_totals(chunks, F.col("pos") < 5, "version").collect()}
    assert got == {"5.0": (6, 3, 3), "5.1": (6, 2, 4), None: (12, 5, 7)}


def test_verification(spark):
    q = spark.createDataFrame([(1, "one"), (2, "two")], "query_id int, query string")
    hits = spark.createDataFrame([(1, 1, 0.25, "a.pdf", 3, "6/6.1", "Bus", "x" * 2000), (1, 2, 0.5, "a.pdf", 4, "7", None, "y"), (1, 3, 0.6, "a", 1, "", "", "z")], "query_id int, rank int, distance double, source string, page_start int, section_path string, section_title string, document string")
    got = {r.query_id: r.report for r in answers.verification(q, hits).collect()}
    assert got[1].startswith("## one\n\n### Hit 1 (Score: 0.7500)\n- **Source**: a.pdf (Page 3)\n- **Path**: 6 > 6.1 > Bus\n\n```text\n" + "x" * 1000 + "\n```")
    assert "7 > Untitled" in got[1] and "Hit 3" not in got[1] and "No results found" in got[2]


def test_commands(spark, tmp_path, capsys, monkeypatch):
    write(tmp_path / "a_chunks.jsonl", [chunk(i) for i in range(4)])
    (tmp_path / "q.jsonl").write_text("".join(json.dumps({"id": f"q{i}", "type": "factual", "version": "5.1", "question": f"chunk number {i}", "reference": "r", "notes": ""}) + "\n" for i in range(3)))
    common = ["--chunks", str(tmp_path / "a_chunks.jsonl"), "--store", str(tmp_path / "s"), "--version", "5.1"]
    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.main(["index", str(tmp_path / "a_chunks.jsonl"), "--store", str(tmp_path / "s")])
    cli.main(["build-bm25", str(tmp_path / "a_chunks.jsonl"), "--keywords", str(tmp_path / "k")])
    cli.main(["ask", "chunk number 2", *common])
    assert "searching by vectors alone" in capsys.readouterr().err
    common += ["--keywords", str(tmp_path / "k")]
    cli.main(["ask", "chunk number 2", "--show-sources", "--expand", *common])
    monkeypatch.setattr("sys.stdin", iter(["chunk number 3\n", "reset\n", "\n", "chunk number 1\n", "memory\n", "version 5.0\n", "memory\n", "exit\n", "never\n"]))
    cli.main(["chat", *common, "--memory", str(tmp_path / "m")])
    cli.main(["eval", str(tmp_path / "q.jsonl"), str(tmp_path / "out"), "--first", "2", *common])
    cli.main(["verify", str(tmp_path / "q.jsonl"), str(tmp_path / "v"), *common])
    said = capsys.readouterr().out
    assert "Cite-as" in said and "the text of chunk number 2 [B51 §6 p.1]" in said and "a new memory" in said and "never" not in said
    kept = said[said.index("a new memory") :]
    assert "user: chunk number 1" in kept and "user: chunk number 3" not in kept and "system: 5.0" in kept
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    assert "### Hit 1" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "v")).collect())
