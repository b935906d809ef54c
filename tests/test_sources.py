import json

from pyspark.sql import functions as F

from lodestrata.functions.formulas import round_tenth
from lodestrata.plans.ingest import ingest_documents
from lodestrata.plugins import EchoGenerator, HashingEmbedder, JsonPageDecoder, answers, embedding, generated_variants, synonym_variants
from lodestrata.schema import PAGE, RAW_PAGE
from lodestrata.sources import files
from lodestrata.sources.pages import merge_spans, page_models
from lodestrata.sources.store import VectorStore, index_chunks
from lodestrata.streaming.incremental import index_stream


def chunk(i, **more):
    return {"chunk_id": f"c{i}", "source": "a-B51.pdf", "version": "5.1", "page_start": 1, "page_end": 1, "section_path": ["6"], "section_title": "Bus", "heading_level": 1, "content_type": "text", "is_front_matter": False, "chunk_index": i, "text": f"the text of chunk number {i}", "raw_text": f"the text of chunk number {i}", "is_row_chunk": False} | more


def write(path, rows, extra=""):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + extra, encoding="utf-8")


def test_index_twice_adds_nothing(spark, tmp_path):
    write(tmp_path / "a_chunks.jsonl", [chunk(1), chunk(2), chunk(2), chunk(3, content_type="definition", term="X"), chunk(4, is_front_matter=True)], "\n{broken\n")
    good, bad = files.read_chunks(spark, str(tmp_path / "a_chunks.jsonl"))
    assert good.count() == 5 and bad.count() == 1
    store = VectorStore(spark, str(tmp_path / "store"))
    assert index_chunks(store, good, HashingEmbedder)["indexed"] == 3
    assert index_chunks(store, good, HashingEmbedder)["indexed"] == 0
    assert store.count() == {"docs": 3, "glossary": 1}
    q = spark.createDataFrame([(1, "chunk number 2")], "query_id int, query string").withColumn("vector", embedding(HashingEmbedder, F.col("query")))
    assert store.query(q, 1).first().id == "c2"
    meta = store.collection().filter("id = 'c1'").first().metadata
    assert "term" not in meta and meta["section_path"] == "6"


def test_stream_adds_arrivals(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = VectorStore(spark, str(tmp_path / "store"))
    for i in (1, 2):
        write(folder / f"{i}.json", [chunk(i), chunk(1)])
        index_stream(spark, str(folder), store, HashingEmbedder, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.count()["docs"] == 2


def test_unvalidated_defaults(spark, tmp_path):
    write(tmp_path / "b.jsonl", [{"chunk_id": "x", "raw_text": "r"}])
    good, _ = files.read_chunks(spark, str(tmp_path / "b.jsonl"), validated=False)
    row = good.first()
    assert row.text == "r" and row.section_path == [] and row.is_row_chunk is False
    assert files.read_chunks(spark, str(tmp_path / "b.jsonl"))[0].count() == 0


def test_chunk_files_round_trip(spark, tmp_path):
    write(tmp_path / "a.jsonl", [chunk(1), chunk(2, source="é.pdf")])
    good, _ = files.read_chunks(spark, str(tmp_path / "a.jsonl"))
    files.write_chunks(good.drop("file"), str(tmp_path / "out"))
    assert files.read_chunks(spark, str(tmp_path / "out"))[0].select(*good.drop("file").columns).exceptAll(good.drop("file")).count() == 0


def test_documents_through_a_decoder(spark, tmp_path):
    page = {"page_num": 1, "width": 600.0, "height": 800.0, "text_blocks": [{"x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0, "text": "hello", "font_size": 9.0, "font_flags": 0, "block_no": 0}], "table_blocks": [{"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "rows": [["a", None]]}]}
    (tmp_path / "spec-B51.pages").write_text(json.dumps(page))
    pages = files.read_documents(spark, str(tmp_path), JsonPageDecoder, "*.pages")
    assert pages.first().version == "5.1"
    assert files.blocks(pages, "text_blocks").first().text == "hello"
    assert files.blocks(pages, "table_blocks").first().rows == [["a", None]]


def test_spans(spark):
    kind = "spans array<struct<text string, size double, flags int>>"
    rows = [([("Page 3", 9.0, 1), ("a", 9.0, 1), None, ("b", 9.5, 4)],), ([(None, 9.0, 1), ("", None, 2)],), ([("x", None, None)],), ([],), (None,)]
    got = spark.createDataFrame(rows, kind).select(merge_spans(F.col("spans")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in got] == [("a b", 9.2, 4), ("", 0.0, 0), ("x", 0.0, 0), ("", 0.0, 0), ("", 0.0, 0)]


def test_round_tenth_is_pythons(spark):
    xs = [n / d for n in range(0, 400) for d in (1, 3, 4, 7, 8, 20, 100)] + [9.35, 2.675, 123456.75, 0.05, 1e9 + 0.25]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_tenth(F.col("x")).alias("r")).collect()
    assert [(r.x, r.r) for r in got] == [(r.x, round(r.x, 1)) for r in got]


BOXES = [(0.0, 0.0, 80.0, 80.0), (83.0, 0.0, 90.0, 80.0), (300.0, 300.0, 310.0, 310.0), (5.0, 5.0, 5.0, 60.0)]


def raw_page(no, **more):
    row = {"source": "a-B51.pdf", "version": "5.1", "page_num": no, "width": 600.0, "height": 800.0, "blocks": None, "drawings": None, "images": None, "edges": None, "ruled_tables": None, "aligned_tables": None}
    return row | more


def lines(*tops):
    return [("h", 0.0, 500.0, t, t) for t in tops] + [("v", 0.0, 500.0, t + 12, t + 12) for t in tops]


def test_raw_pages_become_page_models(spark):
    wide = [["Heading"] + [None] * 9, ["a"] * 10]
    table = lambda x, rows: (x, 0.0, 9.0, 9.0, rows)
    body = [["Bit", " i "], [None, ""], ["0", "e•MMC"]]
    raw = [
        raw_page(1, blocks=[(0, 1.0, 100.0, 9.0, 110.0, 3, [("e•MMC", 10.0, 1), ("bus", 11.0, 2)]), (1, 1.0, 100.0, 9.0, 110.0, 4, [("image", 1.0, 1)]), (0, 1.0, 20.0, 9.0, 30.0, 5, [("header", 9.0, 0)]), (0, 1.0, 200.0, 9.0, 210.0, 6, [("Page 4", 9.0, 0)])]),
        raw_page(2, drawings=BOXES, images=[(7, 3, 4, []), (8, 5, 6, [(1.0, 2.0, 3.0, 4.0), (9.0, 9.0, 9.0, 9.0)]), (9, 1, 1, None)]),
        raw_page(3, ruled_tables=[table(1.0, body), table(2.0, wide)], aligned_tables=[table(3.0, body)]),
        raw_page(4, ruled_tables=[], aligned_tables=[table(3.0, body)], edges=lines(100.0)),
        raw_page(5, aligned_tables=[table(3.0, body)], edges=lines(100.0, 122.0)),
        raw_page(6, aligned_tables=[table(3.0, [[None, "i"]])], edges=lines(100.0, 180.0)),
        raw_page(6, version=None),
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in raw], RAW_PAGE).withColumn("extra", F.lit(1))
    got = page_models(df)
    assert got.schema.simpleString() == PAGE.simpleString()
    by = {(r.page_num, r.version): r for r in got.collect()}
    assert [tuple(b) for b in by[1, "5.1"].text_blocks] == [(1.0, 100.0, 9.0, 110.0, "e*MMC bus", 10.5, 2, 3)]
    assert [tuple(d) for d in by[2, "5.1"].drawing_clusters] == [(0.0, 0.0, 90.0, 80.0, 7200.0, 2)]
    assert [tuple(i) for i in by[2, "5.1"].image_blocks] == [(1.0, 2.0, 3.0, 4.0, 8, 5, 6)]
    cleaned = [["Bit", None], ["0", "e*MMC"]]
    assert [(t.x0, t.rows) for t in by[3, "5.1"].table_blocks] == [(1.0, cleaned)]
    assert [(t.x0, t.rows) for t in by[4, "5.1"].table_blocks] == [(3.0, cleaned)]
    assert by[5, "5.1"].table_blocks == [] and by[6, "5.1"].table_blocks == []
    assert list(by[6, None])[5:] == [[], [], [], []] and len(by) == 7
    assert page_models(df.limit(0)).count() == 0


def test_documents_with_their_outlines(spark, tmp_path):
    block = {"type": 0, "x0": 50.0, "y0": 100.0, "x1": 300.0, "y1": 112.0, "block_no": 0, "spans": [{"text": "The bus is wide and has", "size": 9.0, "flags": 0}, {"text": "eight lines.", "size": 9.0, "flags": 0}]}
    rows = [{"toc": [[1, "1 Bus", 0], [2, "1.1 Lines", 1]]}, {"page_num": 1, "width": 600.0, "height": 800.0, "blocks": [block]}, {"page_num": 2, "width": 600.0, "height": 800.0, "blocks": [block]}]
    (tmp_path / "spec-B51.pages").write_text("".join(json.dumps(r) + "\n" for r in rows))
    toc = files.read_toc(spark, str(tmp_path), JsonPageDecoder, "*.pages")
    assert [tuple(r) for r in toc.orderBy("toc_ord").collect()] == [("spec-B51.pages", 0, 1, "1 Bus", 1), ("spec-B51.pages", 1, 2, "1.1 Lines", 2)]
    assert files.read_toc(spark, str(tmp_path), JsonPageDecoder, "*.pages", page_offset=0).agg(F.min("page_start")).first()[0] == 0
    got = ingest_documents(spark, str(tmp_path), JsonPageDecoder, "*.pages").orderBy("page_start").collect()
    assert [(r.section_title, r.raw_text) for r in got] == [("Bus", "The bus is wide and has eight lines."), ("Lines", "The bus is wide and has eight lines.")]


def test_plugins(spark):
    df = spark.createDataFrame([("HPI mode\nlast",), (None,)], "q string")
    assert df.select(synonym_variants(F.col("q"), {"HPI": "high priority interrupt"}).alias("v")).first().v == ["high priority interrupt mode\nlast"]
    assert [r.a for r in df.select(answers(EchoGenerator, F.col("q")).alias("a")).collect()] == ["last", ""]
    assert df.select(generated_variants(EchoGenerator, F.col("q")).alias("v")).first().v == ["last"]
