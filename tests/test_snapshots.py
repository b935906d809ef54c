import pytest
from pyspark.sql import functions as F

from lodestrata.operators import retrieval
from lodestrata.operators.threads import Threads
from lodestrata.plugins import HashingEmbedder
from lodestrata.sources.keywords import KeywordIndex
from lodestrata.sources.snapshots import Conflict, Snapshots, State
from lodestrata.sources.store import VectorStore, index_chunks
from tests.test_sources import chunk


def ids(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "id long")


def held(df):
    return sorted(r[0] for r in df.collect())


def test_states_and_readers(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.read("t") is None and s.state() == State()
    s.commit(lambda _: {"t": ("append", ids(spark, 1), [])})
    pinned = s.read("t")
    s.commit(lambda _: {"t": ("append", ids(spark, 2), [])})
    s.commit(lambda base: {"t": ("replace", s.read("t", base).filter("id > 1"), []), "u": ("append", ids(spark, 9), [])})
    assert held(pinned) == [1] and held(s.read("t")) == [2] and held(s.read("u")) == [9]
    assert held(s.read("t", s.state(2))) == [1, 2] and s.numbers() == [1, 2, 3]


@pytest.mark.parametrize("stop", [0, 1, 2])
def test_a_commit_that_stops_between_writes_shows_nothing(spark, tmp_path, monkeypatch, stop):
    s = Snapshots(spark, str(tmp_path / "s"))
    s.commit(lambda _: {"t": ("append", ids(spark, 1), []), "u": ("append", ids(spark, 1), [])})
    bad = ids(spark, 2).withColumn("id", F.raise_error(F.lit("stop")).cast("long"))
    changes = {"t": ("append", bad if stop == 0 else ids(spark, 2), []), "u": ("append", bad if stop == 1 else ids(spark, 2), [])}
    if stop == 2:
        monkeypatch.setattr(s, "_publish", lambda _: (_ for _ in ()).throw(OSError("stop")))
    with pytest.raises(Exception, match="stop"):
        s.commit(lambda _: changes)
    again = Snapshots(spark, str(tmp_path / "s"))
    assert held(again.read("t")) == [1] and held(again.read("u")) == [1]
    assert {f.name for t in "tu" for f in (tmp_path / "s" / t).iterdir()} == {again.state().tables[t]["folders"][0] for t in "tu"}


def test_commits_that_meet(spark, tmp_path):
    s, other, calls = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, str(tmp_path / "s")), []

    def build(base):
        calls.append(base.number)
        if len(calls) == 1:  # another commit comes between
            other.commit(lambda _: {"t": ("append", ids(spark, 7), [])})
        known = s.read("t", base)
        return {"t": ("append", ids(spark, 7, 8) if known is None else ids(spark, 7, 8).join(known, "id", "left_anti"), [])}

    s.commit(build)
    assert calls == [0, 1] and held(s.read("t")) == [7, 8]
    with pytest.raises(Conflict):
        s.commit(lambda _: other.commit(lambda _: {"t": ("append", ids(spark, 0), [])}) and {"t": ("append", ids(spark, 5), [])}, tries=2)


def test_batches_count_once_and_vacuum(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    for batch in (0, 1, 1, 0, 2):
        s.commit(lambda _, b=batch: {"t": ("append", ids(spark, b), [])}, "w", batch)
    assert held(s.read("t")) == [0, 1, 2]
    s.compact("t")
    assert s.vacuum(older_than=3600) == 0 and s.vacuum(older_than=-60) == 3
    assert held(s.read("t")) == [0, 1, 2] and s.numbers() == [4]


def test_stores_keep_their_state_when_an_append_stops(spark, tmp_path, monkeypatch):
    rows = [(i, f"w{i % 3} w{i % 5} common") for i in range(20)]
    docs = spark.createDataFrame(rows, "pos long, text string")
    index = KeywordIndex(spark, str(tmp_path / "k"))
    assert index.append(docs.filter("pos < 10").unionByName(docs.filter("pos < 2")), F.col("text")) == 10
    q = spark.createDataFrame([(1, "w1 common")], "query_id int, query string")
    before = sorted(map(tuple, index.search(q, 5).collect()))
    with monkeypatch.context() as m:
        m.setattr(index.snapshots, "_publish", lambda _: (_ for _ in ()).throw(OSError("stop")))
        with pytest.raises(OSError, match="stop"):
            index.append(docs, F.col("text"))
    assert index.size() == 10 and sorted(map(tuple, index.search(q, 5).collect())) == before
    assert index.append(docs, F.col("text")) == 10
    assert not list((tmp_path / "k" / "_staged").iterdir())
    got = {(r.pos, round(r.score, 9)) for r in index.search(q, 30).collect()}
    assert got == {(r.pos, round(r.score, 9)) for r in retrieval.bm25_search(q, docs, F.col("text"), 30).collect()}


def test_refresh_replaces_and_definitions_are_the_glossary(spark, tmp_path):
    rows = spark.createDataFrame([chunk(1), chunk(2, content_type="definition", term="T")], ", ".join(f"{k} {t}" for k, t in KINDS.items()))
    store = VectorStore(spark, str(tmp_path / "v"))
    index_chunks(store, rows, HashingEmbedder)
    pinned = store.collection(state=store.snapshots.state())
    index_chunks(store, rows.filter("chunk_id = 'c1'").withColumn("text", F.lit("another text of the chunk")), HashingEmbedder, refresh=True)
    assert store.count() == {"docs": 2, "glossary": 1} and held(store.collection("glossary").select("id")) == ["c2"]
    assert {r.id: r.document for r in store.collection().collect()}["c1"] == "another text of the chunk"
    assert {r.id: r.document for r in pinned.collect()}["c1"] == "the text of chunk number 1"


KINDS = {
    "chunk_id": "string", "source": "string", "version": "string", "page_start": "int", "page_end": "int", "section_path": "array<string>", "section_title": "string", "heading_level": "int", "content_type": "string",
    "is_front_matter": "boolean", "chunk_index": "int", "text": "string", "raw_text": "string", "is_row_chunk": "boolean", "term": "string", "figure_caption": "string", "parent_chunk_id": "string",
}


def test_blocks_that_cannot_matter_are_left_out(spark, tmp_path, monkeypatch):
    from lodestrata.sources import keywords

    monkeypatch.setattr(keywords, "BLOCK", 8)
    monkeypatch.setattr(keywords, "SLICE", 300)  # the common word is cut into slices
    docs = spark.range(2000).select(F.col("id").alias("pos"), F.concat(F.lit("common "), F.repeat(F.lit("pad "), (F.pmod(F.hash("id"), F.lit(97))).cast("int")), F.when(F.col("id") % 40 == 0, F.repeat(F.lit("rare "), (F.col("id") % 7 + 1).cast("int"))).otherwise("")).alias("text"))
    index = KeywordIndex(spark, str(tmp_path / "k"))
    index.append(docs.filter("pos < 900"), F.col("text"))
    index.append(docs, F.col("text"))
    q = spark.createDataFrame([(1, "rare"), (2, "rare common"), (3, "rare rare pad"), (4, "none"), (5, None)], "query_id int, query string")
    show = lambda df: sorted((r.query_id, r.pos, round(r.score, 8), r.rank) for r in df.collect())
    assert show(index.search(q, 5)) == show(retrieval.bm25_search(q, docs, F.col("text"), 5))
    share = {r.query_id: (r.postings, r.read) for r in index.read_share(q, 5).collect()}
    assert share[1][0] == 50 and share[1][1] < 40 and set(share) == {1, 2, 3}


def test_threads(spark, tmp_path):
    t = Threads(spark, str(tmp_path / "t"))
    asked = spark.createDataFrame([("a", "deep"), ("b", "plain"), ("c", "odd"), ("d", "for ever")], "thread_id string, content string")
    t.post(asked, "w", 1)
    t.post(asked, "w", 1)

    def decide(rows):
        call = lambda tool: F.array(F.struct(F.lit(tool).alias("tool"), F.col("content").alias("input")), F.struct(F.lit("len").alias("tool"), F.col("content").alias("input")))
        again = F.when(F.col("content") == "for ever", call("same")).when((F.col("content") == "deep") & (F.col("n_messages") == 1), call("up")).when(F.col("content") == "odd", call("nothing"))
        return rows.select("thread_id", "epoch", F.array_join("outputs", "+").alias("content"), again.alias("calls"))

    tools = {"up": F.upper, "len": lambda x: F.when(x == "for ever", x).otherwise(F.length(x).cast("string")), "same": lambda x: x}
    assert t.run(decide, tools, 6) == 6
    rows = [tuple(r) for r in t.memory().select("thread_id", "seq", "role", "content", "tool").orderBy("thread_id", "seq").collect()]
    assert [r[1:] for r in rows if r[0] == "a"] == [(0, "user", "deep", None), (1, "assistant", "", None), (2, "tool", "DEEP", "up"), (3, "tool", "4", "len"), (4, "assistant", "DEEP+4", None)]
    assert [r[1:] for r in rows if r[0] == "b"] == [(0, "user", "plain", None), (1, "assistant", "", None)]
    assert [r[3] for r in rows if r[0] == "c"][2:] == ["There is no tool named nothing", "3", "There is no tool named nothing+3"]
    assert held(t.unfinished().select("thread_id")) == ["d"] and len([r for r in rows if r[0] == "d"]) == 10
    before = t.log().count()
    assert t.run(decide, tools, 0) == 0 and t.log().count() == before
    t.reset(asked.filter("thread_id <> 'b'"), "5.0")
    t.reset(asked.filter("thread_id = 'a'"), "5.0")
    t.reset(asked.filter("thread_id = 'c'"), "5.1")
    assert {r.thread_id: r.epoch for r in t.memory().collect()} == {"a": 1, "b": 0, "c": 2, "d": 1}
    assert t.run(decide, tools) == 0 and t.unfinished().count() == 0
