"""What is computed for a row is computed once."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestrata import plugins
from lodestrata.functions.text import trim_all
from lodestrata.operators import filters
from lodestrata.plans import catalog
from lodestrata.plans import views as V
from lodestrata.sources import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["page_texts", "page_tables"])
def test_pages_are_cleaned_once(spark, sf, name):
    assert plan(catalog.QUERIES[name](spark, sf)).count("JEDEC") == 1


def test_blocks_of_pages_with_none(spark):
    kind = "source string, version string, page_num int, width double, height double, text_blocks array<struct<text: string>>"
    pages = spark.createDataFrame([("a", None, i, 1.0, 1.0, b) for i, b in enumerate([[("x",), None, ("y",)], [], None])], kind)
    assert [tuple(r)[2:] for r in files.blocks(pages, "text_blocks").orderBy("block_ord").collect()] == [(0, 1.0, 1.0, 0, "x"), (0, 1.0, 1.0, 1, None), (0, 1.0, 1.0, 2, "y")]


def test_chunks_to_index_are_typed_once(spark, sf):
    assert plan(filters.indexable(V.chunks(spark, sf))).count("[0-9]{4}") == 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 20])
def test_least_lengths_without_blanks(spark, n):
    blanks = ["", " ", "\n\t ", "\u00a0", "\x85\u2003\u3000", "\x1c", "\u200b"]
    inner = ["", "a", "ab", "a b", "a  b", "\U0001f600", "\U0001f600\U0001f600", "x\u00a0\ny", "abcdefg", "abcdefgh", "a" + " " * 6 + "h", "a" + "\n" * 18 + "é", "a" * 19, "a" * 20]
    texts = [(a + t + b,) for a in blanks for t in inner for b in blanks] + [(None,)]
    got = spark.createDataFrame(texts, "t string").select("t", filters._has_chars(F.col("t"), n).alias("new"), (F.length(trim_all(F.col("t"))) >= n).alias("old")).collect()
    assert [(r.t, r.new) for r in got] == [(r.t, r.old) for r in got] and len({r.new for r in got if r.t is not None}) == (2 if n else 1)


def test_tokens_are_hashed_once(monkeypatch):
    calls, real = [], hashlib.blake2b
    monkeypatch.setattr(plugins.hashlib, "blake2b", lambda *a, **k: calls.append(a) or real(*a, **k))
    model = plugins.HashingEmbedder(8)
    first = model.embed(["Bus bus, 8_bit", "bus", "", None])
    assert model.embed(["Bus bus, 8_bit", "bus", "", None]) == first and len(calls) == 2


@pytest.mark.parametrize("most", [1, 3, 1 << 18])
def test_vectors_by_their_definition(most):
    texts = ["", None, "İstanbul K ſ ÀÉ_x", "a\x00b\x1cc\x85d e", "٣3 x x x y", " ", "é" * 5 + "z9_"]
    model = plugins.HashingEmbedder(5)
    model._places.most = most
    for text, vector in zip(texts, model.embed(texts), strict=True):
        sums = [0] * 5
        for w in re.findall("[a-z0-9_]+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            sums[h % 5] += 1 if h >> 63 else -1
        size = sum(x * x for x in sums) ** 0.5
        assert vector == pytest.approx([x / size if size else 0.0 for x in sums], abs=1e-6)
    assert len(model._places) <= most
