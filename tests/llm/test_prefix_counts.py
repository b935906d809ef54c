import random

import pytest

import public_tokenizers
from lodestrata.llm import prefix_counts as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def count():
    with open(MODEL, "rb") as f:
        return P.counter(f.read())


def steps(count, text):
    out = []
    for _, s, _ in count.parts([text]):
        out.extend(s.tolist())
    return out


def samples():
    rnd = random.Random(3)
    words = "the of and in Straße naïve être élève 日本語 тест 😀 <s> </s> <unk> <0x0A> ▁ aaaa ---- \t \n 12345 don't ﬁ ½ ​ ﻿ \x00 É".split(" ")
    for _ in range(150):
        yield "".join(rnd.choice(words) + " " * rnd.choice([0, 1, 1, 1, 2, 5, 17, 33]) for _ in range(rnd.randrange(1, 25)))
    for alphabet in ("ab", "▁ a", "aeinrst ", "=-", "0123456789"):
        for _ in range(60):
            yield "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 60)))


def test_totals_match_the_library(count, library):
    for text in samples():
        assert sum(steps(count, text)) == len(library.encode(text)), text


def test_every_prefix_matches_the_library(count, library):
    for text in list(samples())[::9]:
        n = 0
        for i, s in enumerate(steps(count, text)):
            n += s
            assert n == len(library.encode(text[: i + 1])), text[: i + 1]


def test_long_texts_in_parts(count, library, monkeypatch):
    monkeypatch.setattr(P, "PART", 50)
    for text in ["one two  three " * 20, "a" * 300, "x" + " " * 200 + "y", "日本語" * 50, "a" * 51]:
        assert sum(steps(count, text)) == len(library.encode(text))
        assert len(steps(count, text)) == len(text)


def test_documents(spark, sf, library, uri):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in P.totals(P.prefix_table(docs, MODEL, uri("p")), 4096).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(library.encode(r.text or ""))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 4096)


def test_budgets_without_encoding(spark, odd_docs, library, uri, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 64)
    table = P.prefix_table(odd_docs, MODEL, uri("p"))
    texts = sorted((r.text or "" for r in odd_docs.collect()), key=len)
    cut = lambda t, b: next(i for i in range(len(t), -1, -1) if len(library.encode(t[:i])) <= b)
    for budget in (0, 1, 3, 7):
        got = P.truncated(table, budget).collect()
        assert len(got) == len(texts)
        assert sorted(r.n_chars for r in got) == sorted(cut(t[:200], budget) for t in texts)
    for n in (0, 5, 70):
        assert sorted((r.n_chars, r.n_tokens) for r in P.tokens_at(table, n).collect()) == sorted((len(t[:n]), len(library.encode(t[:n]))) for t in texts)


def test_odd_and_empty_tables(spark, odd_docs, no_docs, library, uri):
    got = P.totals(P.prefix_table(odd_docs, MODEL, uri("p")), 4096).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert P.totals(P.prefix_table(no_docs, MODEL, uri("q")), 4096).collect() == []


def test_other_models_are_refused(count):
    with pytest.raises(Exception):  # noqa: B017
        P.PrefixCounter(b"no model")
