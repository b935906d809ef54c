import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import bpe_trie, segment, token_store

BYTE, WORD = (open(public_tokenizers.path(n), encoding="utf-8").read() for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
T3, T6 = Tokenizer.from_str(BYTE), Tokenizer.from_str(WORD)
TEXTS = ["", " ", "It's don't we'll 's's ''s I'VE they're\n'd x'tx", "日本語 naïve İstanbul", "a<|endoftext|>b <|startoftext|>", "12 5.6% »q« …—–", "é café ﬁ", "\x1c\x85   a", "aaaa" * 40, "ǅ ŉ ß ẞ", "😀😀 ok", "' 's ''' 've", " 's \t's\n's", "a\n b\n  c \r\n d  "]
some_text = st.text(alphabet=st.one_of(st.sampled_from("ab cdeTHE'stvl.\n\t 019é—"), st.characters(exclude_categories=["Cs"])), max_size=60)


def check_trie(texts):
    for t, (ids, shown) in zip(texts, bpe_trie.encode_texts(*bpe_trie.encoder(WORD), texts), strict=True):
        want = T6.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert shown.decode() == T6.decode(want, skip_special_tokens=False)


def check_byte(texts):
    ids, lengths = token_store.byte_bpe(BYTE).encode(texts)
    want = [T3.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_edge_texts():
    check_trie(TEXTS)
    check_byte(TEXTS)


@given(st.lists(some_text, max_size=5))
@settings(max_examples=200, deadline=None)
def test_any_texts(texts):
    check_trie(texts)
    check_byte(texts)


@given(st.lists(st.integers(0, 300), max_size=700), st.integers(0, 3))
@settings(max_examples=80, deadline=None)
def test_codes_round_trip(ids, extra):
    ids = np.array([i**2 % 301 for i in ids] + [7] * extra, np.int32)
    counts = np.bincount(ids, minlength=301)
    sizes = token_store.code_lengths(counts)
    assert (sizes[counts > 0] > 0).all() and (sizes[counts == 0] == 0).all()
    assert (0.5 ** sizes[sizes > 0].astype(float)).sum() <= 1
    offsets, payload = token_store.pack(ids, token_store.canonical(sizes), sizes)
    assert token_store.unpack(payload, offsets, len(ids), token_store.decode_table(sizes)).tolist() == ids.tolist()


def test_length_limit_and_optimum():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946, 17711])
    limited = token_store.code_lengths(counts)
    assert limited.max() <= token_store.MAX_BITS and (0.5 ** limited.astype(float)).sum() <= 1
    heap, total = counts[-8:].tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((token_store.code_lengths(counts[-8:]) * counts[-8:]).sum()) == total


def expected(rows, end=2):
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)).astype(np.int64), r[1] or "")):
        ids = [*T3.encode(text or "", add_special_tokens=False).ids, end]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(odd_docs, uri):
    manifest = token_store.write_tokens(odd_docs, BYTE, uri("tokens"))
    got = [tuple(r) for r in token_store.read_tokens(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    ids = token_store.read_tokens(manifest, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in ids)


def test_files_are_rolled_and_a_common_key_is_split(spark, uri, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_BYTES", 2_000)
    rows = [(7 if i % 2 else i, f"the bus {i} width of a card " * 20) for i in range(120)] + [(None, "x")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        manifest = token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, uri("tokens"))
        assert manifest.count() > 8
        assert sorted((tuple(r) for r in token_store.read_tokens(manifest).collect()), key=lambda r: r[1]) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_colliding_hashes_give_right_ids(monkeypatch):
    """Pieces whose hashes are equal are told apart by their characters."""
    whole = segment._hashes
    monkeypatch.setattr(segment, "_hashes", lambda *a: whole(*a) % np.uint64(5))
    texts = ["the bus width of a card is 8 bits", "cards and buses, widths", "the the bus"]
    bpe, cache = bpe_trie.TrieBpe(WORD), segment.PieceCache()
    for _ in range(2):
        for t, (ids, _) in zip(texts, bpe_trie.encode_texts(bpe, cache, texts), strict=True):
            assert ids.tolist() == T6.encode(t, add_special_tokens=False).ids
    byte = token_store.ByteBpe(BYTE)
    for _ in range(2):
        assert byte.encode(texts)[0].tolist() == [i for t in texts for i in T3.encode(t, add_special_tokens=False).ids]


def test_long_words_lines_and_scripts():
    rng = np.random.default_rng(3)
    word = "".join(rng.choice(list("abcdefgh"), 300_000))
    texts = [word, "word and " * 300_000, "日本語" * 20_000, word[:70] + " " + word[:64] + " " + word[:65]]
    check_trie(texts)
    check_byte(texts)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(segment, "WINDOW", 7)
    cache, bpe = segment.PieceCache(most=20, most_chars=100), bpe_trie.TrieBpe(WORD)
    for k in range(6):
        texts = [f"w{k}x{i} and the longerword{i}" for i in range(9)]
        for t, (ids, _) in zip(texts, bpe_trie.encode_texts(bpe, cache, texts), strict=True):
            assert ids.tolist() == T6.encode(t, add_special_tokens=False).ids


def test_range_read(spark, uri, tmp_path):
    docs = spark.createDataFrame([(i, "the bus width of a card " * i) for i in range(60)], "doc_id long, text string")
    manifest = token_store.write_tokens(docs, BYTE, uri("tokens"))
    name = manifest.orderBy("first").first().file.removeprefix("file://")
    with open(name, "rb") as f:
        t = token_store.TokenFile(f)
        table = token_store.decode_table(t.code_sizes)
        whole = t.read(0, t.n_ids, table)
        for a, b in ((0, 1), (127, 129), (5, t.n_ids), (t.n_ids - 1, t.n_ids), (3, 3)):
            assert t.read(a, b, table).tolist() == whole[a:b].tolist()


@pytest.mark.parametrize("frame", ["write", "encode"])
def test_empty_tables(no_docs, uri, frame):
    if frame == "write":
        assert token_store.read_tokens(token_store.write_tokens(no_docs, BYTE, uri("tokens"))).count() == 0
    else:
        assert bpe_trie.encode_frame(no_docs, WORD).count() == 0


def test_trie_frame(odd_docs):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_trie.encode_frame(odd_docs, WORD).collect())
    want = []
    for r in odd_docs.collect():
        ids = T6.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(T6.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
