"""BPE encoding and decoding by prefix-sharing trie traversal (operator 6).

The distinct new words of a batch are inserted into a trie. A depth-first walk propagates the last token of each
prefix's encoding: a token t that ends at a node is the last one exactly when it and the last token of the prefix
before t are adjacent in some BPE encoding, i.e. no merge crosses their border while either is being built. There is
one such t for each prefix, so the encoding of a shared prefix is computed once for all words below it. A word's last
symbol carries the word-end suffix and is resolved at the word's leaf.

Rows never move: texts are read in Arrow batches, cut into pieces by `segment`, and each worker keeps a bounded cache
of piece -> ids. Memory is bounded by the cache and the batch, whatever the input's size.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches
from .segment import PieceCache, cut, is_safe, ragged


#: characters of a word that the trie holds; what is beyond is walked along the word itself
LONG = 64


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def byte_level(word: str, _table={}) -> str:  # noqa: B006
    if not _table:
        _table.update(enumerate(byte_chars()))
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_table)


class TrieBpe:
    """Encoder for one vocabulary with merges, in the tokenizers library's JSON format."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)  # its normaliser and pre-tokeniser only; the encoding is the trie's
        self.library.no_truncation()
        self.library.no_padding()
        j = json.loads(spec)
        model = j["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        self.specials = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.names.update({i: s for s, i in self.specials.items()})
        self.rank: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, t = self.vocab[left], self.vocab[right], self.vocab.get(left + right)
            if t is None:
                continue
            self.rank.setdefault((a, b), r)
            if t not in self.split:
                self.split[t], self.made[t] = (a, b), r
        single = {s for s in self.vocab if len(s.removesuffix(self.suffix) if self.suffix else s) <= 1}
        #: tokens that BPE can make: base symbols and results of merges
        usable = {s: i for s, i in self.vocab.items() if s in single or i in self.split}
        ends = self.suffix
        self.inner = {s: i for s, i in usable.items() if not (ends and s.endswith(ends))}
        self.final = {s[: -len(ends)]: i for s, i in usable.items() if s.endswith(ends)} if ends else self.inner
        self.width = {i: len(s) for table in (self.inner, self.final) for s, i in table.items()}
        self.inner_sizes, self.final_sizes = self._sizes(self.inner), self._sizes(self.final)
        self.fits: dict[tuple[int, int], bool] = {}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    @staticmethod
    def _sizes(table: dict[str, int]) -> dict[str, list[int]]:
        """By the last three characters (or fewer, of shorter words): lengths of the tokens that may end there, longest first."""
        sizes: dict[str, set[int]] = {}
        for s in table:
            sizes.setdefault(s[-3:], set()).add(len(s))
        return {tail: sorted({k for c in range(len(tail)) for k in sizes.get(tail[c:], ())}, reverse=True) for tail in sizes}

    def adjacent(self, a: int, b: int) -> bool:
        """Whether BPE over the two tokens' characters ends with just these two tokens.

        Looks at the border's neighbours backwards in time: undo the later of the two merges until both are single
        symbols; at each moment a merge across the border must not come before the one that was undone last.
        Of equal merges the left one comes first.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        left, right, until = a, b, float("inf")
        while True:
            if self.rank.get((left, right), float("inf")) < until:
                ok = False
                break
            x, y = self.made.get(left, -1), self.made.get(right, -1)
            if x < 0 and y < 0:
                ok = True
                break
            if x > y:
                until, left = x, self.split[left][1]
            else:
                until, right = y + 1, self.split[right][0]
        self.fits[a, b] = ok
        return ok

    def _last(self, word: str, n: int, before, table: dict[str, int], sizes: dict[str, list[int]]) -> int:
        """The last token of the encoding of word[:n], whose shorter prefixes end in before[1:], by length."""
        fits = self.fits
        lengths = sizes.get(word[max(0, n - 3) : n]) or sizes.get(word[max(0, n - 2) : n]) or sizes.get(word[n - 1 : n], ())
        for k in lengths:
            if k < n:
                t = table.get(word[n - k : n])
                if t is not None:
                    b = before[n - k]
                    if b >= 0:
                        ok = fits.get((b, t))
                        if ok is None:
                            ok = self.adjacent(b, t)
                        if ok:
                            return t
            elif k == n:
                t = table.get(word[:n])
                if t is not None:
                    return t
        return -1

    def _ids(self, word: str, before) -> list[int]:
        """The word's ids, from its last symbol with the word-end suffix back."""
        t, at, ids = self._last(word, len(word), before, self.final, self.final_sizes), len(word), []
        while t >= 0:
            ids.append(t)
            at -= self.width[t]
            t = before[at] if at else -1
        return ids[::-1]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words in byte-level characters. Words beyond LONG characters share their first LONG with others at most."""
        root: dict = {}
        for i, w in enumerate(words):
            node = root
            for ch in w[: min(len(w) - 1, LONG)]:
                below = node.get(ch)
                if below is None:
                    below = node[ch] = {}
                node = below
            node.setdefault("", []).append((w, i))
        out: list[list[int]] = [[] for _ in words]
        last = array("i", bytes(4 * (max(map(len, words), default=0) + 1)))
        last[0] = -1
        inner, inner_sizes = self.inner, self.inner_sizes
        stack = [(root, "")]
        while stack:
            node, prefix = stack.pop()
            if prefix:
                last[len(prefix)] = self._last(prefix, len(prefix), last, inner, inner_sizes)
            for ch, below in node.items():
                if ch:
                    stack.append((below, prefix + ch))
                    continue
                for w, i in below:
                    if w:
                        for n in range(LONG + 1, len(w)):
                            last[n] = self._last(w, n, last, inner, inner_sizes)
                        out[i] = self._ids(w, last)
        return out

    def show(self, ids: list[int]) -> str:
        """The tokens of ids, which decode() of a vocabulary without a decoder joins by blanks."""
        return " ".join(map(self.names.__getitem__, ids))

    def encode_any(self, text: str) -> list[list[int]]:
        """Ids by piece of any text: special tokens first, then the library's normaliser and pre-tokeniser, then the trie."""
        out, at = [], 0
        for m in [*(self.special_pattern.finditer(text) if self.special_pattern else ()), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                if self.library.normalizer is not None:
                    part = self.library.normalizer.normalize_str(part)
                words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
                distinct = list(dict.fromkeys(words))
                known = dict(zip(distinct, self.encode_words(distinct), strict=True))
                out.extend(known[w] for w in words)
            if m:
                out.append([self.specials[m.group()]])
                at = m.end()
        return out


@functools.lru_cache(maxsize=1)
def encoder(spec: str) -> tuple[TrieBpe, PieceCache]:
    return TrieBpe(spec), PieceCache()


def encode_texts(bpe: TrieBpe, cache: PieceCache, texts: list[str]):
    """For each text (its ids as an array, its decoded text in UTF-8)."""
    ok = is_safe(texts, tuple(bpe.specials))
    out: list = [None] * len(texts)
    good = np.flatnonzero(ok)
    if len(good):
        pieces = cut([texts[i] for i in good], words=True)

        def fresh(words):
            ids = bpe.encode_words([byte_level(w.lower()) for w in words])
            return ids, [bpe.show(x).encode() for x in ids]

        slots = cache.find(pieces, fresh)
        ids, lengths = cache.ids(slots)
        ends = ragged(ids, lengths, pieces.doc, len(good))
        shown = [cache.strings[k] for k in slots.tolist()]
        piece_ends = np.cumsum(np.bincount(pieces.doc, minlength=len(good)))
        a = p = 0
        for i, b, q in zip(good.tolist(), ends.tolist(), piece_ends.tolist(), strict=True):
            out[i] = (ids[a:b], b" ".join(shown[p:q]))
            a, p = b, q
    for i in np.flatnonzero(~ok).tolist():
        parts = bpe.encode_any(texts[i])
        out[i] = (np.array([x for w in parts for x in w], np.int32), " ".join(bpe.show(w) for w in parts if w).encode())
    return out


def encode_frame(df: DataFrame, spec: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of df: key, n_tokens, ids_sha256, decoded_sha256, and the ids and decoded text if keep_ids.

    A null text counts as empty: no ids, the digests of nothing. Rows with equal or null keys each give a row.
    Columns other than key and text are not read. Works for vocabularies with the word-end suffix and the
    pre-tokeniser of lower-case words that segment.cut(words=True) implements.
    """
    shared = df.sparkSession.sparkContext.broadcast(spec)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def work(batches):
        import pyarrow as pa

        bpe, cache = encoder(shared.value)
        for batch in batches:
            for a, b in text_batches(batch, 1):
                rows = encode_texts(bpe, cache, batch.column(1).slice(a, b - a).to_pylist())
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(i) for i, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i, _ in rows]),
                    pa.array([hashlib.sha256(d).hexdigest() for _, d in rows]),
                ]
                if keep_ids:
                    columns += [pa.array([i.tolist() for i, _ in rows], pa.list_(pa.int32())), pa.array([d.decode() for _, d in rows])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(work, schema)
