"""Boundaries to what the engine does not hold: embedding models, language models, document decoders. Each has a deterministic default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as X


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


#: bytes of lower-case tokens, and blanks for all others, those of other characters among them
_TOKEN_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for b in range(256))


class _Places(dict):
    """Twice a token's place, and 1 more where its sign is plus; the places of up to `most` tokens are kept, then it begins anew."""

    def __init__(self, dimension: int, most: int = 1 << 18):
        super().__init__()
        self.dimension, self.most = dimension, most

    def __missing__(self, token: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "big")
        if len(self) >= self.most:
            self.clear()
        self[token] = found = h % self.dimension * 2 + (h >> 63)
        return found


class HashingEmbedder:
    """Tokens hashed to signed places of a unit vector. No model: for tests and offline runs."""

    def __init__(self, dimension: int = 64):
        self.dimension, self._places = dimension, _Places(dimension)

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            tokens = (t or "").lower().encode("utf-8", "replace").translate(_TOKEN_BYTES).split()
            places = np.array(list(map(self._places.__getitem__, tokens)), dtype=np.intp)
            n = np.bincount(places, minlength=2 * self.dimension)
            out[i] = n[1::2] - n[::2]
        sizes = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(sizes > 0, sizes, 1)).astype("float32").tolist()


def embedding(make: Callable[[], Embedder], text: Column, batch: int = 32) -> Column:
    """The texts' vectors; the model is loaded once for each worker's stream of batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:

        model = make()
        for s in series:
            texts = s.fillna("").tolist()
            yield pd.Series([v for a in range(0, len(texts), batch) for v in model.embed(texts[a : a + batch])], dtype=object)

    return run(text)


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class EchoGenerator:
    """Answers with the prompt's last line."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.rstrip().rpartition("\n")[2] for p in prompts]


class ExtractiveGenerator:
    """Answers with the sentences of the prompt's excerpts that share most with the question, each with its excerpt's citation.

    A word counts for less the more sentences hold it; sentences that share none are not told. No model, and nothing that is not in the excerpts.
    """

    none = "The excerpts do not answer this."

    def __init__(self, most: int = 3):
        self.most = most

    def generate(self, prompts: list[str]) -> list[str]:
        return [self._answer(p) for p in prompts]

    def _answer(self, prompt: str) -> str:
        import math
        import re

        before, _, question = prompt.rpartition("Question:")
        tokens = lambda t: set(re.findall("[a-z0-9_]+", t.lower()))
        cite, told = "", []
        for line in before.partition("Context:")[2].split("\n"):
            if line.startswith("Cite-as: "):
                cite = line[9:].strip()
            elif not re.match(r"\[\d+\] Source: ", line):
                told += [(x.strip(), cite) for x in re.split(r"(?<=[.!?])\s+", line) if x.strip()]
        held: dict[str, int] = {}
        for sentence, _ in told:
            for w in tokens(sentence):
                held[w] = held.get(w, 0) + 1
        asked = tokens(question)
        weigh = lambda t: sum(math.log(1 + len(told) / held[w]) for w in tokens(t) & asked)
        best = sorted(((-weigh(t), i) for i, (t, _) in enumerate(told) if tokens(t) & asked))[: self.most]
        return " ".join(f"{told[i][0]} {told[i][1]}".strip() for _, i in sorted(best, key=lambda x: x[1])) or self.none


def answers(make: Callable[[], Generator], prompt: Column) -> Column:
    """A language model over a column of prompts."""

    @F.pandas_udf(T.StringType())
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:

        model = make()
        for s in series:
            yield pd.Series(model.generate(s.fillna("").tolist()), dtype=object)

    return run(prompt)


def synonym_variants(query: Column, synonyms: dict[str, str], most: int = 2) -> Column:
    """Rule-based query expansion: up to `most` variants, each with one term replaced."""
    if not synonyms:
        return F.array().cast("array<string>")
    variants = [F.when(F.lower(query).contains(k.lower()), F.regexp_replace(query, f"(?i){k}", v)) for k, v in synonyms.items()]
    return F.slice(F.array_compact(F.array(*variants)), 1, most)


def generated_variants(make: Callable[[], Generator], query: Column, most: int = 2) -> Column:
    """Expansion by a language model: its lines that are not blank; none where it gives nothing."""
    lines = F.transform(F.split(F.coalesce(answers(make, query), F.lit("")), "\n"), X.trim_all)
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


class Decoder(Protocol):
    """From a file's bytes to page records (see schema.PAGE, schema.RAW_PAGE) as dictionaries, and to its outline."""

    def pages(self, name: str, content: bytes) -> Iterator[dict]: ...

    def outline(self, name: str, content: bytes) -> Iterator[tuple[int, str, int]]: ...


class JsonPageDecoder:
    """JSON lines as an offline extractor writes them: pages with the fields of the schema, and {"toc": [[level, title, page], ...]}."""

    def _lines(self, content: bytes) -> Iterator[dict]:
        import json

        for line in content.decode("utf-8").split("\n"):
            if line.strip():
                yield json.loads(line)

    def pages(self, name: str, content: bytes) -> Iterator[dict]:  # noqa: ARG002
        return (r for r in self._lines(content) if "toc" not in r)

    def outline(self, name: str, content: bytes) -> Iterator[tuple[int, str, int]]:  # noqa: ARG002
        return (tuple(e) for r in self._lines(content) for e in r.get("toc", ()))


#: embedding models by the names that settings know them by
MODELS: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder}
