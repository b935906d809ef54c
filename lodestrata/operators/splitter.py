"""Recursive character splitter: pieces of bounded length that overlap, cut at the coarsest separator that works."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..profile import CHUNK_CHARS, CHUNK_OVERLAP, SEPARATORS

#: characters of a text's copies that a worker holds at once
COPIES = 1 << 22


def _parts(text: str, separator: str) -> list[str]:
    """Pieces that begin with the separator they were cut at, or characters."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    """Runs of parts as long as fit in size; the next run begins with the last parts of the one before, up to the overlap."""
    out: list[str] = []
    run: deque[str] = deque()
    length = 0
    for p in parts:
        if run and length + len(p) > size:
            text = "".join(run).strip()
            if text:
                out.append(text)
            while run and (length > overlap or length + len(p) > size):
                length -= len(run.popleft())
        run.append(p)
        length += len(p)
    text = "".join(run).strip()
    return [*out, text] if text else out


def split_text(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None) -> list[str]:
    separators = SEPARATORS if separators is None else separators
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    fitting: list[str] = []
    for p in _parts(text, separators[at]):
        if len(p) < size:
            fitting.append(p)
            continue
        out += _merge(fitting, size, overlap)
        fitting = []
        out += split_text(p, size, overlap, finer) if finer else [p]
    return out + _merge(fitting, size, overlap)


def split_frame(df: DataFrame, text: str, kind: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """df with chunk_index and chunk, one row per piece that is not blank. Registers stay whole up to one and a half sizes.

    Texts that fit in a piece never leave the JVM; the others go through Python in Arrow batches, text by text: a row's pieces
    are rows at once, never a list in a row.
    """
    whole = (kind == "register") & (F.length(text) <= int(size * 1.5))
    short = F.length(text) < size
    blank = F.trim(F.regexp_replace(text, r"(?U)\s", "")) == ""

    def pieces(batches):
        import pyarrow as pa

        for batch in batches:
            for i, value in enumerate(batch.column(at)):
                t = value.as_py()
                found, step = split_text(t, size, overlap), max(1, COPIES // len(t))  # a row's pieces repeat its text
                for a in range(0, len(found), step):
                    some = found[a : a + step]
                    rows = batch.take(pa.array([i] * len(some), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(range(a, a + len(some)), pa.int32()), pa.array(some)], names=schema.names)

    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType())])
    parts = df.filter(~blank)
    same = parts.filter(whole | short).withColumn("chunk_index", F.lit(0)).withColumn("chunk", F.when(whole, F.col(text)).otherwise(F.regexp_replace(F.col(text), r"(?U)^\s+|\s+\z", "")))
    long = parts.filter(~(whole | short)).mapInArrow(pieces, schema)
    return same.unionByName(long)
