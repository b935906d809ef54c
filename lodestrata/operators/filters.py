"""Which chunks are valid, searchable, indexed; first-seen dedupe; statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import bound
from ..functions.text import trim_all
from ..profile import DEFAULT, Profile


def _least(kind: Column, lengths: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in lengths.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _has_chars(raw: Column, n: int) -> Column:
    """length(trim_all(raw)) >= n; looks at the beginning only: a character, n - 2 of any kind, and another one after them."""
    return raw.rlike(rf"(?Us)^\s*+\S.{{{n - 2}}}\s*+\S") if n >= 2 else F.length(trim_all(raw)) >= n


def is_noise(raw: Column, profile: Profile = DEFAULT) -> Column:
    """Whether a text is a continuation mark, or its first line begins like a watermark's."""
    t = trim_all(raw)
    return reduce(lambda a, b: a | b, [t.rlike(f"(?i)^{p}$") for p in profile.noise])


def is_valid(kind: Column, raw: Column, is_row: Column, profile: Profile = DEFAULT) -> Column:
    least = F.when(F.coalesce(is_row, F.lit(False)), profile.least_row_chunk).otherwise(_least(kind, profile.least_chars, profile.least_other))
    return (F.length(trim_all(raw)) >= least) & ~is_noise(raw, profile)


def is_full_table(kind: Column, is_row: Column) -> Column:
    return (kind == "table") & ~F.coalesce(is_row, F.lit(False))


def is_register_section(title: Column, profile: Profile = DEFAULT) -> Column:
    return reduce(lambda a, b: a | b, [F.upper(F.coalesce(title, F.lit(""))).contains(k) for k in profile.register_sections])


def searchable(chunks: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Chunks that a run reports as searchable: body matter, no full tables but of registers, and valid."""
    c = F.col
    keep = ~c("is_front_matter") & (~is_full_table(c("content_type"), c("is_row_chunk")) | is_register_section(c("section_title"), profile))
    return chunks.filter(keep & is_valid(c("content_type"), c("raw_text"), c("is_row_chunk"), profile))


def indexable(chunks: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Chunks for the vector index: as searchable(), with a lower bound for tables and noise kept."""
    c = F.col
    chunks = bound(chunks, content_type=c("content_type"), section_title=c("section_title"))  # named often below, computed once
    keep = ~c("is_front_matter") & (~is_full_table(c("content_type"), c("is_row_chunk")) | is_register_section(c("section_title"), profile))
    long_enough = _has_chars(c("raw_text"), profile.least_other)
    for kind, n in {**profile.least_chars, "table": profile.least_indexed_table}.items():
        long_enough = F.when(c("content_type") == kind, _has_chars(c("raw_text"), n)).otherwise(long_enough)
    return chunks.filter(keep & long_enough)


def keyword_indexable(chunks: DataFrame) -> DataFrame:
    """Chunks for the keyword index: body matter."""
    return chunks.filter(~F.coalesce("is_front_matter", F.lit(False)))


def first_seen(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet."""
    return incoming.join(existing.select(key), key, "left_anti")


def stats(chunks: DataFrame, by: list[str], profile: Profile = DEFAULT) -> DataFrame:
    """Counts by group: total, front_matter, searchable, short_filtered, and of the searchable by type, in one pass."""
    c = F.col
    body = ~c("is_front_matter")
    kept = body & (~is_full_table(c("content_type"), c("is_row_chunk")) | is_register_section(c("section_title"), profile))
    valid = is_valid(c("content_type"), c("raw_text"), c("is_row_chunk"), profile)
    types = [F.count_if(kept & valid & (c("content_type") == t)).alias(f"n_{t}") for t in ("text", "table", "figure", "bitmap", "definition", "register")]
    return chunks.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(~body).alias("front_matter"), F.count_if(kept & valid).alias("searchable"), F.count_if(body & ~(kept & valid)).alias("short_filtered"), *types)


def body_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Counts by group as the inspector shows them: total, body, front_matter, and of the body matter by type, whether it can be searched or not."""
    body = ~F.coalesce(F.col("is_front_matter"), F.lit(False))
    types = [F.count_if(body & (F.col("content_type") == t)).alias(f"n_{t}") for t in ("text", "table", "figure", "bitmap", "definition", "register")]
    return chunks.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(body).alias("body"), F.count_if(~body).alias("front_matter"), *types)
