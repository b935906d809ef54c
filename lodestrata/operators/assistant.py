"""The assistant's operators as frames: search, term lookup, version comparison, prompts, conversations, chunk inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as R


def search(queries: DataFrame, variants: Column | None, retrieve, chunks: DataFrame, embed=None, n: int = R.N_RESULTS) -> DataFrame:
    """Excerpts for queries (query_id, query, vector): each query and its variants are retrieved, merged first seen first, the best n cited."""
    asked = queries.withColumn("variant_ord", F.lit(0))
    if variants is not None:
        more = queries.select("query_id", F.posexplode(variants).alias("i", "query")).withColumn("variant_ord", F.col("i") + 1).drop("i")
        more = more.withColumn("vector", embed(F.col("query"))) if embed is not None else more.join(queries.select("query_id", "vector"), "query_id")
        asked = asked.select("query_id", "query", "vector", "variant_ord").unionByName(more)
    tagged = asked.withColumn("asked_id", F.concat_ws("|", F.col("query_id").cast("string"), "variant_ord"))
    hits = retrieve(tagged.select(F.col("asked_id").alias("query_id"), "query", "vector"))
    back = hits.withColumnRenamed("query_id", "asked_id").join(tagged.select("asked_id", "query_id", "variant_ord"), "asked_id")
    best = R.merge_variants(back, n)
    text = R.excerpt(F.col("rank"), F.col("source"), F.col("page_start"), F.col("page_end"), F.col("section_path"), F.col("section_title"), F.col("text"))
    return best.join(chunks.select("id", "source", "page_start", "page_end", "section_path", "section_title", "text"), "id").withColumn("excerpt", text)


def explain_terms(terms: DataFrame, glossary: DataFrame, n: int = 5) -> DataFrame:
    """The n nearest glossary entries of each term (query_id, query, vector), whatever their distance and version; an answer without any tells so."""
    hits = R.dense_search(terms.select("query_id", "vector"), glossary, n)
    lines = hits.join(glossary.select("id", "source", "page_start", "document"), "id")
    lines = lines.withColumn("excerpt", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source", F.lit("unknown")), F.lit(" p."), F.coalesce(F.col("page_start").cast("string"), F.lit("?")), F.lit("\n"), "document"))
    found = terms.select("query_id", "query").join(R.context(lines, ["query_id"]), "query_id", "left")
    none = F.concat(F.lit('No definition found for "'), "query", F.lit('" in the glossary. Try a search for more context.'))
    return found.select("query_id", F.coalesce("context", none).alias("answer"), F.coalesce("n_excerpts", F.lit(0)).alias("n_excerpts"))


def prompts(questions: DataFrame, contexts: DataFrame, system: str) -> DataFrame:
    """(query_id, prompt): instructions, context and question."""
    both = questions.join(contexts, "query_id", "left")
    return both.select("query_id", F.concat(F.lit(f"{system}\n\nContext:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "query").alias("prompt"))


def turns(messages: DataFrame, thread: str = "thread_id", seq: str = "seq") -> DataFrame:
    """Messages with turn (the number of user messages so far) and n_before (messages before the turn): what a turn added."""
    w = Window.partitionBy(thread).orderBy(seq)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = messages.withColumn("turn_no", F.sum((F.col("role") == "user").cast("int")).over(so_far)).withColumn("place", F.row_number().over(w))
    return numbered.withColumn("n_before", F.min("place").over(Window.partitionBy(thread, "turn_no")) - 1)


def inspect(chunks: DataFrame, kind: str = "all", needle: str = "", page: int = 0, size: int = 50, order: str = "id") -> DataFrame:
    """One page of the chunks of a type ("all", "front_matter" or a type of body matter) that contain a text in whatever case."""
    keep = F.lit(True) if kind == "all" else F.col("is_front_matter") if kind == "front_matter" else (F.col("content_type") == kind) & ~F.col("is_front_matter")
    if needle:
        low = needle.lower()
        keep = keep & (F.contains(F.lower("text"), F.lit(low)) | F.contains(F.lower("section_title"), F.lit(low)) | F.contains(F.lower(F.col(order).cast("string")), F.lit(low)))
    return chunks.filter(keep).orderBy(order).offset(page * size).limit(size)


def expand_versions(versions: Column) -> Column:
    """A comma-separated list as an array, blanks aside."""
    return F.filter(F.transform(F.split(versions, ","), F.trim), lambda v: v != "")
