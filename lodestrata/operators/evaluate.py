"""Grouped quality reports, and metrics that need no language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.bind import bound, let
from ..functions.formulas import fixed

METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]
TYPES = ["factual", "calculation", "comparison", "edge_case"]
#: queries up to which their runs of words are sent to the documents
FEW = 100_000


def mean(c: str) -> Column:
    """Mean without nulls and NaN; null if there is nothing else."""
    return F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))


def summary(results: DataFrame, by: list[str], metrics: list[str] | None = None) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("n"), *[mean(m).alias(m) for m in metrics or METRICS])


def by_type(results: DataFrame, types: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Means of each question type with its place in the fixed order; types without rows are left out."""
    order = F.array(*[F.lit(t) for t in types or TYPES])
    return summary(results.filter(F.col("type").isin(types or TYPES)), ["type"], metrics).withColumn("place", F.array_position(order, F.col("type")))


def delta(results: DataFrame, base: str, other: str, metrics: list[str] | None = None) -> DataFrame:
    """(metric, base, other, delta): one aggregation over both pipelines, then a row per metric."""
    names = metrics or METRICS
    pick = lambda m, p: F.avg(F.when(F.col("pipeline") == p, F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))))
    one = results.agg(*[pick(m, p).alias(f"{m}_{k}") for m in names for k, p in (("base", base), ("other", other))])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_base").alias("base"), F.col(f"{m}_other").alias("other")) for m in names])
    return one.select(F.inline(rows)).withColumn("delta", F.col("other") - F.col("base"))


def signed(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.concat(F.when(c >= 0, "+").otherwise(""), fixed(c, 4)))


def zip_records(records: DataFrame, responses: DataFrame) -> DataFrame:
    """records (ord, question, reference) with responses (ord, response, contexts); an error unless both have the same places."""
    both = records.join(responses, "ord", "full")
    bad = F.col("question").isNull() | F.col("response").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no match at place "), F.col("ord").cast("string")))).otherwise(F.col("question"))
    return both.select("ord", checked.alias("user_input"), "response", F.col("contexts").alias("retrieved_contexts"), F.coalesce("reference", F.lit("")).alias("reference"))


def clean_contexts(contexts: Column) -> Column:
    """Contexts that are not blank; one empty context if there is none."""
    kept = F.filter(contexts, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("")))


def token_overlap(answer: Column, reference: Column) -> tuple[Column, Column]:
    """(precision, recall) of distinct tokens: deterministic stand-ins for judged metrics, not the same thing."""
    a, r = F.array_distinct(X.tokens(answer)), F.array_distinct(X.tokens(reference))
    both = F.size(F.array_intersect(a, r))
    return F.when(F.size(a) > 0, both / F.size(a)), F.when(F.size(r) > 0, both / F.size(r))


def _sentences(text: Column) -> Column:
    """The distinct tokens of each sentence that has any."""
    cut = F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+")
    return F.filter(F.transform(cut, lambda x: F.array_distinct(X.tokens(x))), lambda t: F.size(t) > 0)


def _aligned(of: Column, to: Column) -> Column:
    """The share of the sentences' tokens that the best sentence for each of them holds; longer sentences weigh more. Null without sentences."""

    def best(s: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(to, lambda c: F.size(F.array_intersect(s, c)))), F.lit(0))

    total = F.aggregate(of, F.lit(0), lambda n, s: n + F.size(s))
    held = F.aggregate(F.transform(of, best), F.lit(0), lambda n, x: n + x)
    return F.when(total > 0, held / total)


def standins(rows: DataFrame, question: str = "question", response: str = "response", contexts: str = "contexts", reference: str = "reference", least: float = 0.5) -> DataFrame:
    """rows with four deterministic stand-ins (METRICS with _standin) for the judged metrics, by alignment of sentences; not the same thing.

    faithfulness: the response's sentences against those of all contexts. context_recall: the reference's sentences against them.
    answer_relevancy: the question's tokens that the response holds. context_precision: mean precision at the ranks of the contexts
    that hold `least` of a sentence of the reference. Each is null where what it is about (response, reference, question) has no token:
    a failed answer has no score. No shuffle: a row's texts are those of one answer.
    """
    r = bound(rows, __r=_sentences(F.col(response)), __ref=_sentences(F.col(reference)), __q=F.array_distinct(X.tokens(F.coalesce(question, F.lit("")))), __c=F.transform(F.coalesce(contexts, F.array().cast("array<string>")), _sentences))
    c = lambda n: F.col(f"__{n}")
    good = F.transform(c("c"), lambda ctx: F.exists(c("ref"), lambda s: F.exists(ctx, lambda x: F.size(F.array_intersect(s, x)) >= least * F.size(s))))
    r = bound(r, __all=F.flatten(c("c")), __good=F.filter(F.transform(good, lambda g, i: F.when(g, i + 1)), lambda i: i.isNotNull()))
    precision = F.when(F.size("__good") > 0, F.aggregate(F.transform("__good", lambda at, k: (k + 1) / at), F.lit(0.0), lambda s, x: s + x) / F.size("__good")).otherwise(0.0)
    answered = F.size("__r") > 0
    scores = {
        "faithfulness_standin": _aligned(c("r"), c("all")), "answer_relevancy_standin": F.when(answered & (F.size("__q") > 0), F.size(F.array_intersect("__q", F.array_distinct(F.flatten("__r")))) / F.size("__q")),
        "context_precision_standin": F.when(answered & (F.size("__ref") > 0), precision), "context_recall_standin": F.when(answered, _aligned(c("ref"), c("all"))),
    }
    return r.select(*rows.columns, *[v.alias(k) for k, v in scores.items()])


def verbatim(queries: DataFrame, docs: DataFrame, words: int = 5) -> DataFrame:
    """(query_id, id) of the documents (id, text) that hold a query's whole text.

    A document that holds a query of several words holds the run of its second to sixth word between blanks, so the two meet by an equi-join on
    that run; only queries of fewer words than that are looked for in every document.
    """
    parts = F.split("query", " ")
    asked = queries.withColumn("run", F.when(F.size(parts) >= words + 2, F.array_join(F.slice(parts, 2, words), " ")))
    # a text is cut once, not once for each of its runs
    every = let(F.split("text", " "), lambda p: F.transform(F.when(F.size(p) >= words, F.sequence(F.lit(1), F.size(p) - words + 1)), lambda i: F.array_join(F.slice(p, i, words), " ")))
    named = asked.filter("run IS NOT NULL").select("query_id", "run")
    if named.limit(FEW + 1).count() <= FEW:
        named = F.broadcast(named)  # the runs stay where their documents are
    met = docs.select("id", F.explode(F.array_distinct(every)).alias("run")).join(named, "run").select("query_id", "id").distinct()
    long = met.join(docs, "id").join(queries, "query_id").filter(F.contains("text", "query")).select("query_id", "id")
    short = docs.join(asked.filter("run IS NULL"), F.contains("text", "query")).select("query_id", "id")
    return long.unionByName(short)


def ranking_metrics(hits: DataFrame, relevant: DataFrame, k: int = 10, key: str = "id") -> DataFrame:
    """(query_id, mrr, recall, ndcg) at k of hits (query_id, id, rank) against relevant (query_id, id)."""
    n = relevant.groupBy("query_id").agg(F.count_distinct(key).alias("n_relevant"))
    good = hits.filter(F.col("rank") <= k).join(relevant.distinct(), ["query_id", key], "left_semi")
    found = good.groupBy("query_id").agg(F.min("rank").alias("first"), F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = n.join(found, "query_id", "left")
    return rows.select("query_id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("hits") / F.col("n_relevant"), F.lit(0.0)).alias("recall"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))
