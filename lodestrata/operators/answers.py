"""Answers over a frame of questions: the chain, the three evaluation pipelines, the tools, and the reports on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions import text as X
from ..plugins import Generator, answers
from . import assistant, evaluate
from . import retrieval as R

SYSTEM = "Answer from the numbered excerpts alone and cite them as they say; tell so where they do not hold the answer."
#: excerpts that an evaluated answer shows, and characters of a hit in a report
CONTEXTS, SHOWN = 5, 1000

Retrieve = Callable[[DataFrame], DataFrame]


def first_questions(questions: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n questions."""
    return questions.orderBy(order).limit(n)


def chain(questions: DataFrame, retrieve: Retrieve, chunks: DataFrame, model: Callable[[], Generator], variants: Column | None = None, n: int = R.N_RESULTS) -> DataFrame:
    """(query_id, answer, context, n_excerpts) of questions (query_id, query, vector): retrieval, cited excerpts, prompt, model. A question without
    hits is answered over an empty context."""
    return answered(questions, assistant.search(questions, variants, retrieve, chunks, n=n), model)


def answered(questions: DataFrame, found: DataFrame, model: Callable[[], Generator]) -> DataFrame:
    """chain() over excerpts that have been found."""
    contexts = R.context(found, ["query_id"])
    asked = assistant.prompts(questions, contexts, SYSTEM).join(contexts, "query_id", "left")
    return asked.select("query_id", answers(model, F.col("prompt")).alias("answer"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_excerpts", F.lit(0)).alias("n_excerpts"))


def retrieved(hits: DataFrame, chunks: DataFrame, n: int = CONTEXTS, text: str = "text") -> DataFrame:
    """(query_id, contexts): the texts of the first n hits of each question, in order."""
    rows = hits.filter(F.col("rank") <= n).join(chunks.select("id", F.col(text).alias("__text")), "id")
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "__text"))), lambda x: x["__text"]).alias("contexts"))


def routed(questions: DataFrame, chunks: DataFrame, glossary: DataFrame, retrieve: Retrieve, versions: list[str]) -> DataFrame:
    """(query_id, tool, output): the tools that rules choose for each question, in place of a model's choice.

    A question that gives a formula's name and parameters (columns formula, parameters) is calculated; one that names several versions is
    searched for each; one that asks what a term means is looked up; all are searched.
    """
    q = questions
    outputs = []
    if "formula" in q.columns:
        outputs.append(q.filter("formula IS NOT NULL").select("query_id", F.lit("calculate").alias("tool"), formulas.calculate(F.col("formula"), F.col("parameters")).alias("output")))
    meaning = q.filter(F.lower("query").rlike(r"\b(what (is|does)|define|meaning of|stands? for)\b"))
    outputs.append(assistant.explain_terms(meaning, glossary).select("query_id", F.lit("explain_term").alias("tool"), F.col("answer").alias("output")))
    several = q.filter(F.size(X.versions_named(F.col("query"))) > 1)
    compared = R.compare_versions(several.select("query_id", "query", "vector"), versions, retrieve, chunks)
    texts = compared.join(chunks.select("id", F.col("text").alias("__text")), "id").groupBy(F.col("feature_id").alias("query_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version", "rank", "__text"))), lambda x: F.concat(F.lit("["), x["version"], F.lit("] "), x["__text"])), "\n\n").alias("output"))
    outputs.append(texts.select("query_id", F.lit("compare_versions").alias("tool"), "output"))
    searched = R.context(assistant.search(q.select("query_id", "query", "vector"), None, retrieve, chunks), ["query_id"])
    outputs.append(searched.select("query_id", F.lit("search_docs").alias("tool"), F.col("context").alias("output")))
    out = outputs[0]
    for more in outputs[1:]:
        out = out.unionByName(more)
    return out


def evaluated(questions: DataFrame, pipelines: dict[str, Retrieve], chunks: DataFrame, model: Callable[[], Generator], glossary: DataFrame | None = None, versions: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(pipeline, query_id, response, contexts) for each pipeline, a name and its retrieval; with a glossary also "agent", whose contexts are
    what its tools gave, and which answers over them. Contexts that are blank go; one empty context stands for none."""
    out = []
    for name, retrieve in pipelines.items():
        found = keep(assistant.search(questions, None, retrieve, chunks).select("query_id", "id", "rank", "excerpt"))  # retrieved once, for the answer and its contexts
        told = answered(questions, found, model)
        shown = retrieved(found, chunks)
        out.append(told.join(shown, "query_id", "left").select(F.lit(name).alias("pipeline"), "query_id", F.col("answer").alias("response"), evaluate.clean_contexts(F.coalesce("contexts", F.array().cast("array<string>"))).alias("contexts")))
    if glossary is not None:
        retrieve = next(iter(reversed(pipelines.values())))
        tools = routed(questions, chunks, glossary, retrieve, versions or []).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tool", "output"))), lambda x: x["output"]).alias("contexts"))
        both = questions.join(tools, "query_id", "left")
        prompt = F.concat(F.lit(f"{SYSTEM}\n\nContext:\n"), F.coalesce(F.array_join("contexts", "\n\n"), F.lit("")), F.lit("\n\nQuestion: "), "query")
        out.append(both.select(F.lit("agent").alias("pipeline"), "query_id", answers(model, prompt).alias("response"), evaluate.clean_contexts(F.coalesce("contexts", F.array().cast("array<string>"))).alias("contexts")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def retrieval_counts(hits: DataFrame, key: str = "id", query: str = "query_id") -> DataFrame:
    """(n_docs, n_queries): different documents that were retrieved, and queries that retrieved them."""
    return hits.agg(F.count_distinct(key).alias("n_docs"), F.count_distinct(query).alias("n_queries"))


def index_totals(chunks: DataFrame, searchable: Column, file: str = "file") -> DataFrame:
    """(file, total, searchable, skipped) for each file, and for all files with a null name."""
    return chunks.rollup(file).agg(F.count("*").alias("total"), F.count_if(searchable).alias("searchable"), F.count_if(~F.coalesce(searchable, F.lit(False))).alias("skipped"))


def score(distance: Column) -> Column:
    """Likeness as searches show it."""
    return 1 - distance


def shown_path(path: Column) -> Column:
    """A section path between slashes as people read it."""
    return F.replace(path, F.lit("/"), F.lit(" > "))


# -- reports: Markdown of bounded size, from aggregates or the results of a stated set of questions ---------------------------


def _cells(row, names) -> str:
    return " | ".join("—" if row[m] is None else f"{row[m]:.4f}" for m in names)


def report(results: DataFrame, title: str = "Evaluation", base: str = "dense_rag", other: str = "hybrid_rag", when: str = "") -> list[str]:
    """Lines of a report of results (pipeline, id, type, question, and METRICS): means by pipeline, by type of question, differences, every question.

    The questions are a stated set of bounded size: each is a line.
    """
    names = evaluate.METRICS
    means = {r["pipeline"]: r for r in evaluate.summary(results, ["pipeline"]).collect()}
    head = " | ".join(names)
    rule = "|".join([":-:"] * len(names))
    lines = [f"# {title}", ""] + ([f"**Made**: {when}", ""] if when else []) + [f"**Samples**: {max((r['n'] for r in means.values()), default=0)}", f"**Pipelines**: {', '.join(sorted(means))}", "", "## Means", "", f"| pipeline | {head} |", f"|-|{rule}|"]
    lines += [f"| {p} | {_cells(means[p], names)} |" for p in sorted(means)]
    if other in means:
        own = results.filter(F.col("pipeline") == other)
        lines += ["", f"## By type ({other})", "", f"| type | n | {head} |", f"|-|:-:|{rule}|"]
        lines += [f"| {r['type']} | {r['n']} | {_cells(r, names)} |" for r in evaluate.by_type(own).orderBy("place").collect()]
    if base in means and other in means:
        lines += ["", f"## {other} against {base}", "", f"| metric | {base} | {other} | difference |", "|-|:-:|:-:|:-:|"]
        for r in evaluate.delta(results, base, other).withColumn("shown", evaluate.signed(F.col("delta"))).collect():
            lines.append(f"| {r['metric']} | {_cells(r, ['base', 'other'])} | {r['shown']} |")
    if other in means:
        lines += ["", f"## Every question ({other})", "", f"| id | type | {head} | question |", f"|-|-|{rule}|-|"]
        shown = own.select("id", "type", *[X.metric_cell(F.col(m).cast("double")).alias(m) for m in names], X.preview(F.col("question"), 30).alias("question"))
        lines += [f"| {r['id']} | {r['type']} | {' | '.join(r[m] for m in names)} | {r['question']} |" for r in shown.orderBy("id").collect()]
    return [*lines, ""]


def verification(questions: DataFrame, hits: DataFrame, n: int = 2) -> DataFrame:
    """(query_id, report): for each question (query_id, query) the section of a report on its n best hits (query_id, rank, distance, source, page_start,
    section_path, section_title, document)."""
    place = F.concat(shown_path(F.coalesce("section_path", F.lit(""))), F.lit(" > "), F.coalesce("section_title", F.lit("Untitled")))
    hit = F.concat(F.lit("### Hit "), F.col("rank").cast("string"), F.lit(" (Score: "), formulas.fixed(score(F.col("distance")), 4), F.lit(")\n- **Source**: "), F.coalesce("source", F.lit("?")), F.lit(" (Page "), F.coalesce(F.col("page_start").cast("string"), F.lit("?")), F.lit(")\n- **Path**: "), place, F.lit("\n\n```text\n"), F.left("document", F.lit(SHOWN)), F.lit("\n```\n"))
    best = hits.filter(F.col("rank") <= n).select("query_id", F.struct("rank", hit.alias("t")).alias("x"))
    texts = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("body"))
    none = F.lit("> No results found for this query.\n")
    return questions.join(texts, "query_id", "left").select("query_id", F.concat(F.lit("## "), "query", F.lit("\n\n"), F.coalesce("body", none)).alias("report"))
