"""Command line: ingest page models, index chunks, search, ask, evaluate, report. `python -m lodestrata.cli --help`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import text as X
from .operators import answers as A
from .operators import filters
from .operators import retrieval as R
from .operators.threads import Threads
from .plans.ingest import ingest, ingest_documents
from .plugins import MODELS, ExtractiveGenerator, JsonPageDecoder, embedding
from .schema import TOC
from .session import stored, working_folder
from .sources import files
from .sources.keywords import KeywordIndex
from .sources.store import VectorStore, index_chunks


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser(config: Config) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="page models (JSON lines) and a table of contents to chunks")
    a.add_argument("pages")
    a.add_argument("--toc", help="outlines as JSON lines, for page models; without it, raw pages and outlines come from the documents")
    a.add_argument("--output", default=config.chunks)
    a.add_argument("--pattern", default="*.json*")
    a = sub.add_parser("index", help="chunks to the vector store")
    a.add_argument("chunks", nargs="?", default=config.chunks)
    a.add_argument("--store", default=config.store)
    a.add_argument("--refresh", action="store_true")
    a.add_argument("--model", default=config.model, choices=sorted(MODELS))
    a = sub.add_parser("stats", help="counts of chunks or of the store")
    a.add_argument("--store", default=config.store)
    a.add_argument("--chunks")
    a = sub.add_parser("search", help="the nearest chunks of a question")
    a.add_argument("question")
    a.add_argument("--store", default=config.store)
    a.add_argument("--version", default="")
    a.add_argument("-n", type=int, default=3)
    a.add_argument("--model", default=config.model, choices=sorted(MODELS))
    a = sub.add_parser("build-bm25", help="chunks to the stored keyword index; running it again adds what is new")
    a.add_argument("chunks", nargs="?", default=config.chunks)
    a.add_argument("--keywords", default=config.keywords)
    for name, what in (("ask", "answer one question"), ("chat", "answer the lines of the input, one after the other; `reset` begins a new memory, `version X` one for another version"), ("eval", "responses and contexts of the pipelines for a file of questions"), ("verify", "a report on the best hits of a file of questions")):
        a = sub.add_parser(name, help=what)
        if name == "ask":
            a.add_argument("question")
        elif name != "chat":
            a.add_argument("questions")
            a.add_argument("output")
            a.add_argument("--first", type=int, help="the first questions only")
        a.add_argument("--chunks", default=config.chunks)
        a.add_argument("--store", default=config.store)
        a.add_argument("--version", default=config.default_version)
        a.add_argument("--keywords", default=config.keywords)
        a.add_argument("--model", default=config.model, choices=sorted(MODELS))
        a.add_argument("--expand", action=argparse.BooleanOptionalAction, default=config.expand_neighbours, help="add the chunks next to tables and registers that were found")
        a.add_argument("--show-sources", action="store_true")
        if name == "chat":
            a.add_argument("--memory", help="a folder that keeps the conversations; without it they last as long as the command")
            a.add_argument("--thread", default="chat")
    a = sub.add_parser("report", help="a Markdown report of a JSON lines file of results (pipeline, id, type, question, metrics)")
    a.add_argument("results")
    a.add_argument("--output", help="write it there; else it is printed")
    return p


def _searches(spark: SparkSession, args: argparse.Namespace) -> tuple:
    """(chunks, retrievals by pipeline) over the store, the chunk files and the stored keyword index; without an index all searches are by vectors."""
    chunks = files.read_chunks(spark, args.chunks)[0].withColumnRenamed("chunk_id", "id").filter(~F.col("is_front_matter"))
    chunks = chunks.withColumn("pos", F.monotonically_increasing_id())  # lines of a file follow each other
    if args.expand:
        chunks = stored(spark, "chunks")(chunks)
    vectors = VectorStore(spark, args.store).collection().select("id", "version", "vector")
    index = KeywordIndex(spark, args.keywords, "chunk_id")
    if not index.size():
        print(f"there is no keyword index in {args.keywords}: searching by vectors alone", file=sys.stderr)
        index = None

    def dense(q):
        return R.hybrid(q, chunks, vectors, args.version, False)

    def hybrid(q):
        return R.hybrid(q, chunks, vectors, args.version, index is not None, expand=args.expand, index=index)

    return chunks, {"dense_rag": dense, "hybrid_rag": hybrid}


def _model(args: argparse.Namespace):
    return MODELS[args.model]


def _asked(spark: SparkSession, args: argparse.Namespace, texts: list[str]):
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    return rows.withColumn("vector", embedding(_model(args), F.col("query")))


def _answer(spark: SparkSession, args: argparse.Namespace, question: str) -> str:
    chunks, searches = _searches(spark, args)
    row = A.chain(_asked(spark, args, [question]), searches["hybrid_rag"], chunks, ExtractiveGenerator).first()
    if args.show_sources:
        print(row["context"])
    print(row["answer"])
    return row["answer"]


def _chat(spark: SparkSession, args: argparse.Namespace) -> None:
    """Questions by line; `reset` begins a new memory, `version X` one for that version, `memory` shows it."""
    memory = Threads(spark, args.memory or working_folder(spark, "chat"))
    thread = spark.createDataFrame([(args.thread,)], "thread_id string")
    memory.reset(thread, args.version)
    for line in sys.stdin:
        question = line.strip()
        if question in ("exit", "quit"):
            break
        if question == "reset":
            memory.reset(thread)
            print("a new memory")
        elif question.startswith("version "):
            args.version = question.split(maxsplit=1)[1]
            memory.reset(thread, args.version)
            print(f"version {args.version}, a new memory")
        elif question == "memory":
            for r in memory.memory().filter(F.col("thread_id") == args.thread).orderBy("seq").collect():  # one conversation
                print(f"{r['role']}: {r['content']}")
        elif question:
            said = [(args.thread, 0, "user", question), (args.thread, 1, "assistant", _answer(spark, args, question))]
            memory.post(spark.createDataFrame(said, "thread_id string, ord int, role string, content string"))


def main(argv: list[str] | None = None) -> int:
    config = Config.from_env()
    args = parser(config).parse_args(argv)
    spark = session()
    if args.command == "ingest":
        if args.toc:
            chunks = ingest(files.read_documents(spark, args.pages, JsonPageDecoder, args.pattern), spark.read.schema(TOC).json(args.toc))
        else:
            chunks = ingest_documents(spark, args.pages, JsonPageDecoder, args.pattern)
        files.write_chunks(chunks, args.output, "overwrite")
    elif args.command == "index":
        good, bad = files.read_chunks(spark, args.chunks)
        print({**index_chunks(VectorStore(spark, args.store), good, _model(args), refresh=args.refresh), "malformed": bad.count()})
    elif args.command == "stats":
        if args.chunks:
            filters.stats(files.read_chunks(spark, args.chunks)[0], ["source"]).show(1000, False)
        else:
            print(VectorStore(spark, args.store).count())
    elif args.command == "search":
        store = VectorStore(spark, args.store)
        q = spark.createDataFrame([(0, args.question)], "query_id int, query string").withColumn("vector", embedding(_model(args), F.col("query")))
        where = F.col("version") == args.version if args.version else None
        hits = store.query(q, args.n, where=where).join(store.collection().select("id", "document"), "id")
        hits.select("rank", F.round(1 - F.col("distance"), 4).alias("score"), "id", X.preview(F.col("document"), 800).alias("text")).orderBy("rank").show(args.n, False)
    elif args.command == "build-bm25":
        chunks = files.read_chunks(spark, args.chunks)[0].filter(~F.col("is_front_matter"))
        index = KeywordIndex(spark, args.keywords, "chunk_id")
        print({"indexed": index.append(chunks, F.concat_ws(" ", "section_title", "raw_text")), "total": index.size()})
    elif args.command == "ask":
        _answer(spark, args, args.question)
    elif args.command == "chat":
        _chat(spark, args)
    elif args.command in ("eval", "verify"):
        asked = files.read_questions(spark, args.questions).withColumn("ord", F.monotonically_increasing_id())
        asked = A.first_questions(asked, args.first) if args.first else asked
        asked = asked.withColumns({"query_id": F.col("id"), "query": F.col("question")}).withColumn("vector", embedding(_model(args), F.col("query")))
        chunks, searches = _searches(spark, args)
        if args.command == "eval":
            glossary = VectorStore(spark, args.store).collection("glossary").withColumns({"source": F.element_at("metadata", F.lit("source")), "page_start": F.element_at("metadata", F.lit("page_start"))})
            told = A.evaluated(asked.select("query_id", "query", "vector"), searches, chunks, ExtractiveGenerator, glossary, [args.version])
            rows = told.join(asked.select("query_id", "question", "reference"), "query_id").withColumnRenamed("query_id", "id")
            files.write_responses(rows, args.output, "overwrite")
        else:
            hits = searches["dense_rag"](asked.select("query_id", "query", "vector")).drop("version")
            hits = hits.join(chunks.select("id", "source", "page_start", F.array_join("section_path", "/").alias("section_path"), "section_title", F.col("text").alias("document")), "id")
            sections = A.verification(asked.select("query_id", "query"), hits).join(asked.select("query_id", "ord"), "query_id").orderBy("ord").collect()  # one of each question
            files.write_report(spark, ["# Retrieval verification", "", *[r["report"] + "\n---\n" for r in sections]], args.output)
    elif args.command == "report":
        lines = A.report(spark.read.json(args.results))
        if args.output:
            files.write_report(spark, lines, args.output)
        else:
            print("\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
