"""Vector store: documents, and the glossary as the part of them that defines terms, with insert-if-absent writes in whole commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.filters import first_seen, indexable, new_rows
from ..operators.retrieval import dense_search
from ..plugins import Embedder, embedding
from ..profile import DEFAULT, Profile
from .snapshots import Snapshots, State

SCHEMA = "id string, document string, metadata map<string,string>, version string, vector array<float>"


def vector_record(chunks: DataFrame) -> DataFrame:
    """(id, document, metadata): metadata holds only the keys that have a value; the section path is joined by slashes."""
    fields = ["source", "version", "page_start", "page_end", "section_title", "heading_level", "content_type", "is_front_matter", "chunk_index", "is_row_chunk", "figure_caption", "term", "parent_chunk_id", "raw_text"]
    pairs = [x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]
    full = F.create_map(*pairs, F.lit("section_path"), F.array_join("section_path", "/"))
    return chunks.select(F.col("chunk_id").alias("id"), F.col("text").alias("document"), F.map_filter(full, lambda _, v: v.isNotNull()).alias("metadata"), "version", "content_type")


class VectorStore:
    """One table under a path, in folders by version and by whether a row is of the glossary; queries filter by both. A reader that holds
    a State reads that one, whatever is committed meanwhile."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.snapshots = spark, Snapshots(spark, path)

    def collection(self, name: str = "docs", state: State | None = None) -> DataFrame:
        found = self.snapshots.read("docs", state)
        if found is None:
            return self.spark.createDataFrame([], SCHEMA)
        return (found.filter("glossary") if name == "glossary" else found).drop("glossary")

    def count(self) -> dict[str, int]:
        facts = self.snapshots.state().facts
        return {n: int(facts.get(n, 0)) for n in ("docs", "glossary")}

    @staticmethod
    def _rows(records: DataFrame) -> DataFrame:
        return records.select("id", "document", "metadata", "version", "vector", F.coalesce(F.col("content_type") == "definition", F.lit(False)).alias("glossary"))

    @staticmethod
    def _counts(base: State, written: dict[str, DataFrame], fresh: bool = False) -> dict[str, float]:
        got = written["docs"].agg(F.count("*").alias("docs"), F.count_if("glossary").alias("glossary")).first()
        return {n: got[n] + (0 if fresh else base.facts.get(n, 0)) for n in ("docs", "glossary")} | {"added": got["docs"]}

    def add(self, records: Callable[[State], DataFrame] | DataFrame, writer: str = "", batch: int | None = None) -> int:
        """Append records (id, document, metadata, version, content_type, vector) whose id is not there yet, definitions to the glossary too, as
        one commit; the number added. records may be a function of the state that they are added to. A writer's batch counts once.
        """

        def build(base: State):
            own = records(base) if callable(records) else records
            return {"docs": ("append", self._rows(new_rows(own, self.collection(state=base), "id")), ["version", "glossary"])}

        before = self.snapshots.state().number
        state = self.snapshots.commit(build, writer, batch, self._counts)
        return int(state.facts["added"]) if state.number > before else 0

    def refresh(self, records: DataFrame) -> None:
        """Replace the rows by the records and what they do not name, as one commit."""

        def build(base: State):
            kept = new_rows(self.collection(state=base), records, "id").withColumn("content_type", F.element_at("metadata", F.lit("content_type")))
            return {"docs": ("replace", self._rows(kept).unionByName(self._rows(records)), ["version", "glossary"])}

        self.snapshots.commit(build, facts=lambda base, written: self._counts(base, written, True))

    def query(self, queries: DataFrame, n: int = 3, collection: str = "docs", where: Column | None = None) -> DataFrame:
        return dense_search(queries, self.collection(collection).select("id", "version", "vector"), n, where)

    def get(self, ids: DataFrame, collection: str = "docs") -> DataFrame:
        """Rows by id; ids that are not there are dropped."""
        return self.collection(collection).join(ids.select("id"), "id")


def index_chunks(store: VectorStore, chunks: DataFrame, model: Callable[[], Embedder], order: str = "line", profile: Profile = DEFAULT, refresh: bool = False, writer: str = "", batch: int | None = None) -> dict[str, int]:
    """Filter, drop repeated ids (the first counts), leave out what is stored, embed the rest and append it: running it again adds nothing."""
    wanted = indexable(chunks, profile)
    if order not in wanted.columns:
        wanted = wanted.withColumn(order, F.monotonically_increasing_id())
    once = first_seen(wanted, ["chunk_id"], [order])
    records = vector_record(once)
    counts = chunks.select(F.count("*").alias("total")).crossJoin(wanted.select(F.count("*").alias("searchable"), F.count_distinct("chunk_id").alias("ids"))).first()  # one row each
    if refresh:
        store.refresh(records.withColumn("vector", embedding(model, F.col("document"))))
        return {"total": counts["total"], "searchable": counts["searchable"], "indexed": counts["ids"]}
    # what is stored goes before the model runs
    added = store.add(lambda base: new_rows(records, store.collection(state=base), "id").withColumn("vector", embedding(model, F.col("document"))), writer, batch)
    return {"total": counts["total"], "searchable": counts["ids"], "skipped": counts["ids"] - added, "indexed": added}


def default_versions(queries: DataFrame, version: str | None, profile: Profile = DEFAULT) -> DataFrame:
    return queries.withColumn("versions", X.target_versions(F.col("query"), F.lit(version), profile))
