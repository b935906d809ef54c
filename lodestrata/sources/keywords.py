"""The stored keyword index: blocks of postings, ordered by impact, that searches read only as far as they can matter."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.filters import new_rows
from ..operators.matching import best_matches
from ..operators.retrieval import asked_terms, scored, settled, top, weighed
from ..profile import BM25_B, BM25_K1, N_SPARSE
from .snapshots import Snapshots, State

#: postings of a block, and of a term whose postings are cut by hash first so that no task ranks them alone
BLOCK, SLICE = 256, 1 << 20
#: asked terms up to which they are named to the scan of the blocks
NAMED = 10_000
#: terms of a query up to which its blocks are bounded first: the bounds of many terms add up to more than any block could miss
BOUNDED = 12
#: what a score may lose in sums of doubles
SLACK = 1e-6


class KeywordIndex:
    """Tables of snapshots under a path: docs (pos, dl), tokens (pos, ts: the tokens of a document), dfs (term, df of a commit), terms (term, df, idf, n, avgdl; of the state), and blocks:
    term, n postings, the largest tf and the smallest dl among them, and the postings as arrays (pos, tf, dl).

    A block's bound follows from its tf and dl for whatever the average length will be, so appended documents leave it valid.
    Blocks are dealt by term and sorted by it in each file: a scan for asked terms leaves out row groups, and a hot term is many rows.
    Queries of many terms would read nearly all blocks, for each query anew: they are scored over the tokens, document by document.
    All tables change in one commit.
    """

    def __init__(self, spark: SparkSession, path: str, pos: str = "pos"):
        self.spark, self.pos, self.snapshots = spark, pos, Snapshots(spark, path)

    def append(self, docs: DataFrame, text: Column, writer: str = "", batch: int | None = None) -> int:
        """Index the documents whose position is not there yet, each position once (of several texts the least); the number added.

        An index without any token is an error when it is searched. A writer's batch counts once.
        """
        pos, store = self.pos, self.snapshots
        known = store.read("docs")
        fresh = docs.select(pos, X.tokens(F.coalesce(text, F.lit(""))).alias("ts"))
        fresh = (fresh if known is None else new_rows(fresh, known, pos)).groupBy(pos).agg(F.min("ts").alias("ts"))
        def build(base: State):
            old = {t: store.read(t, base) for t in ("docs", "dfs")}
            both = lambda name, df: df if old[name] is None else df.unionByName(old[name])
            own = counted if old["docs"] is None else new_rows(counted, old["docs"], pos)
            words = texts if old["docs"] is None else new_rows(texts, old["docs"], pos)
            words = {"tokens": ("append", words, [])} if old["docs"] is None or "tokens" in base.tables else {}  # all documents' or none
            sizes, post = own.select(pos, "dl").distinct(), own.filter("term IS NOT NULL")
            dfs = post.groupBy("term").agg(F.count("*").alias("df"))
            corpus = F.broadcast(both("docs", sizes).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
            terms = weighed(both("dfs", dfs).groupBy("term").agg(F.sum("df").alias("df")).join(corpus, how="cross"))  # one row
            return {"docs": ("append", sizes, []), **words, "dfs": ("append", dfs, []), "terms": ("replace", terms, []), "blocks": ("append", self._blocks(post, dfs, corpus), [])}

        def facts(base: State, written: dict[str, DataFrame]):
            n = written["docs"].count()
            return {"added": n, "docs": base.facts.get("docs", 0) + n, "terms": written["terms"].count()}

        before = store.state().number
        with store.staged(fresh) as texts, store.staged(counts(texts, pos)) as counted:  # texts are cut once
            state = store.commit(build, writer, batch, facts)
        return int(state.facts["added"]) if state.number > before else 0

    def _blocks(self, post: DataFrame, dfs: DataFrame, corpus: DataFrame) -> DataFrame:
        """Postings (pos, dl, term, tf) in blocks, the greatest impact first. Terms of many postings are cut into slices by position: few are, so their list is small."""
        pos = self.pos
        hot = F.broadcast(dfs.filter(F.col("df") > SLICE).select("term", F.ceil(F.col("df") / SLICE).alias("slices")))
        cut = post.join(hot, "term", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64(pos), "slices"), F.lit(0)).cast("int")).drop("slices")
        cut = cut.join(corpus.select("avgdl"), how="cross")  # one row
        place = F.row_number().over(Window.partitionBy("term", "slice").orderBy(_impact(F.col("tf"), F.col("dl")).desc(), pos)) - 1
        numbered = cut.withColumn("block", F.floor(place / BLOCK).cast("int"))
        blocks = numbered.groupBy("term", "slice", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct(pos, "tf", "dl")).alias("postings"))
        return blocks.sortWithinPartitions("term", "slice", "block")  # dealt by term and slice already

    def _state(self) -> State:
        state = self.snapshots.state()
        if not state.facts.get("terms"):
            raise ValueError(f"there is no keyword index of any text in {self.snapshots.path}")
        return state

    def terms(self) -> DataFrame:
        return self.snapshots.read("terms", self._state())

    def size(self) -> int:
        return int(self.snapshots.state().facts.get("docs", 0))

    def _asked(self, queries: DataFrame, state: State | None = None) -> tuple[DataFrame, DataFrame]:
        """(asked terms with their weights, blocks of these terms) in one state. A stated set of few terms is named to the scan."""
        state, asked = state or self._state(), asked_terms(queries)
        names = asked.select("term").distinct()
        few = [r[0] for r in names.limit(NAMED + 1).collect()]
        blocks, terms = self.snapshots.read("blocks", state), self.snapshots.read("terms", state)
        if len(few) <= NAMED:
            blocks, terms = blocks.filter(F.col("term").isin(few)), terms.filter(F.col("term").isin(few))
        return asked.join(terms.select("term", "idf", "avgdl"), "term").withColumn("weight", F.col("qtf") * F.col("idf")), blocks

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, pos, score) of all documents that hold a token of the query."""
        asked, blocks = self._asked(queries)
        postings = blocks.select("term", F.inline("postings"))
        return scored(asked.select("query_id", "term", "qtf"), postings, asked.select("term", "idf", "avgdl").distinct(), self.pos)

    @staticmethod
    def _bounded(asked: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
        """Blocks by query and term with `read`: whether a document of the best n can be in them.

        A score that n documents reach is known from the first blocks of any one term. A block whose bound and the greatest
        bounds of the query's other terms stay below it holds no document of the best n. Where a term has a
        negative weight nothing is known, and all blocks are read.
        """
        weights = asked.select("query_id", "term", "weight", "avgdl")
        bound = F.greatest(F.col("weight") * _impact(F.col("most_tf"), F.col("least_dl")), F.lit(0.0))
        found = blocks.join(weights, "term").withColumn("bound", bound)
        most = found.groupBy("query_id", "term", "weight").agg(F.max("bound").alias("most"))
        whole = most.groupBy("query_id").agg(F.sum("most").alias("whole"), F.min("weight").alias("least"))
        first = found.filter(F.col("block") * BLOCK < n).select("query_id", "term", "weight", "avgdl", F.explode("postings").alias("p"))
        part = first.select("query_id", "term", (F.col("weight") * _impact(F.col("p.tf"), F.col("p.dl"))).alias("part"))
        reached = top(part, ["query_id", "term"], [F.col("part").desc()], n).filter(F.col("rank") == n).groupBy("query_id").agg(F.max("part").alias("reached"))
        limits = whole.join(reached, "query_id", "left").select("query_id", "whole", F.when(F.col("least") >= 0, F.col("reached")).alias("reached"))
        limits = most.join(limits, "query_id").select("query_id", "term", (F.col("reached") - SLACK - (F.col("whole") - F.col("most"))).alias("needed"))
        return found.join(limits, ["query_id", "term"]).withColumn("read", F.coalesce(F.col("bound") >= F.col("needed"), F.lit(True)))

    def search(self, queries: DataFrame, n: int = N_SPARSE) -> DataFrame:
        """(query_id, pos, score, rank): the best n documents of each query (query_id, query), ties by position.

        Of queries of few terms, blocks that cannot matter are left out; those of many terms meet the documents' tokens, of which the
        best of each task are shuffled.
        """
        state = self._state()
        asked, blocks = self._asked(queries, state)
        asked = asked.withColumn("terms", F.count("*").over(Window.partitionBy("query_id")))
        many, tokens = asked.filter(F.col("terms") > BOUNDED), self.snapshots.read("tokens", state)
        long = tokens is not None and bool(asked_terms(queries).groupBy("query_id").count().filter(F.col("count") > BOUNDED).take(1))
        columns = ["query_id", "weight", "avgdl", F.explode("postings").alias("p")]
        few = self._bounded(asked.filter(F.col("terms") <= BOUNDED), blocks, n).filter("read").select(*columns)
        post = few if tokens is not None else few.unionByName(blocks.join(many, "term").select(*columns))  # an index of before there were tokens
        part = F.col("weight") * _impact(F.col("p.tf"), F.col("p.dl"))
        sums = post.groupBy("query_id", F.col(f"p.{self.pos}").alias(self.pos)).agg(F.sum(part).alias("score"))
        if long:
            sums = sums.unionByName(best_matches(many.select("query_id", "term", "qtf"), many.select("term", "idf", "avgdl").distinct(), tokens, n, self.pos))
        return top(sums, ["query_id"], [settled("score").desc(), self.pos], n)

    def read_share(self, queries: DataFrame, n: int = N_SPARSE) -> DataFrame:
        """(query_id, postings, read): the postings of each query's terms, and those that a bounded search reads."""
        found = self._bounded(*self._asked(queries), n)
        return found.groupBy("query_id").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("read"))


def counts(texts: DataFrame, pos: str) -> DataFrame:
    """(pos, dl, term, tf) of the tokens of texts (pos, ts), without a shuffle: a text is one row. A text without tokens has one row with no term."""
    kind = texts.schema[pos].dataType
    schema = T.StructType([T.StructField(pos, kind), T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                ids, ts = (c.slice(a, 1000) for c in batch.columns)
                size = pc.list_value_length(ts).fill_null(0).to_numpy(zero_copy_only=False)
                coded = ts.flatten().dictionary_encode()
                width = max(1, len(coded.dictionary))
                keys, tf = np.unique(np.repeat(np.arange(len(ids)), size) * width + coded.indices.to_numpy(), return_counts=True)
                none = np.flatnonzero(size == 0)
                rows, terms = np.concatenate([keys // width, none]), pa.concat_arrays([coded.dictionary.take(pa.array(keys % width)), pa.nulls(len(none), coded.dictionary.type)])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(size[rows].astype(np.int32)), terms, pa.array(np.concatenate([tf, none * 0]))], names=schema.names)

    return texts.select(pos, "ts").mapInArrow(work, schema)


def _impact(tf: Column, dl: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """What an occurrence counts for, before the term's weight: grows with tf, falls with dl. Needs avgdl."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
