"""The corpus pipeline: language ID, exact dedup, near-dedup, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bagminhash, common, exact_dedup, langid, packing, pii
from lodestrata.llm.queries import secret, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Documents with a language, lang set to the one found; the others go."""
    columns = docs.columns
    found = langid.identify(docs, langid.labelled_sample(docs), common.work_dir(spark, "langid"), declared=F.col("lang"), host=F.col("source"))
    return found.filter("__accepted").withColumn("lang", F.col("__lang")).select(*columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.keep_one(docs, common.work_dir(spark, "exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Of each near-duplicate class, the document with the smallest doc_id."""
    return bagminhash.keep_one(docs, common.work_dir(spark, "near"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """All documents, with pseudonyms for personal data by the session's secret (spark.lodestrata.pii.secret)."""
    return pii.pseudonymise_frame(docs, secret(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """All documents' pieces, by a tokenizer's ids, in their bins."""
    return packing.pack_frame(docs, common.work_dir(spark, "packing"), spec=vocabulary())


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", pack)]

#: Trained models, signatures and best-fit packing are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes as soon as the next one's is written."""
    docs = common.table(spark, sf_dir, "documents")
    uri, before = common.work_dir(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), f"{uri}/{name}")
        if before is not None:
            common.remove(before)
        before = f"{uri}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
