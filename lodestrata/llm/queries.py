"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, archives, bagminhash, bpe_trie, common, exact_dedup, importance, langid, licences, packing, pii, prefix_counts, time_partitions, token_store

#: The setting that holds the pseudonyms' secret, and the tokenizer that lengths are counted with.
SECRET, TOKENIZER = "spark.lodestrata.pii.secret", "byte_bpe_50k.json"


def secret(spark: SparkSession) -> str:
    """The session's secret. Without one a run draws its own, so that its pseudonyms link values within the run and nobody can undo them."""
    return spark.conf.get(SECRET, "") or secrets.token_hex(32)


def vocabulary(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return token_store.token_spec(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_frame(common.table(spark, sf_dir, "documents"), common.work_dir(spark, "packing"), spec=vocabulary())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: text, the declared language, and the source as host."""
    docs = common.table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.labelled_sample(docs), common.work_dir(spark, "langid"), declared=F.col("lang"), host=F.col("source"), keep=["doc_id", "lang"])
    return found.select("doc_id", F.col("lang").alias("declared"), F.col("__text_lang").alias("text_lang"), F.col("__lang").alias("lang"), F.col("__posterior").alias("posterior"), F.col("__accepted").alias("kept"))


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: visible text, html lang, address suffix and host; text models from the labelled documents."""
    pages = langid.page_evidence(common.table(spark, sf_dir, "pages"))
    model = langid.labelled_sample(common.table(spark, sf_dir, "documents"))
    found = langid.identify(pages, model, common.work_dir(spark, "langid"), "body", F.col("declared"), F.col("host"), F.col("suffix"), ["page_id", "declared"])
    return found.select("page_id", "declared", F.col("__text_lang").alias("text_lang"), F.col("__lang").alias("lang"), F.col("__posterior").alias("posterior"), F.col("__accepted").alias("kept"))


def op3_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    manifest = token_store.write_tokens(docs, vocabulary("byte_bpe_50k.json"), common.kept_dir(spark, "tokens"), end_id=2)
    return token_store.read_tokens(manifest)


def op4_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archives.write_archives(common.table(spark, sf_dir, "pages"), common.kept_dir(spark, "archives"))
    return archives.read_archives(manifest).drop("url")


def op5_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, common.work_dir(spark, "ann"), k=20)


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_frame(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(common.table(spark, sf_dir, "documents"), common.work_dir(spark, "exact")).drop("in_history")


def op8_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pii.pseudonymise_frame(common.table(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark), spans="found")
    return pii.summary(marked, "doc_id", "found", "text")


def op9_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.table(spark, sf_dir, "documents"))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(common.table(spark, sf_dir, "documents"), common.work_dir(spark, "near"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return importance.resample(docs, target, common.work_dir(spark, "resample"))


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = common.table(spark, sf_dir, "clicks")
    return time_partitions.rewrite_clicks(spark, clicks, common.kept_dir(spark, "clicks"), common.work_dir(spark, "layout"))


def op13_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return prefix_counts.totals(prefix_counts.prefix_table(docs, public_tokenizers.path("piece_bpe_32k.model"), common.work_dir(spark, "prefixes")), limit=4096)


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_language_id, op3_huffman_tokens, op4_zip_warc, op5_hash_prefix_forest, op6_trie_bpe, op7_perfect_hash_dedup, op8_feistel_pii, op9_licence_rules, op10_bagminhash, op11_importance_resampling, op12_time_partitions, op13_prefix_token_counts, page_language_id)
}

ORACLE_SQL: dict[str, str] = {
    "op4_zip_warc": archives.ARCHIVES_SQL,
    "op7_perfect_hash_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_licence_rules": licences.scan_sql(),
    "op11_importance_resampling": importance.RESAMPLE_SQL,
}
