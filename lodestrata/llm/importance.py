"""Target-distribution importance resampling (operator 11).

Documents are weighed by hashed features (words and runs of two words): the log ratio of each feature's bucket between
a target corpus and the raw corpus. A document's features are one array of buckets made by higher-order functions;
it is folded over element_at of a literal array of gains, so scoring explodes and joins nothing. Only totals by bucket
are shuffled before it, and rows of a few numbers after it.

The draw is Gumbel top-k: the weight plus noise from a hash of the id. Ranks need no sort of all rows in one task: scores are
whole numbers in a bounded range, so counts by score (bounded) give each score its first rank, and rows are numbered within
their score only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

#: what stands between words: ASCII characters but digits and letters, [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]
BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000


def words(text: str) -> Column:
    """The text's words, A-Z in lower case and other letters as they are: one translation, then cuts at blanks (a pattern takes several times as long)."""
    plain = F.translate(F.col(text), BREAKS + UPPER, " " * len(BREAKS) + LOWER)
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), " "), "")


def buckets(of: Column, n: int = BUCKETS) -> Column:
    """The buckets of all words and of all runs of two words, repeats included."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(F.encode(feature, "UTF-8")) % n).cast("int")

    pairs = F.zip_with(F.slice(of, 1, F.greatest(F.size(of) - 1, F.lit(0))), F.slice(of, 2, F.greatest(F.size(of) - 1, F.lit(0))), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(of, bucket), pairs)


def featured(df: DataFrame, key: str | None, text: str = "text") -> DataFrame:
    """[key,] n_words, and the buckets of the row's text."""
    rows = df.select(*([key] if key else []), words(text).alias("words"))
    return rows.select(*([key] if key else []), F.size("words").alias("n_words"), buckets(F.col("words")).alias("buckets"))


def totals(rows: DataFrame) -> dict[int, int]:
    """Features by bucket; at most as many as there are buckets."""
    return {r[0]: r[1] for r in rows.select(F.explode("buckets").alias("b")).groupBy("b").count().collect()}


def gains(raw: dict[int, int], target: dict[int, int], n: int = BUCKETS) -> np.ndarray:
    """Of each bucket 1000 times the log ratio of the smoothed shares in target and raw, rounded down."""
    s, t = (np.array([d.get(b, 0) for b in range(n)], np.float64) for d in (raw, target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def literal(values: np.ndarray) -> Column:
    """An array literal: the optimizer folds it to one value."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def scored(rows: DataFrame, gain: np.ndarray, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """key, n_words, n_features, weight and score of featured rows. A null key has the noise of the text "null"."""
    n = F.size("buckets").cast("long")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal(gain), b + 1))
    out = rows.select(key, "n_words", n.alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 256), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return out.withColumn("weight", weight).withColumn("score", F.col("weight") + noise).drop("total")


def resample(docs: DataFrame, target: DataFrame, uri: str, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Every row's key, n_features, weight, score and rank (null where not drawn).

    Of the rows with at least `least_words` words, `percent` in a hundred (rounded down) are drawn, highest score first, ties to the smaller
    key, null keys last. Null texts have no words. Rows that repeat a key are rows of their own; equal keys of equal score tie by n_features.
    Empty documents: no rows; an empty target: every gain is that of its smoothing alone. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = stash(featured(docs, key, text), f"{uri}/features")
    gain = gains(totals(rows), totals(featured(target, None, target_text)))
    weighed = stash(scored(rows, gain, key, seed), f"{uri}/scores")
    fit = weighed.filter(F.col("n_words") >= least_words)
    # a gain is at most 1000 ln(2^64) and the noise within [-3200, 23000]: there are fewer than 120,000 scores, whatever the input
    counts = sorted(((r[0], r[1]) for r in fit.groupBy("score").count().collect()), reverse=True)
    most, before, starts = sum(n for _, n in counts) * percent // 100, 0, []
    for score, n in counts:
        if before >= most:
            break
        starts.append((score, before))
        before += n
    first = F.broadcast(spark.createDataFrame(starts, "score long, before long"))
    lowest = starts[-1][0] if starts else None
    above = (F.col("n_words") >= least_words) & (F.col("score") >= lowest) if starts else F.lit(False)
    order = Window.partitionBy("score").orderBy(F.col(key).asc_nulls_last(), "n_features")
    place = (F.col("before") + F.row_number().over(order)).cast("long")
    drawn = weighed.filter(above).join(first, "score").withColumn("place", place)
    columns = [F.col(key), F.col("n_features"), F.col("weight"), F.col("score")]
    ranked = drawn.select(*columns, F.when(F.col("place") <= most, F.col("place")).alias("rank"))
    return ranked.unionByName(weighed.filter(~above).select(*columns, F.lit(None).cast("long").alias("rank")))


#: resample() of documents towards benchmark; crc32 by its table, which the first part makes
RESAMPLE_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
texts AS (SELECT doc_id AS id, true AS raw, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT item_id, false, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
cut AS (SELECT row_number() OVER () AS r, id, raw, coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
made AS (SELECT r, unnest(w) AS f FROM cut UNION ALL SELECT r, unnest(list_transform(w[:-2], lambda x, i: x || ' ' || w[i + 1])) FROM cut WHERE len(w) > 1),
counted AS (SELECT r, f, count(*) AS n FROM made GROUP BY ALL),
hashed AS (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM counted), crc),
placed AS (SELECT r, b, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT b, coalesce(sum(n) FILTER (raw), 0) AS s, coalesce(sum(n) FILTER (NOT raw), 0) AS t FROM placed JOIN cut USING (r) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS g FROM sums),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS total FROM placed JOIN gains USING (b) GROUP BY r),
scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight FROM cut LEFT JOIN weights USING (r) WHERE raw),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ranked"""
