"""Language identification by Bayesian evidence fusion (operator 2).

Four pieces of evidence about a document's language are combined by Bayes' rule:

* the likelihood of its whole text under byte-trigram models of each language and of a background without language;
* the language that its markup (or metadata) declares, by how often it is declared for texts of each language;
* the suffix of its address, in the same way;
* its host: the host's share of each language, smoothed towards that of the hosts which share its last three labels, those towards that of
  the last two, those towards that of the last, and those towards the corpus'. An address of numbers has no labels.

The models are fitted on a bounded sample of labelled rows (`FIT_ROWS` of each label by least hash, so that a label has a
model however rare; of more than `LABELS` labels, those of the most texts). All counts behind the other evidence are
grouped aggregations over all rows, of the texts' own posteriors. A document is rejected when the background
wins, or no language has `ACCEPT` of the posterior.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 1 << 15
#: bytes whose wide arrays are in memory at a time
WINDOW = 1 << 20
#: different texts of each label that its text model is fitted on, at most; the driver gets counts of their trigrams only
FIT_ROWS = 2_000
#: trigrams of one text are not independent: a text counts as this many at most
EFFECTIVE = 48
#: labels that have a text model, at most: those of the most texts. Others are read as declarations only
LABELS = 500
ACCEPT = 0.5
#: pseudo-counts: a trigram's in a model, a declaration's, and a parent's weight in its child's prior
ALPHA, DECLARED, PARENT = 0.1, 1.0, 20.0
NO_LANGUAGE = "und"
#: share of texts without language before any evidence
JUNK_PRIOR = 0.01
#: tables of hosts, levels and declarations are sent to all tasks if they take no more than this; else they are joined by a shuffle
BROADCAST_BYTES = 16 << 20
#: levels of a host's name above itself
LEVELS = 3


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte trigram, number of trigrams of each text); digits and ASCII marks count as blanks."""
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    encoded = [t.lower().encode("utf-8", "replace") for t in texts]
    whole = np.frombuffer(b"  ".join([*encoded, b""]), np.uint8)
    ends = np.cumsum([len(e) + 2 for e in encoded])
    buckets, counts = [], np.zeros(len(texts), np.int64)
    for a in range(0, max(0, len(whole) - 2), WINDOW):  # wide arrays of a window at a time; trigrams of two windows are in the first
        raw = table[whole[a : a + WINDOW + 2]]
        h = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)
        bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.uint16)
        at = np.arange(a, a + len(bucket))
        doc = np.searchsorted(ends, at, "right")
        blank = raw == 32
        keep = (at + 5 <= ends[doc]) & ~(blank[:-2] & blank[1:-1] | blank[1:-1] & blank[2:])  # within a text, not in a run of blanks
        buckets.append(bucket[keep])
        counts += np.bincount(doc[keep], minlength=len(texts))
    return np.concatenate([*buckets, np.zeros(0, np.uint16)]), counts


def fit(names: list[str], seen: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bucket by language; the last row is the background), from the counts by language and bucket."""
    counts = np.ones((len(names) + 1, BUCKETS))
    counts[:-1] = seen + ALPHA
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _count(batches):
    import pyarrow as pa

    for batch in batches:
        for a, b in common.text_batches(batch, 1, 1_000_000):
            part = batch.slice(a, b - a)
            buckets, sizes = trigrams(part.column(1).to_pylist())
            labels, which = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
            both, n = np.unique(np.repeat(which, sizes) * BUCKETS + buckets.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(labels[both // BUCKETS], pa.string()), pa.array(both % BUCKETS, pa.int32()), pa.array(n, pa.int64())], names=["l", "bucket", "n"])


def text_posteriors(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Posterior of each language and the background by the text alone, languages alike before it."""
    buckets, sizes = trigrams(texts)
    out = np.zeros((len(texts), len(model)))
    real = np.flatnonzero(sizes)
    if len(buckets):
        starts = (np.cumsum(sizes) - sizes)[real]
        if len(buckets) > 2 * WINDOW:  # one long text, as batches are: by its histogram
            for i, a in zip(real.tolist(), starts.tolist(), strict=True):
                out[i] = model.astype(np.float64) @ np.bincount(buckets[a : a + sizes[i]], minlength=BUCKETS)
        else:
            for k, row in enumerate(model):
                out[real, k] = np.add.reduceat(row[buckets].astype(np.float64), starts)
    n = np.maximum(sizes, 1)
    out *= (np.minimum(n, EFFECTIVE) / n)[:, None]
    out += np.log([(1 - JUNK_PRIOR) / max(1, len(model) - 1)] * (len(model) - 1) + [JUNK_PRIOR])
    out[sizes == 0, :-1] = -np.inf  # a text without letters has no language
    out[sizes == 0, -1] = 0
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def primary(tag: Column) -> Column:
    """The language of a tag such as "en-GB"; null where it names none."""
    return F.nullif(F.lower(F.substring_index(F.trim(tag), "-", 1)), F.lit(""))


def labelled_sample(docs: DataFrame, text: str = "text", label: str = "lang", rows: int = FIT_ROWS, most: int = LABELS) -> tuple[list[str], np.ndarray]:
    """The models, each fitted on the `rows` texts of its label with the least hash, copies aside. The `most` labels of the most
    texts have one (ties: the first by name), but for NO_LANGUAGE, null and empty ones, "-x" among them; the driver holds a row per label with a model, and the models."""
    spark = docs.sparkSession
    own = primary(F.col(label))
    labelled = docs.filter(F.length(text) > 0).select(F.col(text).alias("t"), own.alias("l"), F.xxhash64(text).alias("h")).filter(F.col("l") != NO_LANGUAGE)
    totals = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(most).collect()}
    if not totals:
        return fit([], np.zeros((0, BUCKETS)))
    names = sorted(totals)

    def below(edges: dict[str, int]) -> DataFrame:
        some = F.broadcast(spark.createDataFrame([*edges.items()], "l string, edge long"))  # one row per label with a model
        return labelled.join(some, "l").filter(F.col("h") <= F.col("edge"))

    # hashes are even, so a bound on them leaves about twice the rows that are wanted; copies count once and move only their hashes
    share, edges = {x: min(1.0, 2 * rows / n) for x, n in totals.items()}, {}
    while share:
        least = below({x: -(1 << 63) + int(p * (1 << 64)) - 1 for x, p in share.items()}).select("l", "h").distinct()
        least = least.withColumn("nth", F.row_number().over(Window.partitionBy("l").orderBy("h"))).filter(F.col("nth") <= rows)
        found = {r["l"]: r for r in least.groupBy("l").agg(F.max("h").alias("edge"), F.count(F.lit(1)).alias("n")).collect()}
        done = {x for x, p in share.items() if x in found and (p >= 1 or found[x]["n"] >= rows)}
        edges |= {x: found[x]["edge"] for x in done}
        share = {x: min(1.0, p * 4) for x, p in share.items() if x not in done}
    sample = below(edges).groupBy("l", "h").agg(F.min("t").alias("t")).select("l", "t")
    counted = sample.mapInArrow(_count, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((len(names), BUCKETS))
    at = np.searchsorted(np.array(names, object), np.array(counted.column("l").to_pylist(), object)) if counted.num_rows else np.zeros(0, int)
    seen[at, counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return fit(names, seen)


def numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def masses(rows: DataFrame, by: str, k: int) -> DataFrame:
    """(by, m, n): the sums of the arrays x (the mass of k languages and the background, then a count of rows) of each value.

    A language is a row here, never a column, so plans are alike for any number of them; zeros, most of an array, make no row.
    A value's sums are made before they meet, so that a value of many rows is no large group.
    """
    long = rows.select(by, F.posexplode("x").alias("i", "x")).filter("x > 0").groupBy(by, "i").agg(F.sum("x").alias("x"))
    sums = long.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("e"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.coalesce(F.col("e")[i], F.lit(0.0)))
    return sums.select(by, dense.alias("m"), F.col("e")[k + 1].alias("n"))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], uri: str, text: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all) and __lang, __posterior, __text_lang, __accepted, one row per row.

    Null or absent evidence takes no part. A text that is null, empty or without letters has the language "und" by its text, and
    is rejected unless the other evidence is beyond doubt, which it never is alone. Without a single labelled row there
    is no language and all rows are rejected. Equal rows get equal results. docs must not have columns that
    begin with two underscores.
    """
    spark = docs.sparkSession
    names, table = model
    k = len(names)
    shared = spark.sparkContext.broadcast(table)
    keep = docs.columns if keep is None else keep
    none = F.lit(None).cast("string")
    evidence = [(primary(declared) if declared is not None else none).alias("__declared"), (F.lower(host) if host is not None else none).alias("__host"), (F.lower(suffix) if suffix is not None else none).alias("__suffix")]
    # a text that is kept goes to the workers once
    given = docs.select(*([] if text in keep else [F.col(text).alias("__text")]), *evidence, *[F.col(f"`{c}`") for c in keep])
    place = given.columns.index(text if text in keep else "__text")
    kept = [f for f in given.schema.fields if f.name != "__text"]
    schema = T.StructType([*kept, T.StructField("__p", T.ArrayType(T.DoubleType()))])

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in common.text_batches(batch, place, 1_000_000):
                part = batch.slice(a, b - a)
                p = text_posteriors([t or "" for t in part.column(place).to_pylist()], shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(np.round(p, 9).ravel()))
                columns = [c for name, c in zip(batch.schema.names, part.columns, strict=True) if name != "__text"]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=schema.names)

    scored = common.stash(given.mapInArrow(score, schema), f"{uri}/scored")
    whole = F.concat("__p", F.array(F.lit(1.0)))

    # the corpus' prior, and for each declaration and suffix the mass of each language: few values are common, all are counted
    top = masses(scored.select(F.lit(0).alias("all"), whole.alias("x")), "all", k).first()
    total = top["m"] if top else [0.0] * (k + 1)
    prior = [(x + 1 / (k + 1)) / (sum(total) + 1) for x in total]

    def likelihood(column: str) -> DataFrame:
        """log P(value | language), with a pseudo-count for each value."""
        by = common.stash(masses(scored.filter(F.col(column).isNotNull()).select(column, whole.alias("x")), column, k), f"{uri}/{column}")
        found = dict(by.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x")).collect())
        n = max(1, by.count())
        sums = numbers([found.get(i, 0.0) + DECLARED * n for i in range(k + 1)])
        return by.select(column, F.zip_with("m", sums, lambda x, s: F.log((x + DECLARED) / s)).alias(f"{column}_log"))

    def attach(rows: DataFrame, facts: DataFrame, column: str) -> DataFrame:
        few = facts.count() * (16 * (k + 1) + 300) <= BROADCAST_BYTES  # names are short beside that
        return rows.join(F.broadcast(facts) if few else facts, column, "left")

    # hosts and, for each level, the names of so many last labels; a host's name itself is its last level
    hosts = masses(scored.filter(F.col("__host").isNotNull()).select("__host", whole.alias("x")), "__host", k)
    address = F.col("__host").rlike(r"^[0-9.]+$") | F.contains("__host", F.lit(":"))
    labels = F.when(address, F.array("__host")).otherwise(F.split("__host", r"\."))
    # every host below or at a level's name counts there; a host is smoothed by the levels above itself alone
    last = lambda j: F.when(F.size(labels) >= j, F.array_join(F.slice(labels, F.size(labels) - j + 1, j), "."))
    hosts = common.stash(hosts.withColumn("depth", F.size(labels)).withColumns({f"level{j}": last(j) for j in range(1, LEVELS + 1)}), f"{uri}/hosts")
    smoothed = lambda m, n, above: F.zip_with(m, above, lambda x, a: (x + PARENT * a) / (F.col(n) + PARENT))
    smooth, above = hosts, numbers(prior)
    for j in range(1, LEVELS + 1):
        below = hosts.filter(F.col(f"level{j}").isNotNull()).select(f"level{j}", F.concat("m", F.array("n")).alias("x"))
        level = masses(below, f"level{j}", k).select(f"level{j}", F.col("m").alias(f"m{j}"), F.col("n").alias(f"n{j}"))
        smooth = attach(smooth, common.stash(level, f"{uri}/level{j}"), f"level{j}")
        smooth = smooth.withColumn(f"q{j}", F.when(F.col("depth") > j, smoothed(f"m{j}", f"n{j}", above)).otherwise(above))
        above = F.col(f"q{j}")
    smooth = smooth.select("__host", F.transform(smoothed("m", "n", above), lambda x: F.log(x)).alias("__host_log"))
    smooth = common.stash(smooth, f"{uri}/smooth")

    rows = attach(attach(attach(scored, likelihood("__declared"), "__declared"), likelihood("__suffix"), "__suffix"), smooth, "__host")
    flat = [math.log((1 - JUNK_PRIOR) / max(1, k))] * k + [math.log(JUNK_PRIOR)]
    zero = F.lit(0.0)
    joint = F.zip_with("__p", numbers(flat), lambda x, f: F.log(F.greatest(x, F.lit(1e-12))) - f)  # the text's likelihood
    for more, absent in (("__host_log", [math.log(x) for x in prior]), ("__declared_log", [0.0] * (k + 1)), ("__suffix_log", [0.0] * (k + 1))):
        joint = F.zip_with(joint, F.coalesce(more, numbers(absent)), lambda x, y: x + y)

    rows = rows.withColumn("__joint", joint)
    most = F.array_max("__joint")
    where = F.array_position("__joint", most).cast("int")
    shares = F.aggregate("__joint", zero, lambda s, x: s + F.exp(x - most))
    all_names = F.array(*[F.lit(x) for x in [*names, NO_LANGUAGE]])
    text_best = F.array_position("__p", F.array_max("__p")).cast("int")
    rows = rows.withColumn("__lang", F.element_at(all_names, where)).withColumn("__posterior", F.round(1 / shares, 6)).withColumn("__text_lang", F.element_at(all_names, text_best))
    letters = F.col("__text_lang") != NO_LANGUAGE
    accepted = (F.col("__lang") != NO_LANGUAGE) & (F.col("__posterior") >= ACCEPT) & (letters | (F.element_at("__p", -1) < 1))
    return rows.select(*[F.col(f"`{c}`") for c in keep], "__lang", "__posterior", "__text_lang", accepted.alias("__accepted"))


# -- pages ----------------------------------------------------------------------------------------------------------


def page_evidence(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with the columns body (visible text), declared, host and suffix, by functions of the JVM."""
    raw = F.coalesce(F.col(html), F.lit(""))
    body = F.regexp_replace(raw, r"(?is)<(script|style|head|nav)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[#a-z0-9]+;", " ")
    host = F.regexp_extract(F.col(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    tail = F.regexp_extract(host, r"\.([A-Za-z]{2,})$", 1)
    declared = F.regexp_extract(raw, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return pages.withColumns({"body": F.trim(body), "declared": F.nullif(declared, F.lit("")), "host": F.nullif(host, F.lit("")), "suffix": F.nullif(tail, F.lit(""))})
