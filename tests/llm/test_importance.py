import hashlib
import math
import re
import zlib
from collections import Counter

from lodestrata.llm import importance as I
from lodestrata.llm.queries import QUERIES


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def brute_force(docs, target):
    made = [(d, *features(t)) for d, t in docs]
    s = Counter(b for _, _, f in made for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    rows = []
    for d, n_words, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    n = len(fit) * 25 // 100
    drawn = [(*r[:4], i + 1) for i, r in enumerate(fit[:n])]
    rest = [(*r[:4], None) for r in [*fit[n:], *(r for r in rows if r[4] < 20)]]
    return sorted(drawn + rest, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def texts(df, key=None):
    return [(r[key], r.text) if key else r.text for r in df.collect()]


def test_query_matches_brute_force(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = QUERIES["op11_importance_resampling"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert result(got) == brute_force(texts(docs, "doc_id"), texts(target))


def test_sql_matches_brute_force(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(con.sql(I.RESAMPLE_SQL).fetchall(), key=repr) == brute_force(texts(docs, "doc_id"), texts(target))


def test_odd_and_empty_tables(spark, odd_docs, no_docs, uri):
    more = odd_docs.unionByName(odd_docs.withColumn("text", I.F.concat(I.F.lit("Été A-B c_d 0x9 "), I.F.repeat(I.F.lit("ÀB x "), 12))).withColumn("doc_id", I.F.col("doc_id") + 20))
    for target in (more.limit(3), no_docs):
        assert result(I.resample(more, target, uri("x"))) == brute_force(texts(more, "doc_id"), texts(target))
    assert I.resample(no_docs, odd_docs, uri("y")).collect() == []


def test_ties_go_to_the_smaller_id(spark, uri):
    rows = [(i, " ".join(f"w{i % 2}" for _ in range(25))) for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(I.resample(docs, docs.limit(1), uri("t")))
    assert got == brute_force(rows, [rows[0][1]])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 21))


def test_scoring_explodes_nothing(spark, odd_docs):
    import numpy as np

    plan = I.scored(I.featured(odd_docs, "doc_id"), np.zeros(10000, np.int64))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan
