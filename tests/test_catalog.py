"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import duckdb
import pytest

from lodestrata.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda v: None if isinstance(v, float) and v != v else round(v, 7) if isinstance(v, float) else v
    return sorted((tuple(flat(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    expected = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_entry_without_llm(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (60, 59)])
def test_splitter_against_recursion(spark, size, overlap):
    """Texts of all separators and of words longer than a piece."""
    import random

    import pandas as pd
    from pyspark.sql import functions as F

    from lodestrata.operators import splitter

    r = random.Random(size)
    tokens = ["a", "bb", "\n", "\n\n", ". ", " ", "ccccccc", "é" * 30, "x" * 50]
    texts = [(i, "".join(r.choice(tokens) for _ in range(r.randint(0, 200)))) for i in range(200)] + [(200, None), (201, " \n ")]
    got = splitter.split_frame(spark.createDataFrame(texts, "doc_id long, text string"), "text", F.lit("text"), size, overlap)
    con = duckdb.connect()
    con.register("texts", pd.DataFrame(texts, columns=["doc_id", "text"]))
    expected = con.sql("WITH RECURSIVE " + catalog.split_sql("texts", size, overlap) + " SELECT doc_id, chunk_index, chunk FROM split").fetchall()
    assert sorted(map(tuple, got.select("doc_id", "chunk_index", "chunk").collect())) == sorted(expected)
