import collections
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import langid


def corpus(rng, n):
    """n texts of a common language, a few of two rare ones, each with words of its own."""
    words = {x: ["".join(rng.choice(list(letters), 6)) for _ in range(60)] for x, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "qrstuvwx"))}
    make = lambda x: " ".join(rng.choice(words[x], 30))
    rows = [(i, make("aa"), "aa") for i in range(n)] + [(n + i, make("bb"), "bb-BB") for i in range(6)] + [(n + 10, make("cc"), "CC")]
    return rows + [(n + 20 + i, make("bb"), None) for i in range(20)]


def test_each_label_has_a_model(spark, uri, rng):
    rows = corpus(rng, 3000)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.labelled_sample(df, rows=20)
    assert model[0] == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.identify(df, model, uri("l"), declared=F.col("lang")).collect()}
    for i, _, label in rows:
        assert got[i]["__accepted"] and got[i]["__lang"] == ("bb" if label is None else label[:2].lower())


def test_model_against_brute_force(spark, rng):
    """The counts behind the models: of each label's different texts, those with the least hash."""
    rows = corpus(rng, 300)
    rows += [(None, t, x) for _, t, x in rows[:80]] * 3 + [(1, "", "dd"), (2, None, "dd"), (3, "x y z", "und")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    names, table = langid.labelled_sample(df, rows=20)
    hashes = collections.defaultdict(dict)
    for r in df.filter("lang IS NOT NULL AND length(text) > 0 AND lang != 'und'").select("text", "lang", F.xxhash64("text").alias("h")).collect():
        hashes[r.lang[:2].lower()][r.h] = r.text
    assert names == sorted(hashes)
    for name, row in zip(names, table, strict=False):
        texts = [t for _, t in sorted(hashes[name].items())[:20]]
        counts = np.bincount(np.concatenate([langid.trigrams([t])[0] for t in texts]), minlength=langid.BUCKETS) + langid.ALPHA
        assert np.allclose(row, np.log(counts / counts.sum()), atol=1e-5)


def test_empty_labels_are_none(spark, uri, rng):
    rows = [(i, t, x) for i, t, x in corpus(rng, 50)] + [(900 + i, t, x) for i, (_, t, _) in enumerate(corpus(rng, 9)) for x in ("", "-x", " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.labelled_sample(df)
    assert model[0] == ["aa", "bb", "cc"]
    assert {r["__lang"] for r in langid.identify(df, model, uri("l"), declared=F.col("lang")).collect()} <= {"aa", "bb", "cc", "und"}


@pytest.mark.parametrize("labels", [300, 10_000])
def test_many_labels(spark, uri, rng, labels):
    """Labels are rows: the plan does not grow with them. Beyond the bound those of the most texts have a model, the others are no language."""
    codes = [f"{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(labels)]
    rows = [(i, " ".join([code * 2, code[::-1] * 2] * 4), code) for i, code in enumerate(codes)] + [(labels + i, rows_text, codes[7]) for i, rows_text in enumerate(["the bus width of a card"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, table = langid.labelled_sample(df, most=300)
    assert len(names) == 300 and codes[7] in names and set(names) <= set(codes)
    began = time.monotonic()
    found = langid.identify(df, (names, table), uri("l"), declared=F.col("lang"), host=F.concat(F.lit("h."), F.col("doc_id") % 50))
    got = {r.doc_id: r["__lang"] for r in found.collect()}
    assert len(got) == len(rows) and time.monotonic() - began < 60
    right = sum(got[i] == code for i, code in enumerate(codes) if code in names)
    assert right >= 0.9 * len(names)
