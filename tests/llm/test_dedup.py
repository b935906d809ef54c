import collections
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import bagminhash, exact_dedup


# -- exact ----------------------------------------------------------------------------------------------------------


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=300))
@settings(max_examples=40, deadline=None)
def test_perfect_hash(keys):
    digests = np.frombuffer(b"".join(hashlib.sha256(k).digest() for k in keys), "V32")
    levels = exact_dedup.build(digests)
    assert sorted(exact_dedup.slots(levels, digests).tolist()) == list(range(len(keys)))
    table = np.zeros(len(keys), exact_dedup.SLOT)
    table[exact_dedup.slots(levels, digests)]["digest"] = digests
    again, back = exact_dedup.load(exact_dedup.dump(levels, table))
    assert (exact_dedup.slots(again, digests) == exact_dedup.slots(levels, digests)).all() and len(back) == len(keys)


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    out = []
    for k, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((k, keep, len(own), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("history", [None, "true", "false", "doc_id > 4"])
def test_exact(odd_docs, uri, history):
    got = exact_dedup.deduplicate(odd_docs, uri("e"), F.expr(history) if history else None).drop("in_history")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_exact_many_shards(spark, uri, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD", 20)
    rows = [(i, f"t{i % 90}" if i % 3 else "hot") for i in range(400)]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), uri("e")).drop("in_history")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact(rows)


def test_exact_empty_and_kept(no_docs, odd_docs, uri):
    assert exact_dedup.deduplicate(no_docs, uri("e")).count() == 0
    kept = exact_dedup.keep_one(odd_docs, uri("k"))
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 5, 6, 7}


# -- near -----------------------------------------------------------------------------------------------------------


def words(t):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if w]


def bag(t):
    w = words(t)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_near(rows):
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (not bags[i] and not bags[j]) or (bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[root(i)].append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        own = groups[root(i)]
        least = min((x for x in own if x is not None), default=None)
        out.append((k, least, len(own), sum(bags[i].values()), k == least))
    return sorted(out, key=str)


def near(df, uri):
    return sorted(((r.doc_id, r.class_id, r.class_size, r.n_shingles, r.kept) for r in bagminhash.classes(df, uri).collect()), key=str)


def test_near_odd_docs(odd_docs, no_docs, uri):
    assert near(odd_docs, uri("n")) == brute_near([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert near(no_docs, uri("n")) == []


def test_near_against_brute_force(spark, uri, rng):
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for c in range(4):  # copies of a text with few to many changes, and texts that share a passage
        base = rng.choice(vocabulary, 120).tolist()
        for _ in range(60):
            t = list(base)
            for _ in range(int(rng.integers(0, 9))):
                t[int(rng.integers(len(t)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(t) if c < 3 else " ".join(t[:60] + rng.choice(vocabulary, 60).tolist())))
    rows += [(1000 + i, "a b c d e " * (20 + i)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert near(df, uri("n")) == brute_near(rows)
    kept = bagminhash.keep_one(df, uri("k"))
    assert {r.doc_id for r in kept.collect()} == {k for k, least, *_ in brute_near(rows) if k == least}


def test_similarity_matches_definition(rng):
    for _ in range(40):
        a, b = (" ".join(rng.choice(list("abcd"), int(rng.integers(1, 30)))) for _ in range(2))
        assert abs(bagminhash.jaccard(a.encode(), b.encode()) - similarity(bag(a), bag(b))) < 1e-12


@pytest.mark.parametrize(("left", "right"), [(["p q r s t"] * 40 + ["a"], ["p q r s t"] * 60), (["x%d" % i for i in range(200)], ["x%d" % i for i in range(30, 230)])])
def test_signatures_are_unbiased(left, right):
    a, b = " ".join(left).encode(), " ".join(right).encode()
    sig = bagminhash.signatures(*bagminhash.bags(*bagminhash.shingles([a, b])), 2, size=8192)
    assert abs((sig[0] == sig[1]).mean() - bagminhash.jaccard(a, b)) < 0.03


def test_signature_ignores_company():
    """A text's signature does not depend on the texts that are processed with it."""
    texts = [b"a b c d e f g", b"x " * 300, b"one", b"", b" ".join(b"w%d" % i for i in range(900))]
    whole = bagminhash.signatures(*bagminhash.bags(*bagminhash.shingles(texts)), len(texts))
    for i, t in enumerate(texts):
        assert (bagminhash.signatures(*bagminhash.bags(*bagminhash.shingles([t])), 1)[0] == whole[i]).all()
