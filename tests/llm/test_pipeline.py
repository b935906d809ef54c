"""The whole pipeline against brute force, on documents whose ids repeat or are null."""

import collections

import pytest

from lodestrata.llm import bagminhash, pii, queries, token_store

from .test_dedup import bag, similarity


def brute_exact_kept(rows):
    own = collections.defaultdict(list)
    for k, t in rows:
        own[t].append(k)
    return [(k, t) for k, t in rows if k == max((x for x in own[t] if x is not None), default=None)]


def brute_near_kept(rows):
    bags = [bag(t) for _, t in rows]

    def least(i):
        own, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in set(range(len(rows))) - own:
                if similarity(bags[a], bags[b]) >= 0.8:
                    own.add(b)
                    todo.append(b)
        return min((rows[j][0] for j in own if rows[j][0] is not None), default=None)

    return [r for i, r in enumerate(rows) if r[0] == least(i)]


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows (id, text): English texts of different lengths with near and exact copies, ids that repeat and null ids."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en' AND n_chars BETWEEN 300 AND 3000").orderBy("doc_id").limit(200)
    by_length = {}
    for r in docs.collect():
        by_length.setdefault(len(r.text.split()), r.text)
    texts = []
    for t in by_length.values():
        if all(similarity(bag(t), bag(x)) < 0.5 for x in texts):
            texts.append(t)
    assert len(texts) >= 16
    rows = [(i, t) for i, t in enumerate(texts[:10])]
    rows += [(20, texts[10]), (20, texts[3] + " and more"), (20, texts[10])]  # one id on a text of its own and on a near copy
    rows += [(None, texts[11]), (None, texts[4] + " and more"), (None, texts[5]), (None, texts[12]), (None, texts[12] + " once")]
    rows += [(2, texts[13]), (2, texts[1] + " again"), (1, texts[13] + " again"), (30, texts[6]), (None, "%%% 12 // ---"), (31, "")]
    return rows


def test_near_keeps_other_texts_of_an_id(spark, uri, repeated):
    rows = [r for r in repeated if bag(r[1])]
    got = bagminhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), uri("k")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(brute_near_kept(rows))


def test_run_against_brute_force(spark, tmp_path, repeated):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, t, "en", "h", len(t)) for k, t in repeated], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set(queries.SECRET, "a test's secret")
    got = collections.defaultdict(int)
    for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        got[r.doc_id, r.bin_id, r.bin_offset] += r.n_tokens
    rows = [(k, t) for k, t in repeated if any(c.isalpha() for c in t)]  # the others have no language
    rows = brute_near_kept(brute_exact_kept(rows))
    spark.conf.unset(queries.SECRET)
    key, bpe = pii.derive_key("a test's secret"), token_store.byte_bpe(queries.vocabulary())
    want = collections.Counter((k, len(bpe.encode([pii.pseudonymise(t, key)[0]])[0]) + 1) for k, t in rows)
    assert collections.Counter((k, n) for (k, _, _), n in got.items()) == want


def test_secrets_are_not_in_the_source(spark):
    assert queries.secret(spark) != queries.secret(spark)
    spark.conf.set(queries.SECRET, "own")
    assert queries.secret(spark) == "own"
    spark.conf.unset(queries.SECRET)


def test_each_stage_on_odd_documents(spark, odd_docs, no_docs, sf):
    """Nulls, empty texts, repeated rows and clashing columns: the columns stay; an empty table stays empty."""
    import corpus_pipeline

    at = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == odd_docs.columns, name
        assert stage(spark, no_docs, sf).count() == 0, name
    assert {r.doc_id for r in corpus_pipeline.pack(spark, at, sf).collect()} == {r.doc_id for r in at.collect()}
