"""The registered query of pages, with all four kinds of evidence, against plain Python."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import langid, queries


def test_page_language_id_against_brute_force(spark, sf):
    got = {r.page_id: r for r in queries.page_language_id(spark, sf).collect()}
    names, table = langid.labelled_sample(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = langid.page_evidence(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "body", "declared", F.lower("host").alias("host"), F.lower("suffix").alias("suffix")).collect()
    assert len(rows) == len(got) and len({r.suffix for r in rows}) > 1
    k = len(names) + 1
    p = np.round(langid.text_posteriors([r.body or "" for r in rows], table), 9)
    prior = (p.sum(0) + 1 / k) / (p.sum() + 1)
    sums = {f: collections.defaultdict(lambda: np.zeros(k)) for f in ("declared", "suffix", "host", *range(1, langid.LEVELS + 1))}
    counts = collections.Counter()

    def levels(host):
        parts = [host] if host.replace(".", "").isdigit() else host.split(".")
        return parts, [".".join(parts[-j:]) for j in range(1, min(langid.LEVELS, len(parts)) + 1)]

    for i, r in enumerate(rows):
        for f in ("declared", "suffix", "host"):
            if r[f] is not None:
                sums[f][r[f]] += p[i]
                counts[f, r[f]] += 1
        for j, name in enumerate(levels(r.host)[1] if r.host else [], 1):
            sums[j][name] += p[i]
            counts[j, name] += 1
    flat = np.log([(1 - langid.JUNK_PRIOR) / (k - 1)] * (k - 1) + [langid.JUNK_PRIOR])
    for i, r in enumerate(rows):
        place = prior
        if r.host:
            parts, names_up = levels(r.host)
            for j, name in enumerate(names_up, 1):
                if len(parts) > j:  # the levels above the host itself
                    place = (sums[j][name] + langid.PARENT * place) / (counts[j, name] + langid.PARENT)
            place = (sums["host"][r.host] + langid.PARENT * place) / (counts["host", r.host] + langid.PARENT)
        joint = np.log(np.maximum(p[i], 1e-12)) - flat + np.log(place)
        for f in ("declared", "suffix"):
            if r[f] is not None:
                joint += np.log((sums[f][r[f]] + langid.DECLARED) / (sum(sums[f].values()) + langid.DECLARED * len(sums[f])))
        best = joint.max()
        share = 1 / sum(math.exp(x - best) for x in joint)
        language = [*names, "und"][int(joint.argmax())]
        assert got[r.page_id].lang == language and abs(got[r.page_id].posterior - share) < 1e-5
        assert got[r.page_id].kept == (language != "und" and round(share, 6) >= langid.ACCEPT and (p[i].argmax() < k - 1 or p[i][-1] < 1))
