"""The usual notices as they stand in files: wrapped, below titles and copyright lines, in comments."""

import re
import textwrap

import duckdb

import pytest

from lodestrata.llm import licences

S = licences.SENTENCES
HOLDER = "Copyright (c) 2020 Some Body"
URL = "http://www.apache.org/licenses/LICENSE-2.0"


def wrap(*sentences):
    return textwrap.fill(" ".join(sentences), 72)


APACHE = [
    wrap(S["apache-header-1"] + "; " + S["apache-header-2"] + ".", S["apache-header-3"]),
    "    " + URL,
    wrap(S["apache-header-4"] + ".", S["apache-header-5"] + "."),
]
MIT = [wrap(S["mit-grant"] + ":"), wrap(S["mit-notice"] + "."), wrap(S["mit-warranty"] + ". IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.")]
BSD = [wrap(S["bsd-grant"] + ":"), wrap("1. " + S["bsd-source"] + "."), wrap("2. " + S["bsd-binary"] + "."), wrap("3. " + S["bsd-endorse"] + ".")]
GPL3 = [wrap(S["gpl-free"] + "."), wrap(S["gpl-hope"] + ".", S["gpl-details"] + "."), "You should have received a copy of the license\nalong with this program.  If not, see <https://www.gnu.org/licenses/>."]
MPL = [wrap(S["mpl-subject"] + ".", S["mpl-copy"] + ".")]
NOTICES = {"apache-header": APACHE, "mit-text": MIT, "bsd-3": BSD, "gpl3-header": GPL3, "mpl2": MPL}


def text(parts, style):
    joined = "\n\n".join(parts)
    if style == "plain":
        return joined
    if style == "holder":
        return f"{HOLDER}\n\n{joined}\n\nimport os"
    if style == "titled":
        return f"Some Licence\n\n{HOLDER}\n\n{joined}"
    if style == "close":  # no blank line below the copyright
        return f"{HOLDER}\n{joined}"
    if style == "crlf":
        return f"{HOLDER}\n\n{joined}".replace("\n", "\r\n")
    return "\n".join(f" * {x}".rstrip() for x in f"{HOLDER}\n\n{joined}".split("\n")) + "\n */\nint x;"


@pytest.mark.parametrize("style", ["plain", "holder", "titled", "close", "crlf", "comment"])
def test_usual_notices(spark, style):
    df = spark.createDataFrame([(i, text(parts, style)) for i, parts in enumerate(NOTICES.values())], "doc_id int, text string")
    got = {(r.doc_id, r.rule_id) for r in licences.scan(df).collect()}
    assert {(i, rule) for i, rule in enumerate(NOTICES)} <= got


def test_one_line_and_url_in_the_sentence(spark):
    one = " ".join(x.replace("\n", " ") for x in APACHE)
    df = spark.createDataFrame([(1, one), (2, "Terms:\nfoo\n\n" + one)], "doc_id int, text string")
    assert {(r.doc_id, r.rule_id) for r in licences.scan(df).collect()} >= {(1, "apache-header"), (2, "apache-header")}


def test_views_do_not_add_up(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY 4.0.\n\nLicensed under CC BY 4.0.\n")], "doc_id int, text string")
    assert [(r.rule_id, r.n_matches, r.first_sentence) for r in licences.scan(df).collect()] == [("cc-by", 2, 0)]


WRAPPED = [
    "All rights\nreserved.", "x\nAll\nrights reserved.\ny", wrap(S["unlicense-1"] + ".", S["unlicense-2"] + "."), "This is free and unencumbered software released into the public\ndomain.\n\nAnyone is\nfree to copy.",
    "ALL  RIGHTS -- RESERVED!", "Released under\nthe zlib\nLicense.", "SPDX-License-Identifier:\n  0BSD", "SPDX-License-Identifier: 0BSD", "This work is licensed under a Creative Commons Attribution 4.0\nInternational License.", None, "", "a b c",
    *(text(parts, style) for parts in NOTICES.values() for style in ("plain", "titled", "close", "comment")), *("\n".join(textwrap.fill(p, 60) for p in t.split("\n")) for t in licences.TEXTS.values()),
]


def test_wrapped_texts_match_sql(spark):
    rows = list(enumerate(WRAPPED))
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(licences.scan_sql())
    mine = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert mine == sorted(want.fetchall())
    assert {(0, "all-rights"), (2, "unlicense"), (4, "all-rights"), (5, "says:Zlib:0:1"), (7, "spdx:0BSD"), (8, "cc-by-long")} <= {(r[0], r[1]) for r in mine}


@pytest.mark.parametrize("licence", sorted(licences.TEXTS))
def test_whole_texts_are_found(spark, licence):
    wrapped = "\n\n".join(textwrap.fill(p, 70) for p in licences.TEXTS[licence].split("\n"))
    df = spark.createDataFrame([(1, f"The Licence\n\n{HOLDER}\n\n{wrapped}\n")], "doc_id int, text string")
    assert f"text:{licence}" in {r.rule_id for r in licences.scan(df).collect()}


def test_rules_are_an_input(spark):
    rules = ({"a": "Alpha beta", "b": "Gamma: delta"}, [("r", "Own-1.0", ["a", "b"])])
    df = spark.createDataFrame([(1, "alpha\nbeta. Other. Gamma: delta."), (2, "gamma: delta. alpha beta")], "doc_id int, text string")
    assert [tuple(r) for r in licences.scan(df, rules=rules).select("doc_id", "rule_id", "licence").collect()] == [(1, "r", "Own-1.0")]


def test_every_rule_holds_an_anchor():
    known, rules = licences.dictionary()
    words = licences.anchors(known, rules)
    texts = {i: s for s, i in known.items()}
    assert all(re.fullmatch("[a-z0-9]+", w) for w in words)
    assert all(any(w in texts[i] for w in words for i in ids) for _, _, ids in rules)
