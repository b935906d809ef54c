import calendar
import datetime as dt
import hashlib
import os
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from lodestrata.llm import time_partitions as P
from lodestrata.llm.queries import QUERIES

CUT = dt.datetime(2024, 3, 1)


def moment(ts, key):
    if ts is None or key is None:
        return ts
    k = zlib.crc32(str(key).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    return dt.datetime.combine(ts.date() - dt.timedelta(days=ts.weekday()), dt.time()) if k > 111 else ts


def children(node):
    if len(node) == 1:
        return [(*node, m) for m in range(1, 13)]
    if len(node) == 2:
        return [(*node, d) for d in range(1, calendar.monthrange(*node)[1] + 1)]
    return [(*node, h) for h in range(24)]


def layout(rows, most):
    """{leaf: rows in order}, by recursion over lists."""
    of = defaultdict(list)
    leaves = {}
    for r in rows:
        m = moment(r["ts"], r["click_id"])
        if m is None:
            leaves.setdefault("null", []).append((m, r))
        for depth in range(1, 5) if m else ():
            of[(m.year, m.month, m.day, m.hour)[:depth]].append((m, r))

    def name(nodes):
        text = [f"{n:02d}" if i else f"{n:04d}" for i, n in enumerate(nodes[0])]
        return "/".join([*text[:-1], f"{text[-1]}-{nodes[-1][-1]:02d}"])

    def place(siblings):
        run = None
        for node in [*siblings, None]:
            n = len(of.get(node, ()))
            if node and n <= most and run and sum(len(of.get(x, ())) for x in run) + n <= most:
                run.append(node)
                continue
            if run and (found := [r for x in run for r in of.get(x, ())]):
                leaves[name(run)] = found
            run = [node] if node and n <= most else None
            if node and n > most:
                if len(node) == 4:
                    leaves[name([node])] = of[node]
                else:
                    place(children(node))

    years = [y for y, *more in of if not more]
    if years:
        place([(y,) for y in range(min(years), max(years) + 1)])
    first = lambda v: (v is not None, v)
    order = lambda x: (first(x[0]), first(x[1]["arrived_at"]), first(x[1]["click_id"]), *(first(v) for v in x[1].values()))
    return {k: [r for _, r in sorted(v, key=lambda x: tuple((b, a) if b else (b, 0) for b, a in order(x)))] for k, v in leaves.items()}


def files(rows, most):
    return {(leaf, i // most + 1): own[i : i + most] for leaf, own in layout(rows, most).items() for i in range(0, len(own), most)}


def brute_force(rows, parts=650):
    most = 1 + len(rows) // parts
    early = [r for r in rows if r["arrived_at"] is not None and r["arrived_at"] < CUT]
    start, final = files(early, most), files(rows, most)
    out = {}
    for k, own in final.items():
        ids = ",".join("null" if r["click_id"] is None else str(r["click_id"]) for r in own)
        stays = start.get(k) == own
        new = sum(r["arrived_at"] is None or r["arrived_at"] >= CUT for r in own)
        out[k] = (",".join(rows[0]), hashlib.sha256(ids.encode()).hexdigest(), len(own), new, not stays, own)
    return out


def check(got, rows, parts=650):
    want = brute_force(rows, parts)
    assert {(r["leaf"], r["part"]): (r["columns"], r["ids_sha256"], r["n_rows"], r["n_new"], r["rewritten"]) for r in got} == {k: v[:5] for k, v in want.items()}
    folder = None
    for r in got:
        path = r["path"].removeprefix("file://")
        folder = os.path.dirname(path)
        assert pq.read_table(path).to_pylist() == want[r["leaf"], r["part"]][5]
    if folder:
        assert sorted(f for f in os.listdir(folder) if not f.endswith(".crc")) == sorted(r["path"].rpartition("/")[2] for r in got)
    return want


def test_query_matches_brute_force(spark, sf):
    got = [r.asDict() for r in QUERIES["op12_time_partitions"](spark, sf).collect()]
    want = check(got, pq.read_table(f"{sf}/clicks.parquet").to_pylist())
    kinds = {len(k[0].split("/")) for k in want}
    assert kinds == {1, 2, 3, 4} and ("null", 1) in want
    assert {v[4] for v in want.values()} == {True, False}


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, part int, hour int, n double"


@pytest.mark.parametrize("parts", [3, 10**6])
def test_odd_and_hot_rows(spark, uri, parts):
    day = dt.datetime(2024, 2, 5)
    rows = [(i % 40 or None, None if i % 7 == 0 else day + dt.timedelta(hours=i % 50, days=i % 3 * 9), None if i % 11 == 0 else day + dt.timedelta(days=i), "x", i % 2, None, float(i)) for i in range(90)]
    rows += [(7, day, day, None, None, None, None)] * 30 + [(None,) * 7] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.asDict() for r in P.rewrite_clicks(spark, df, uri("clicks"), uri("work"), parts).collect()]
    names = df.columns
    check(got, [dict(zip(names, r, strict=True)) for r in rows], parts)


def test_empty_table_and_clashing_names(spark, uri):
    none = spark.createDataFrame([], SCHEMA)
    assert P.rewrite_clicks(spark, none, uri("c"), uri("w")).collect() == []
    with pytest.raises(ValueError, match="__"):
        P.rewrite_clicks(spark, none.withColumn("__new", P.F.lit(1)), uri("c"), uri("w"))


def test_next_fit_ends_runs_at_overfull_siblings():
    assert P.next_fit([(1, 2), (2, 0), (3, 9), (4, 0), (5, 3), (6, 1)], 3) == [[1, 2], [4, 5], [6]]
    assert P.leaf_name(2005 * P.YEAR, 2007 * P.YEAR) == "2005-2007"
    assert P.leaf_name(2024030508, 2024030508) == "2024/03/05/07-07"


def test_counts_of_overfull_nodes_only():
    asked = []

    def counts(unit, nodes):
        asked.append((unit, nodes))
        return {P.YEAR: {2024 * P.YEAR: 5, 2020 * P.YEAR: 1}, P.MONTH: {2024 * P.YEAR + 2 * P.MONTH: 5}, P.DAY: {2024 * P.YEAR + 2 * P.MONTH + 1 * P.DAY: 2, 2024 * P.YEAR + 2 * P.MONTH + 3 * P.DAY: 3}}[unit]

    leaves, split = P.plan_leaves(counts, 3)
    assert [n for _, n in asked] == [None, [2024 * P.YEAR], [2024 * P.YEAR + 2 * P.MONTH]]
    assert sorted(leaves.values()) == ["2020-2023", "2024/02/01-02", "2024/02/03-29"] and len(split) == 2
