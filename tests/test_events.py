import random

from pyspark.sql import functions as F

from lodestrata.operators import events as E

SCHEMA = "session_id string, run_id string, ts timestamp, ord long, kind string, content string"


def made(n=400):
    import datetime as dt

    rnd = random.Random(4)
    return [(f"s{rnd.randrange(3)}", f"r{rnd.randrange(3)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i // 2), i, rnd.choice([E.START, E.END, E.END, E.TOKEN, E.TOKEN, "other"]), rnd.choice(["a", "", None, f"t{i} "])) for i in range(n)]


def brute_force(rows):
    shown, open_ = [], {}
    for s, r, _, o, kind, content in sorted(rows, key=lambda x: (x[2], x[3])):
        runs = open_.setdefault(s, set())
        if kind == E.START:
            runs.add(r)
        elif kind == E.END:
            runs.discard(r)
        elif kind == E.TOKEN and content and not runs:
            shown.append((s, o, content))
    return sorted(shown)


def test_gates_match_brute_force_with_and_without_slices(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    for by in (None, F.expr("ord div 7")):
        got = E.gated(df, order=["ts", "ord"], slice_by=by).filter("shown")
        assert sorted((r.session_id, r.ord, r.content) for r in got.collect()) == brute_force(rows)


def test_sessions_without_tokens_and_odd_events(spark):
    df = spark.createDataFrame([("a", "r", None, 1, E.START, "in"), ("a", "r", None, 2, E.TOKEN, "x"), (None, None, None, 1, E.TOKEN, "y"), ("c", "r", None, 1, None, "z"), ("a", "r", None, 3, E.END, "o" * 700)], SCHEMA)
    got = {r.session_id: r for r in E.answers(E.gated(df)).collect()}
    assert got["a"].n_shown == 0 and got["a"].answer.startswith("No answer") and got["a"].n_tools == 1
    assert got[None].answer == "y" and got["c"].n_shown == 0
    step = E.tool_steps(df).collect()
    assert [(r.input, r.output) for r in step] == [("in", "o" * 600 + "…")]
    assert E.gated(df.limit(0)).collect() == []


def test_the_stream_shows_the_same_tokens(spark, tmp_path):
    rows = made(200)
    last = max(r[2] for r in rows)
    import datetime as dt

    rnd = random.Random(1)
    parts = [rows[i : i + 50] for i in range(0, 200, 50)]
    folder, out = tmp_path / "in", tmp_path / "out"
    for part in [*parts, [("end", "r", last + dt.timedelta(days=1), 0, "other", "")], [("end", "r", last + dt.timedelta(days=2), 0, "other", "")]]:
        rnd.shuffle(part)  # within the delay
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = E.gated_stream(spark.readStream.schema(SCHEMA).parquet(str(folder)), "10 minutes")
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(out))
    assert sorted((r.session_id, r.ord, r.content) for r in got.collect()) == brute_force(rows)
