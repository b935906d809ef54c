"""The event log of an agent's run: which of a model's tokens are shown while tools are open, and what the tools did."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: kinds of events
START, END, TOKEN = "tool_start", "tool_end", "token"
#: characters of a tool's output that are shown, and events of a session that one task numbers
SHOWN, SLICE = 600, 100_000


def open_tools(events: DataFrame, session: str = "session_id", run: str = "run_id", order: list[str] | None = None, slice_by: Column | None = None) -> DataFrame:
    """events with `open`, the number of tool runs that are open at each of them in order (the event itself counts).

    A start of a run that is open, and an end of one that is not, change nothing. slice_by: a number that rises with the order (a time's hour,
    an event's number over SLICE); sessions are then counted slice by slice, each beginning with the sum of those before, so that
    a session of any length is the work of many tasks.
    """
    order = order or ["ord"]
    tool = F.col("kind").isin(START, END)
    before = F.lag("kind").over(Window.partitionBy(session, run).orderBy(*order))
    marks = events.filter(tool).withColumn("__was", before)
    change = F.when((F.col("kind") == START) & ~F.col("__was").eqNullSafe(START), 1).when((F.col("kind") == END) & F.col("__was").eqNullSafe(START), -1).otherwise(0)
    rows = marks.withColumn("__change", change).drop("__was").unionByName(events.filter(~F.coalesce(tool, F.lit(False))).withColumn("__change", F.lit(0)))
    rows = rows.withColumn("__slice", slice_by if slice_by is not None else F.lit(0))
    sums = rows.groupBy(session, "__slice").agg(F.sum("__change").alias("__sum"))
    whole = F.sum("__sum").over(Window.partitionBy(session).orderBy("__slice")) - F.col("__sum")
    starts = sums.select(F.col(session).alias("__s"), F.col("__slice").alias("__k"), whole.alias("__before"))
    within = F.sum("__change").over(Window.partitionBy(session, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("__within", within).join(starts, F.col(session).eqNullSafe(F.col("__s")) & F.col("__slice").eqNullSafe(F.col("__k")))
    return joined.withColumn("open", (F.col("__before") + F.col("__within")).cast("int")).drop("__change", "__slice", "__within", "__before", "__s", "__k")


def gated(events: DataFrame, session: str = "session_id", run: str = "run_id", order: list[str] | None = None, slice_by: Column | None = None) -> DataFrame:
    """open_tools() with `shown`: whether a token that is not empty is shown, which it is while no tool is open."""
    rows = open_tools(events, session, run, order, slice_by)
    return rows.withColumn("shown", (F.col("kind") == TOKEN) & (F.coalesce(F.length("content"), F.lit(0)) > 0) & (F.col("open") == 0))


def answers(rows: DataFrame, session: str = "session_id", order: list[str] | None = None, none: str = "No answer was made; please try again.") -> DataFrame:
    """(session, answer, n_shown, n_tools) of gated() events: the shown tokens in order. An answer is of bounded size, as a model's is."""
    order = order or ["ord"]
    tokens = F.transform(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct(*order, "content")))), lambda x: x["content"])
    found = rows.groupBy(session).agg(F.array_join(tokens, "").alias("answer"), F.count_if("shown").alias("n_shown"), F.count_if(F.col("kind") == START).alias("n_tools"))
    return found.withColumn("answer", F.when(F.col("n_shown") == 0, none).otherwise(F.col("answer")))


def tool_steps(events: DataFrame, session: str = "session_id", run: str = "run_id", order: list[str] | None = None) -> DataFrame:
    """(session, run, input, output): each run's first start, and the end that follows it, cut to what is shown; null while it is open."""
    order = order or ["ord"]
    w = Window.partitionBy(session, run).orderBy(*order)
    marks = events.filter(F.col("kind").isin(START, END)).withColumn("__next", F.lead(F.struct("kind", "content")).over(w)).withColumn("__n", F.row_number().over(w))
    first = marks.filter(F.col("kind") == START).withColumn("__at", F.min("__n").over(Window.partitionBy(session, run))).filter("__n = __at")
    return first.select(session, run, F.col("content").alias("input"), F.when(F.col("__next.kind") == END, X.preview(F.col("__next.content"), SHOWN)).alias("output"))


def gated_stream(events: DataFrame, delay: str = "10 minutes", session: str = "session_id", run: str = "run_id", ts: str = "ts") -> DataFrame:
    """The tokens that gated() shows, of a stream of events (session, run, ts, ord, kind, content): (session, ts, ord, content).

    Events wait in the session's state until the watermark has passed them and are then taken in the order of (ts, ord), so the order of arrival
    does not matter; those that come after the watermark are left out. State: a session's open runs and the events of the last `delay`.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, waiting = (set(state.get[0]), list(zip(*state.get[1:], strict=True))) if state.exists else (set(), [])
        passed = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for f in frames:
                for t, o, k, r, c in f.itertuples(index=False):
                    if t // 1000 >= passed:
                        waiting.append((int(t), int(o), k, r, c))
        due = sorted((e for e in waiting if e[0] // 1000 < passed), key=lambda e: e[:2])
        waiting = [e for e in waiting if e[0] // 1000 >= passed]
        shown = []
        for t, o, kind, r, content in due:
            if kind == START:
                open_.add(r)
            elif kind == END:
                open_.discard(r)
            elif kind == TOKEN and content and not open_:
                shown.append((*key, t, o, content))
        if waiting or open_:
            state.update((sorted(open_), *map(list, zip(*waiting, strict=True))) if waiting else (sorted(open_), [], [], [], [], []))
            if waiting:
                state.setTimeoutTimestamp(max(passed + 1, min(e[0] for e in waiting) // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(shown, columns=["session_id", "us", "ord", "content"])

    told = events.withWatermark(ts, delay).select(F.col(session).cast("string").alias("session_id"), ts, F.unix_micros(ts).alias("us"), F.col("ord").cast("long").alias("ord"), "kind", F.coalesce(F.col(run).cast("string"), F.lit("")).alias("run"), F.coalesce("content", F.lit("")).alias("content"))
    keyed = told.select("session_id", "us", "ord", "kind", "run", "content", ts).groupBy("session_id")

    def by_session(key, frames, state):
        return step(key, (f[["us", "ord", "kind", "run", "content"]] for f in frames), state)

    kept = "open array<string>, us array<long>, ord array<long>, kind array<string>, run array<string>, content array<string>"
    out = keyed.applyInPandasWithState(by_session, "session_id string, us long, ord long, content string", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("session_id", F.timestamp_micros("us").alias("ts"), "ord", "content")
