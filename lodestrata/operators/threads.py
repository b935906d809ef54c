"""Conversations with memory: an append-only log of messages by thread and epoch, and the loop of an agent and its tools over many threads at once."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshots import Snapshots, State

CALLS = T.ArrayType(T.StructType().add("tool", "string").add("input", "string"))
MESSAGE = T.StructType().add("thread_id", "string").add("epoch", "integer").add("seq", "long").add("role", "string").add("content", "string").add("calls", CALLS).add("tool", "string")
#: steps of the agent and of its tools, together, after which an unfinished thread is left as it is
STEPS = 25

#: (thread_id, epoch, content, outputs, n_messages) of threads that wait -> the same thread_id and epoch with content and calls; no calls: the answer
Decide = Callable[[DataFrame], DataFrame]
#: an input -> what the tool gives for it
Tool = Callable[[Column], Column]


class Threads:
    """Messages (MESSAGE) in a snapshot table. The last epoch of a thread is its memory; earlier ones stay in the log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.snapshots = spark, Snapshots(spark, path)

    def log(self, state: State | None = None) -> DataFrame:
        found = self.snapshots.read("messages", state)
        return found if found is not None else self.spark.createDataFrame([], MESSAGE)

    @staticmethod
    def _last(log: DataFrame) -> DataFrame:
        """(thread_id, last): each thread's last message. Combined before the shuffle, so that a long thread is no burden to one task."""
        return log.groupBy("thread_id").agg(F.max_by(F.struct(*MESSAGE.fieldNames()[1:]), F.struct("epoch", "seq")).alias("last"))

    def memory(self, state: State | None = None) -> DataFrame:
        """The messages of each thread's last epoch."""
        log = self.log(state)
        return log.join(log.groupBy("thread_id").agg(F.max("epoch").alias("epoch")), ["thread_id", "epoch"])

    @staticmethod
    def _messages(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select(*[given.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MESSAGE.fields])

    def _append(self, build: Callable[[DataFrame], DataFrame], writer: str = "", batch: int | None = None) -> State:
        return self.snapshots.commit(lambda base: {"messages": ("append", build(self.log(base)), [])}, writer, batch, lambda _, written: {"added": written["messages"].count()})

    def post(self, messages: DataFrame, writer: str = "", batch: int | None = None) -> State:
        """Add messages (thread_id, content[, role][, ord]) to the threads' memories, after what is there. Without ord there is one a thread."""

        def build(log: DataFrame) -> DataFrame:
            new = messages if "role" in messages.columns else messages.withColumn("role", F.lit("user"))
            new = new if "ord" in new.columns else new.withColumn("ord", F.lit(0))
            known = new.join(self._last(log), "thread_id", "left")
            return self._messages(known, epoch=F.coalesce("last.epoch", F.lit(0)), seq=F.coalesce(F.col("last.seq") + 1, F.lit(0)) + F.col("ord"))

        return self._append(build, writer, batch)

    def reset(self, threads: DataFrame, version: str | None = None) -> State:
        """Begin a new memory for these threads (thread_id): a system message opens the epoch. With a version, only for those whose memory
        was not begun for it."""

        def build(log: DataFrame) -> DataFrame:
            heads = log.filter("role = 'system'").groupBy("thread_id").agg(F.max_by("content", "epoch").alias("head"), F.max("epoch").alias("head_epoch"))
            asked = threads.select("thread_id").distinct().join(self._last(log), "thread_id", "left").join(heads, "thread_id", "left")
            if version is not None:
                asked = asked.filter(~F.coalesce((F.col("head_epoch") == F.col("last.epoch")) & (F.col("head") == version), F.lit(False)))
            return self._messages(asked, epoch=F.coalesce(F.col("last.epoch") + 1, F.lit(0)), seq=F.lit(0), role=F.lit("system"), content=F.lit(version or ""))

        return self._append(build)

    def _waiting(self, log: DataFrame) -> DataFrame:
        """Threads whose last message asks for a step: a user's or a tool's for the agent, an agent's with calls for the tools."""
        last = self._last(log).select("thread_id", "last.*")
        sizes = log.groupBy("thread_id", "epoch").agg(F.count("*").alias("n_messages"))
        asks = F.col("role").isin("user", "tool") | ((F.col("role") == "assistant") & (F.coalesce(F.size("calls"), F.lit(0)) > 0))
        open_ = last.filter(asks).join(sizes, ["thread_id", "epoch"])
        # a tool step ends with one message of each call: those after the agent's last message
        made = log.filter("role = 'tool'").join(log.filter("role = 'assistant'").groupBy("thread_id", "epoch").agg(F.max("seq").alias("asked")), ["thread_id", "epoch"]).filter("seq > asked")
        outputs = made.groupBy("thread_id", "epoch").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]).alias("outputs"))
        return open_.join(outputs, ["thread_id", "epoch"], "left").withColumn("outputs", F.coalesce("outputs", F.array().cast("array<string>")))

    def run(self, decide: Decide, tools: dict[str, Tool], steps: int = STEPS) -> int:
        """Let the agent and its tools take turns in all threads that wait, until none does or `steps` steps are done; the number of steps.

        Each step is one commit, and a step works on the threads that the one before moved only. A run that stops is taken up where
        its last commit left it; a run with nothing waiting adds nothing. A call of an unknown tool is answered by a message that says so.
        """
        with contextlib.ExitStack() as held:
            now = held.enter_context(self.snapshots.staged(self._waiting(self.log())))
            for done in range(steps):
                if now.isEmpty():
                    return done
                both = self._agent_step(now.filter("role <> 'assistant'"), decide).unionByName(self._tool_step(now.filter("role = 'assistant'"), tools))
                folders = self._append(lambda log, both=both: both).tables["messages"]
                new = self.snapshots.read("messages", State(tables={"messages": folders | {"folders": folders["folders"][-1:]}}))
                now = held.enter_context(self.snapshots.staged(self._moved(new, now)))
        return steps

    def _agent_step(self, rows: DataFrame, decide: Decide) -> DataFrame:
        told = decide(rows.select("thread_id", "epoch", "content", "outputs", "n_messages")).select("thread_id", "epoch", F.col("content").alias("told"), "calls")
        return self._messages(rows.drop("calls").join(told, ["thread_id", "epoch"]), seq=F.col("seq") + 1, role=F.lit("assistant"), content=F.col("told"), tool=F.lit(None))

    def _tool_step(self, rows: DataFrame, tools: dict[str, Tool]) -> DataFrame:
        calls = rows.select("thread_id", "epoch", "seq", F.posexplode("calls").alias("i", "call"))
        output = F.concat(F.lit("There is no tool named "), F.coalesce("call.tool", F.lit("null")))
        for name, tool in tools.items():
            output = F.when(F.col("call.tool") == name, tool(F.col("call.input"))).otherwise(output)
        return self._messages(calls, seq=F.col("seq") + 1 + F.col("i"), role=F.lit("tool"), content=output, calls=F.lit(None), tool=F.col("call.tool"))

    @staticmethod
    def _moved(new: DataFrame, before: DataFrame) -> DataFrame:
        """The threads that wait after a step, from its messages alone."""
        by = ["thread_id", "epoch"]
        last = new.groupBy(*by).agg(F.max_by(F.struct(*MESSAGE.fieldNames()[2:]), "seq").alias("last"), F.count("*").alias("added"), F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "tool", F.struct("seq", "content")))), lambda x: x["content"]).alias("outputs"))
        rows = last.join(before.select(*by, "n_messages"), by).select(*by, "last.*", (F.col("n_messages") + F.col("added")).alias("n_messages"), "outputs")
        return rows.filter((F.col("role") == "tool") | (F.coalesce(F.size("calls"), F.lit(0)) > 0))

    def unfinished(self) -> DataFrame:
        """(thread_id, epoch, role): threads that still wait, for one that ran out of steps."""
        return self._waiting(self.log()).select("thread_id", "epoch", "role")
