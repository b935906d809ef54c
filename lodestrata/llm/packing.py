"""Variable-capacity best-fit packing (operator 1).

Documents become pieces of at most the greatest permitted length; each group of pieces is packed by best fit in
decreasing order. A piece goes to the open bin with the least room that holds it; where none does, a bin is opened.
The permitted lengths are optimised jointly: for every greatest opening size, the group is packed once, bins are
opened at the least-cost size for their piece among the sizes up to it, and in the end each bin is cut down to the least
permitted length that holds its contents. The plan with the least total cost is taken.

Lengths are of a tokenizer's ids, the end id among them. They are found in one pass and stored; then pieces are dealt by a hash of key, copy
and piece to as many groups as leave GROUP pieces a group on average: no task grows with the input, the groups are alike and even
whatever copies or sources are common, and the bins do not depend on how files are split. sequences() gives the ids of each bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIZES = (512, 1024, 2048, 4096, 8192)
GROUP = 20_000
#: cost of a sequence of n tokens, relative: linear work and attention's quadratic work, which are equal at 16384 tokens
QUADRATIC = 16_384


def cost(size: int) -> float:
    return size * (1 + size / QUADRATIC)


def _opening(length: int, sizes: tuple[int, ...]) -> int:
    """The size at which a bin for a piece of `length` is opened: least cost per token that it can hold, for a bin that fills up
    with pieces like this one; ties to the smaller size. A piece over all sizes gets the least permitted that holds it."""
    fitting = [s for s in sizes if s >= length]
    return min(fitting, key=lambda s: (cost(s) / (s // length * length), s))


def _fill(lengths: list[int], sizes: tuple[int, ...], largest: int) -> tuple[list[int], list[int]]:
    """(bin of each piece, contents of each bin), pieces in decreasing order."""
    allowed = tuple(s for s in sizes if s <= largest)
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    at_room: dict[int, list[int]] = {}
    where, held, opened = [], [], {}
    for n in lengths:
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            stack = at_room[room]
            b = stack.pop()
            if not stack:
                del at_room[room]
                rooms.pop(k)
        else:
            if n not in opened:
                opened[n] = _opening(n, allowed) if n <= largest else next(s for s in sizes if s >= n)
            room, b = opened[n], len(held)
            held.append(0)
        where.append(b)
        held[b] += n
        room -= n
        if room:
            if room not in at_room:
                at_room[room] = []
                insort(rooms, room)
            at_room[room].append(b)
    return where, held


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int]]:
    """(bin of each piece, size of each bin) for pieces in decreasing order, none over the greatest size."""
    best = None
    for largest in sizes:
        where, held = _fill(lengths, sizes, largest)
        final = [next(s for s in sizes if s >= h) for h in held]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, where, final
    return best[1], best[2]


def words(text: str = "text") -> Column:
    """Number of words of a text: runs of characters other than white space; null has none. For corpora without a tokenizer."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def token_lengths(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, n): key and number of ids of each document's text, with an end id; 0 for null and empty texts, which have nothing to train on."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("n", T.LongType())])

    def work(batches):
        import pyarrow as pa

        from .token_store import byte_bpe

        bpe = byte_bpe(shared.value)
        for batch in batches:
            for a, b in common.text_batches(batch, 1):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                _, lengths = bpe.encode(texts)
                some = np.array([bool(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.where(some, lengths + 1, 0), pa.int64())], names=["k", "n"])

    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(work, schema)


def pack_frame(docs: DataFrame, uri: str, tokens: Column | None = None, spec: str | None = None, key: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row per piece: key, piece (from 0), first_token, n_tokens, bin_id, bin_size, bin_offset.

    Lengths are `tokens`, a column, or the numbers of ids by `spec`, a tokenizer, or else numbers of words.
    Every token of every document is in exactly one piece. Documents without tokens (null or empty texts) have one
    piece of no tokens with null bin columns. Rows with equal or null keys each have their pieces. Only key and text
    are read, so other columns cannot clash.
    """
    sizes = tuple(sorted(set(sizes)))
    top = sizes[-1]
    rows = token_lengths(docs, spec, key, text) if spec is not None else docs.select(F.col(key).alias("k"), (tokens if tokens is not None else words(text)).cast("long").alias("n"))
    rows = common.stash(rows, f"{uri}/lengths")
    # rows that repeat a key and a length are alike: counted map-side, then told apart by their number
    alike = rows.groupBy("k", "n").agg(F.count(F.lit(1)).alias("copies"))
    alike = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    pieces = alike.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest((F.col("n") - 1) / top, F.lit(0)).cast("int"))))
    start = F.col("piece").cast("long") * top
    pieces = pieces.select("k", "copy", "piece", start.alias("first_token"), F.least(F.col("n") - start, F.lit(top)).cast("long").alias("n"))
    n_pieces = rows.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    n_groups = max(1, -(-n_pieces // GROUP))
    full = pieces.filter("n > 0").withColumn("g", F.pmod(F.xxhash64("k", "copy", "piece"), F.lit(n_groups)).cast("int"))

    def work(group, t):
        import pyarrow as pa

        g = group[0].as_py()
        # ties by key, copy and piece: the same bins whatever the order in which rows arrive
        t = t.sort_by([("n", "descending"), ("k", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        n = t.column("n").to_numpy()
        where, final = pack(n.tolist(), sizes)
        where = np.array(where)
        by_bin = np.argsort(where, kind="stable")
        offset = np.empty(len(n), np.int64)
        before = np.cumsum(n[by_bin]) - n[by_bin]
        first = np.searchsorted(where[by_bin], np.arange(len(final)))
        offset[by_bin] = before - before[first][where[by_bin]]
        return pa.table({"k": t.column("k"), "piece": t.column("piece"), "first_token": t.column("first_token"), "n_tokens": t.column("n"), "bin_id": pa.array(where + (g << 32)), "bin_size": pa.array(np.array(final, np.int32)[where]), "bin_offset": pa.array(offset.astype(np.int32))})

    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("bin_id", T.LongType()), T.StructField("bin_size", T.IntegerType()), T.StructField("bin_offset", T.IntegerType())])
    packed = full.select("k", "copy", "piece", "first_token", "n", "g").groupBy("g").applyInArrow(work, schema)
    none = F.lit(None)
    empty = pieces.filter("n <= 0").select("k", "piece", "first_token", F.lit(0).cast("long").alias("n_tokens"), none.cast("long").alias("bin_id"), none.cast("int").alias("bin_size"), none.cast("int").alias("bin_offset"))
    return packed.unionByName(empty).withColumnRenamed("k", key)


def sequences(packed: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(bin_id, bin_size, ids) of packed documents whose keys are unique: the bins' ids, piece after piece. ids: (key, ids) of each document.

    A bin holds at most its size, so no group grows with the input.
    """
    pieces = packed.filter("bin_id IS NOT NULL").join(ids.select(key, F.col("ids").alias("__ids")), key)
    pieces = pieces.select("bin_id", "bin_size", F.struct("bin_offset", F.slice("__ids", (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("part")).alias("p"))
    parts = F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"])
    return pieces.groupBy("bin_id", "bin_size").agg(F.flatten(parts).alias("ids"))
