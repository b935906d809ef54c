"""Exact dedup by a minimal perfect hash over historical distinct digests (operator 7).

The distinct SHA-256 digests of the history are dealt by their first bits to shards of bounded size. Each shard's
minimal perfect hash is a cascade of bit arrays: a level keeps the digests that are alone at their bit, the others go
on to the next; a digest's slot is the rank of its bit. Slots hold the full digest, the winner's locator (its id) and
the number of copies. A shard is one file in the shared folder.

Distinct digests of the incoming rows (combined map-side, so that a group with a third of all rows is a few rows) are
looked up in their shard; a slot counts only if all 32 bytes agree. Members update their slot; nonmembers group among
themselves. Rows then get their group by an equi-join on the digest, which Spark may split where it is skewed.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHARD = 50_000
SLOT = np.dtype([("digest", "V32"), ("winner", "<i8"), ("n", "<i8")])
NONE = -(2**63)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each digest (four 64-bit words) in a level of `size` bits."""
    x = np.full(len(words), level * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k in range(4):
        x = (x ^ words[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
    return x % np.uint64(size)


def build(digests: np.ndarray) -> list[np.ndarray]:
    """Levels (boolean arrays) for distinct digests of dtype V32."""
    words = np.frombuffer(digests.tobytes(), "<u8").reshape(-1, 4)
    levels = []
    while len(words):
        size = max(64, int(len(words) * 1.6))
        at = _place(words, len(levels), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        words = words[~alone[at]]
        if len(levels) > 500:
            raise ValueError("digests are not distinct")
    return levels


def slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """Slot of each digest; of a digest that is not in the set, some slot or -1."""
    words = np.frombuffer(digests.tobytes(), "<u8").reshape(-1, 4)
    found = np.full(len(words), -1, np.int64)
    rest, before = np.arange(len(words)), 0
    for k, level in enumerate(levels):
        if not len(rest):
            break
        at = _place(words[rest], k, len(level)).astype(np.int64)
        hit = level[at]
        rank = np.cumsum(level)
        found[rest[hit]] = before + rank[at[hit]] - 1
        before += int(rank[-1])
        rest = rest[~hit]
    return found


def dump(levels: list[np.ndarray], table: np.ndarray) -> bytes:
    parts = [struct.pack("<4sII", b"MPHD", len(levels), len(table))]
    for level in levels:
        parts.append(struct.pack("<I", len(level)) + np.packbits(level).tobytes())
    return b"".join([*parts, table.tobytes()])


def load(raw: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    magic, n_levels, n = struct.unpack_from("<4sII", raw)
    if magic != b"MPHD":
        raise ValueError("not an index of digests")
    at, levels = 12, []
    for _ in range(n_levels):
        (size,) = struct.unpack_from("<I", raw, at)
        k = (size + 7) // 8
        levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, k, at + 4), count=size).astype(bool))
        at += 4 + k
    return levels, np.frombuffer(raw, SLOT, n, at)


def digest(text: str | Column) -> Column:
    """SHA-256 of the whole text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256))


def _shard(n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(n)).cast("int")


def _array(batch, names=("digest", "winner", "n")) -> np.ndarray:
    import pyarrow as pa

    t = np.empty(batch.num_rows, SLOT)
    t["digest"] = np.frombuffer(b"".join(batch.column(names[0]).cast(pa.binary()).to_pylist()), "V32")
    for c in names[1:]:
        t[c] = batch.column(c).to_numpy()
    return t


def group_digests(history: DataFrame, incoming: DataFrame, uri: str) -> DataFrame:
    """Groups (digest, winner, n, member) of the rows (digest binary, id long) of both.

    winner: the largest id of the group, null if all are null. member: whether the digest was in the history.
    Either side may be empty.
    """
    merged = [F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")]
    sides = [common.stash(side.groupBy("digest").agg(*merged).withColumn("winner", F.coalesce("winner", F.lit(NONE))), f"{uri}/{name}") for name, side in (("history", history), ("incoming", incoming))]
    n = max(1, -(-max(side.count() for side in sides) // SHARD))
    spark = history.sparkSession
    old, new = (side.withColumn("shard", _shard(n)) for side in sides)

    def index(key, t):
        import pyarrow as pa

        shard, rows = key[0].as_py(), _array(t)
        levels = build(rows["digest"])
        table = np.empty_like(rows)
        table[slots(levels, rows["digest"])] = rows
        common.publish(f"{uri}/index/{shard:08d}.mphd", lambda out: out.write(dump(levels, table)))
        return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([len(table)], pa.int64())})

    old.groupBy("shard").applyInArrow(index, "shard int, slots long").agg(F.sum("slots")).collect()

    def look_up(key, t):
        import pyarrow as pa

        name = f"{uri}/index/{key[0].as_py():08d}.mphd"
        levels, table = load(common.fetch(name)) if common.exists(name) else ([], np.empty(0, SLOT))
        table = table.copy()
        rows = _array(t)
        rows = rows[rows["n"] > 0]
        at = slots(levels, rows["digest"])
        member = at >= 0
        if member.any():
            member[member] = table["digest"][at[member]] == rows["digest"][member]
        hit = at[member]
        table["winner"][hit] = np.maximum(table["winner"][hit], rows["winner"][member])
        table["n"][hit] += rows["n"][member]
        rest = rows[~member]
        both = np.concatenate([table, rest])
        return pa.table({"digest": pa.array([x.tobytes() for x in both["digest"]], pa.binary()), "winner": pa.array(both["winner"]), "n": pa.array(both["n"]), "member": pa.array(np.arange(len(both)) < len(table))})

    every = spark.range(n).select(F.unhex(F.repeat(F.lit("00"), F.lit(32))).alias("digest"), F.lit(0).cast("long").alias("winner"), F.lit(0).cast("long").alias("n"), F.col("id").cast("int").alias("shard"))
    groups = new.unionByName(every).groupBy("shard").applyInArrow(look_up, "digest binary, winner long, n long, member boolean")
    return groups.withColumn("winner", F.when(F.col("winner") != NONE, F.col("winner")))


def deduplicate(docs: DataFrame, uri: str, history: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256, in_history.

    Texts are equal when identical; null counts as empty. keep_id is the largest key of the group (null where all are
    null); kept marks rows whose key is keep_id, so that rows that repeat both the winner's key and its text, which
    nothing tells apart, are all marked. history: a condition on docs that says which rows the index holds (default:
    keys up to the middle of their range, null keys among them); the result is the same whichever it is.
    """
    rows = common.stash(docs.select(F.col(key).cast("long").alias("id"), digest(text).alias("digest"), (history if history is not None else F.lit(None).cast("boolean")).alias("old")), f"{uri}/rows")
    if history is None:
        low, high = rows.agg(F.min("id"), F.max("id")).first()
        middle = (low + high) // 2 if low is not None else 0
        rows = rows.withColumn("old", F.coalesce(F.col("id") <= middle, F.lit(True)))
    old = F.coalesce("old", F.lit(False))
    groups = common.stash(group_digests(rows.filter(old), rows.filter(~old), uri), f"{uri}/groups")
    return rows.drop("old").join(groups, "digest").select(
        F.col("id").alias(key),
        F.col("winner").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
    )


def keep_one(docs: DataFrame, uri: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns.

    Texts meet the winners by digest and key together, which a large group's texts are spread over. docs must not have
    columns that begin with two underscores.
    """
    keep = deduplicate(docs, uri, None, key, text).filter("kept").select(F.unhex("text_sha256").alias("__digest"), F.col("keep_id").alias("__keep")).distinct()
    return docs.join(keep, (digest(text) == F.col("__digest")) & F.col(key).cast("long").eqNullSafe(F.col("__keep")), "left_semi")
