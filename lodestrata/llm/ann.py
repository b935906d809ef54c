"""Nearest neighbours by a hash-prefix forest (operator 5).

Every tree of a forest hashes each vector to a string of digits and keeps the strings in a sorted array. A digit is the one
of WIDTH random directions, with its sign, that the vector lies nearest to, so a digit that two vectors share says much
more than a bit of a random plane. A query descends in all trees to the longest prefix that it shares with a stored string;
then all trees ascend together, a digit at a time. At each depth a query meets the prefixes of its own string and those with
next-best digits, in order of how well the query fits their directions, over all trees at once, until `candidates`
distinct rows are met; these are scored exactly. For the inner product, vectors get one more coordinate that brings all to
the same length, so that the angle orders as the inner product does.

Distinct vectors are dealt by hash to shards of bounded size, and a shard's forest is one file in the shared folder; equal
vectors are one entry with its smallest ids, as many as can ever be in a result. The stated queries are dealt to blocks. A task
has a block of queries and some shards, one in memory at a time, and keeps the best of each query, so that what is shuffled is
k rows for each query and task.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: directions a digit, digits a string, trees a forest
WIDTH, DIGITS, TREES = 64, 3, 64
#: next-best digits that a query tries at each place of a prefix
TRIES = 6
SHARD = 32_000
#: queries of a task, and of those that are searched side by side
BLOCK, STEP = 1_024, 128


def enough_rows(n: int, k: int = 20) -> int:
    """Distinct rows that a query scores of a shard's n: a share that falls as n grows, half of 500, a tenth of 32,000."""
    return max(2 * (k + 1), round(5 * n**0.63))


def _directions(trees: int, dimension: int, seed: int) -> np.ndarray:
    """(tree, digit, direction, coordinate): random rotations where there are as many coordinates as directions."""
    rng = np.random.default_rng(seed)
    out = rng.standard_normal((trees, DIGITS, WIDTH, dimension))
    return (out / np.sqrt(dimension)).astype(np.float32)


class Forest:
    """Sorted hash strings of each tree over the rows of x (float64)."""

    def __init__(self, x: np.ndarray, longest: float, trees: int = TREES, seed: int = 7, arrays=None):
        self.x, self.longest = x, longest
        self.directions = _directions(trees, x.shape[1] + 1, seed)
        if arrays is not None:
            self.keys, self.order = arrays
            return
        lift = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))
        lifted = np.column_stack([x, lift]).astype(np.float32)
        self.keys = np.empty((trees, len(x)), np.uint32)
        self.order = np.empty((trees, len(x)), np.int32)
        for t in range(trees):
            key = np.zeros(len(x), np.uint32)
            for d in range(DIGITS):
                key = key * np.uint32(2 * WIDTH) + self._digit(lifted @ self.directions[t, d].T)
            self.order[t] = np.argsort(key, kind="stable")
            self.keys[t] = key[self.order[t]]

    @staticmethod
    def _digit(along: np.ndarray) -> np.ndarray:
        at = np.abs(along).argmax(axis=1)
        return (at * 2 + (along[np.arange(len(along)), at] > 0)).astype(np.uint32)

    def candidates(self, q: np.ndarray, enough: int):
        """For each query the rows to score: at least `enough` distinct ones, or all."""
        n = self.keys.shape[1]
        if enough >= n:
            yield from (np.arange(n) for _ in q)
            return
        trees = len(self.keys)
        lifted = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        # the best digits of each query, best first, by (tree, place, query, try), and how well they fit
        digits = np.empty((trees, DIGITS, len(q), TRIES), np.uint32)
        fits = np.empty((trees, DIGITS, len(q), TRIES), np.float32)
        for t in range(trees):
            for d in range(DIGITS):
                along = lifted @ self.directions[t, d].T
                signed = np.stack([-along, along], axis=2).reshape(len(q), 2 * WIDTH)
                best = np.argpartition(-signed, TRIES - 1, axis=1)[:, :TRIES]
                fit = np.take_along_axis(signed, best, 1)
                place = np.argsort(-fit, axis=1, kind="stable")
                digits[t, d], fits[t, d] = np.take_along_axis(best, place, 1), np.take_along_axis(fit, place, 1)
        met = [np.zeros(0, np.int32)] * len(q)
        waiting = np.arange(len(q))
        mark, flat = np.zeros(n, bool), self.order.ravel()
        for depth in range(DIGITS, 0, -1):
            # at depths where a prefix holds less than a row on average only the query's own is met: its longest match
            tries = TRIES if n >= (2 * WIDTH) ** (depth - 1) * 4 or depth == 1 else 1
            if (2 * WIDTH) ** depth > 64 * n:
                tries = 1
            codes = np.zeros((trees, len(waiting), 1), np.uint32)
            score = np.zeros((trees, len(waiting), 1), np.float32)
            for d in range(depth):
                codes = (codes[..., None] * np.uint32(2 * WIDTH) + digits[:, d, waiting, None, :tries]).reshape(trees, len(waiting), -1)
                score = (score[..., None] + fits[:, d, waiting, None, :tries]).reshape(trees, len(waiting), -1)
            span = np.uint32((2 * WIDTH) ** (DIGITS - depth))
            low = np.empty(codes.shape, np.int32)
            high = np.empty(codes.shape, np.int32)
            for t in range(trees):
                low[t] = np.searchsorted(self.keys[t], codes[t] * span, "left")
                high[t] = np.searchsorted(self.keys[t], codes[t] * span + (span - np.uint32(1)), "right")
            k = codes.shape[2]
            low, high, score = (a.transpose(1, 0, 2).reshape(len(waiting), trees * k) for a in (low, high, score))
            still = []
            for row, j in enumerate(waiting.tolist()):
                size = high[row] - low[row]
                some = np.flatnonzero(size)
                some = some[np.argsort(-score[row, some], kind="stable")]
                got, at = met[j], 0
                mark[got] = True
                total = np.cumsum(size[some])
                while len(got) < enough and at < len(some):
                    # rows repeat between trees, so what is missing is taken again and again
                    stop = min(len(some), max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (enough - len(got)), "left")) + 1))
                    nodes = some[at:stop]
                    lengths = size[nodes]
                    before = np.cumsum(lengths) - lengths
                    first = nodes // k * n + low[row, nodes] - before
                    mark[flat[np.repeat(first, lengths) + np.arange(before[-1] + lengths[-1])]] = True
                    at = stop
                    got = np.flatnonzero(mark)
                mark[got] = False
                met[j] = got
                if len(got) < enough:
                    still.append(j)
            waiting = np.array(still, np.int64)
            if not len(waiting):
                break
        for j in range(len(q)):
            yield met[j] if len(met[j]) >= enough else np.arange(n)

    def dump(self, out, names: list[list[int]]) -> None:
        ends = np.cumsum([len(x) for x in names]).astype("<i8")
        flat = np.array([i for x in names for i in x], "<i8")
        out.write(struct.pack("<QQQQd", *self.x.shape, len(self.keys), len(flat), self.longest))
        for a in (self.x.astype("<f8"), self.keys.astype("<u4"), self.order.astype("<i4"), ends, flat):
            out.write(np.ascontiguousarray(a).tobytes())

    @classmethod
    def load(cls, raw: bytes, seed: int) -> tuple[Forest, np.ndarray, np.ndarray]:
        """(the forest, end of each row's ids, ids)."""
        n, dimension, trees, m, longest = struct.unpack_from("<QQQQd", raw)
        at, parts = struct.calcsize("<QQQQd"), []
        for kind, count in (("<f8", n * dimension), ("<u4", trees * n), ("<i4", trees * n), ("<i8", n), ("<i8", m)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        forest = cls(parts[0].reshape(n, dimension), longest, trees, seed, (parts[1].reshape(trees, n), parts[2].reshape(trees, n)))
        return forest, parts[3], parts[4]


def usable(c: str) -> Column:
    """Vectors without null or non-finite components that are not all zero."""
    v = F.col(c)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, uri: str, k: int = 20, trees: int = TREES, candidates: int | None = None, seed: int = 7, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, <key>, score: for each query the k rows with the largest inner product among its candidates.

    Candidates are all rows but those with the query's own id; ties go to the smaller id. Null, zero and non-finite vectors and
    rows with a null id take no part; vectors of another length are compared with those of their own length only.
    Rows that repeat an id and a vector count once; an id with several vectors is one query of each, and counts with the
    best score that any of them gives. candidates: distinct vectors that a query scores in each shard of up to SHARD, at least (enough_rows() of the
    shard's by default); it sets recall, which the tests measure against brute force. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), is_query.alias("q")).distinct()
    rows = common.stash(rows, f"{uri}/rows")
    # a result holds at most k rows with one vector, besides the query itself
    alike = Window.partitionBy("v").orderBy("id")
    ranked = rows.withColumn("r", F.row_number().over(alike)).filter(F.col("r") <= k + 1)
    points = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = common.stash(points.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), f"{uri}/points")
    sizes = {r["m"]: (r["n"], r["longest"]) for r in points.groupBy(F.size("v").alias("m")).agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}  # a row for each length of vector
    shards = {m: max(1, -(-n // SHARD)) for m, (n, _) in sizes.items()}
    longest = {m: x for m, (_, x) in sizes.items()}
    n_shards = F.lit(1)
    for m, n in shards.items():
        n_shards = F.when(F.size("v") == m, F.lit(n)).otherwise(n_shards)
    points = points.withColumn("m", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), n_shards).cast("int"))

    def name(m: int, shard: int) -> str:
        return f"{uri}/forest/{m}-{shard:07d}"

    def build(group, t):
        import pyarrow as pa

        m, shard = group[0].as_py(), group[1].as_py()
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, m).astype(np.float64)
        forest = Forest(x, longest[m], trees, seed)
        common.publish(name(m, shard), lambda out: forest.dump(out, t.column("ids").to_pylist()))
        return pa.table({"m": pa.array([m], pa.int32()), "shard": pa.array([shard], pa.int32())})

    built = points.groupBy("m", "shard").applyInArrow(build, "m int, shard int").agg(F.count("*")).first()[0]  # the forests are files now
    asked = rows.filter("q").select("id", "v", F.size("v").alias("m"))
    n_asked = asked.count()
    blocks = max(1, -(-n_asked // BLOCK))
    # a block's queries meet all shards; few blocks share the shards out among more tasks
    shares = max(1, min(max(shards.values(), default=1), -(-4 * spark.sparkContext.defaultParallelism // blocks)))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("v", "id"), F.lit(blocks)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    schema = "query_id long, id long, score double"
    if not built or not n_asked:
        best = spark.createDataFrame([], schema)
    else:

        def search(group, t):
            import pyarrow as pa

            m, share = group[0].as_py(), group[2].as_py()
            q_ids = t.column("id").to_numpy()
            q = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, m).astype(np.float64)
            best: list[list[tuple[float, int]]] = [[] for _ in q_ids]
            for shard in range(share, shards[m], shares):
                path = name(m, shard)
                if not common.exists(path):
                    continue  # no vector was dealt to it
                forest, ends, ids = Forest.load(common.fetch(path), seed)
                for a in range(0, len(q), STEP):
                    for i, near in enumerate(forest.candidates(q[a : a + STEP], candidates or enough_rows(len(forest.x), k)), a):
                        best[i] = sorted(best[i] + _best(forest.x, near, q[i], ends, ids, int(q_ids[i]), k), key=lambda p: (-p[0], p[1]))[:k]
            return pa.table({
                "query_id": pa.array(np.repeat(q_ids, [len(b) for b in best]), pa.int64()),
                "id": pa.array([i for b in best for _, i in b], pa.int64()),
                "score": pa.array([s for b in best for s, _ in b], pa.float64()),
            })

        # as many tasks as there are blocks and shares: the rows are few, what is done with them is not
        best = dealt.repartition(min(2 * blocks * shares, 100_000), "m", "block", "share").groupBy("m", "block", "share").applyInArrow(search, schema)
    best = best.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def _best(x: np.ndarray, near: np.ndarray, q: np.ndarray, ends: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
    """The k best (score, id) of the rows `near`, without the id `own`; ties to the smaller id."""
    score = x[near] @ q
    if len(near) > k + 1:
        # the least of the k + 1 best vectors, less what rounding may differ by
        edge = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
        near = near[score >= edge - 1e-9 * (1 + abs(edge))]
    score = (x[near] * q).sum(axis=1)
    pairs = sorted((-s, i) for r, s in zip(near.tolist(), score.tolist(), strict=True) for i in ids[ends[r - 1] if r else 0 : ends[r]].tolist() if i != own)
    return [(-s, i) for s, i in pairs[:k]]
