"""Exact nearest vectors by blocks: a task multiplies blocks of its vectors with blocks of queries and keeps the best few of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored_at, working_folder

#: numbers of a block of vectors and of a block of queries (in doubles)
VECTOR_BLOCK, QUERY_BLOCK = 1 << 20, 1 << 20
#: numbers of a product of blocks: it is this that would fill a worker, not the blocks
PRODUCT = 1 << 21
#: by how much products of blocks may differ from sums of one row's products
SLACK = 1e-9


def _units(column):
    """(rows that have one, their vectors at length 1) of an Arrow list column whose lists are equally long."""
    import numpy as np
    import pyarrow.compute as pc

    rows = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
    values = column.drop_null().flatten()
    own = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    sizes = np.sqrt((own * own).sum(axis=1))
    good = np.isfinite(sizes) & (sizes > 0)
    return rows[good], own[good] / sizes[good, None]


def best_pairs(queries: DataFrame, vectors: DataFrame, n: int, key: str, where: Column | None = None) -> DataFrame:
    """(query_id, key, distance): of each query (query_id, vector, ...) the n nearest of each task's blocks, by cosine distance, ties by key.

    where: a condition on the query's columns and the other columns of `vectors`. Those have few distinct values (versions, say): vectors are
    taken by their values, and a query meets the blocks of those values only that its condition allows. Queries are stored, and tasks
    read them block by block, so neither side has to fit anywhere. Vectors that are null, empty or zero, or hold a null or a
    number that is not finite, take no part; neither do pairs of different lengths.
    """
    others = [c for c in vectors.columns if c not in (key, "vector")] if where is not None else []
    group = F.concat_ws("|", F.size("vector").cast("string"), F.to_json(F.struct(*others)) if others else F.lit(""))
    fit = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    asked = queries.filter(fit & (F.size("vector") > 0))
    if others:
        asked = asked.join(vectors.select(*others).distinct(), where)  # queries by values of these columns
    asked = asked.select("query_id", F.col("vector").cast("array<double>").alias("vector"), group.alias("g"))
    uri, asked = stored_at(asked.repartitionByRange("g").sortWithinPartitions("g"), working_folder(queries.sparkSession, "queries"))
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("distance", T.DoubleType())])

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        table = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False)
        small = table.to_table() if table.count_rows() <= 5000 else None

        def query_blocks(g, size, against):
            rows = max(1, min(QUERY_BLOCK // size, PRODUCT // against))
            own = ds.field("g") == g
            found = small.filter(own).to_batches(max_chunksize=rows) if small is not None else table.to_batches(filter=own, batch_size=rows)
            for b in found:
                if b.num_rows:
                    at, units = _units(b.column("vector"))
                    yield b.column("query_id").take(pa.array(at)), units

        def best(ids, units, g):
            order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            for names, q in query_blocks(g, units.shape[1], len(units)):
                near = q @ units.T
                k = min(n, len(units))
                least = np.partition(near, len(units) - k, axis=1)[:, len(units) - k] - SLACK
                rows, found, scores = [], [], []
                for j in range(len(q)):
                    at = np.flatnonzero(near[j] >= least[j])
                    exact = (units[at] * q[j]).sum(axis=1)  # the same for equal vectors, wherever they are
                    first = np.lexsort((order[at], -exact))[:k]
                    rows += [j] * len(first)
                    found.append(at[first])
                    scores.append(1 - exact[first])
                if rows:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], names=["query_id", key, "distance"])

        held: dict = {}
        for batch in batches:
            groups = batch.column(2).dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False)
            for c, g in enumerate(groups.dictionary.to_pylist()):
                own = batch.take(pa.array(np.flatnonzero(codes == c)))
                at, units = _units(own.column(1))
                parts = held.setdefault(g, [])
                parts.append((own.column(0).take(pa.array(at)), units))
                if sum(u.size for _, u in parts) >= VECTOR_BLOCK:
                    yield from best(pa.concat_arrays([i for i, _ in parts]), np.concatenate([u for _, u in parts]), g)
                    held[g] = []
            if sum(u.size for parts in held.values() for _, u in parts) >= 4 * VECTOR_BLOCK:  # many groups, each of them small
                for g, parts in held.items():
                    if parts:
                        yield from best(pa.concat_arrays([i for i, _ in parts]), np.concatenate([u for _, u in parts]), g)
                held = {}
        for g, parts in held.items():
            if parts and sum(len(u) for _, u in parts):
                yield from best(pa.concat_arrays([i for i, _ in parts]), np.concatenate([u for _, u in parts]), g)

    return vectors.filter(fit & (F.size("vector") > 0)).select(key, "vector", group.alias("g")).mapInArrow(work, schema)
