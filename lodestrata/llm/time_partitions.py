"""Adaptive time partitions (operator 12).

A table is laid out in Parquet files by a moment of its rows: years that hold more than `most` rows are split into their months,
those into days, those into hours, and small neighbours share a leaf. Counts are grouped by hour once; the driver asks for the
counts of overfull nodes' children only, so what it gets is bounded by the number of nodes that hold more than `most` rows
and not by the rows. Rows find their leaf by a broadcast map of calendar nodes.

A leaf's rows are numbered by a window over (leaf, slice): slices are ranges of the leaf's order, so that a leaf that holds
most rows is numbered by many tasks, and the slices before one add what they hold. Each file is written by one
task, streaming. A rewrite moves only the rows of the files that change.
"""

from __future__ import annotations

import calendar
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: what an hour's key is divided by for its day, month and year; see `hour_key`
DAY, MONTH, YEAR = 100, 10_000, 1_000_000
NULLS = "null"
#: rows of a row group
ROW_GROUP = 100_000

MANIFEST = "leaf string, part long, columns string, ids_sha256 string, path string, n_rows long, n_new long, rewritten boolean"


def hour_key(moment: Column) -> Column:
    """Year, month, day and hour + 1 as digits. A key that ends in 00 is a whole day, in 0000 a month, in 000000 a year."""
    return (F.year(moment) * YEAR + F.month(moment) * MONTH + F.dayofmonth(moment) * DAY + F.hour(moment) + 1).cast("long")


def members(node: int) -> list[int]:
    """The keys of a year's months, a month's days or a day's hours."""
    year, month, day = node // YEAR, node // MONTH % 100, node // DAY % 100
    if not month:
        return [node + m * MONTH for m in range(1, 13)]
    if not day:
        return [node + d * DAY for d in range(1, calendar.monthrange(year, month)[1] + 1)]
    return [node + h for h in range(1, 25)]


def leaf_name(first: int, last: int) -> str:
    """Parents and the first and last member, such as 2005-2007 or 2024/03/05/07-07."""

    def parts(node: int) -> list[str]:
        out = [f"{node // YEAR:04d}"]
        for unit, shift in ((MONTH, 0), (DAY, 0), (1, 1)):
            if n := node // unit % 100:
                out.append(f"{n - shift:02d}")
        return out

    a, b = parts(first), parts(last)
    return "/".join([*a[:-1], f"{a[-1]}-{b[-1]}"])


def next_fit(siblings: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Runs of siblings (key, rows), in time order: one joins the run of the sibling just before it while that stays within most. Overfull ones are left out and end a run."""
    runs: list[list[int]] = []
    held, open_ = 0, False
    for key, n in siblings:
        if n > most:
            open_ = False
        elif open_ and held + n <= most:
            runs[-1].append(key)
            held += n
        else:
            runs.append([key])
            held, open_ = n, True
    return runs


def plan_leaves(counts: Callable[[int, list[int] | None], dict[int, int]], most: int) -> tuple[dict[int, str], set[int]]:
    """(leaf of each sibling with rows or in a run that has some, overfull nodes that are split).

    counts(unit, nodes): rows by node of that unit below the given nodes (all years for None). Called once a level.
    """
    years = counts(YEAR, None)
    level = [[y * YEAR for y in range(min(years) // YEAR, max(years) // YEAR + 1)]] if years else []
    held, leaves, split = years, {}, set()
    for unit in (MONTH, DAY, 1, None):
        over = []
        for siblings in level:
            sized = [(k, held.get(k, 0)) for k in siblings]
            for run in next_fit(sized, most):
                if any(held.get(k) for k in run):
                    leaves.update((k, leaf_name(run[0], run[-1])) for k in run if held.get(k))
            over += [k for k, n in sized if n > most]
        if unit is None:
            leaves.update((k, leaf_name(k, k)) for k in over)
            break
        if not over:
            break
        split.update(over)
        level, held = [members(k) for k in over], counts(unit, over)
    return leaves, split


def _hours(rows: DataFrame, uri: str) -> Callable[[int, list[int] | None], dict[int, int]]:
    # nulls go after the counting: a filter before it would repeat the moment's expressions for each part of the hour
    table = common.stash(rows.groupBy(F.col("__hour").alias("hour")).count(), uri).filter("hour IS NOT NULL")

    def counts(unit: int, nodes: list[int] | None) -> dict[int, int]:
        """Hours end in 1 to 24, so cutting digits off leads to the node above."""
        of = lambda u: F.col("hour") - F.col("hour") % u
        above = {MONTH: YEAR, DAY: MONTH, 1: DAY}.get(unit)
        part = table if nodes is None else table.filter(of(above).isin(nodes))
        return {r[0]: r[1] for r in part.groupBy(of(unit)).agg(F.sum("count")).collect()}

    return counts


def _node(split: set[int]) -> Column:
    """The sibling that holds a row: of its year, month, day and hour the first that is not split."""
    hour = F.col("__hour")
    node = hour
    for unit in (DAY, MONTH, YEAR):
        at = hour - hour % unit
        known = [k for k in split if not k % unit and (unit == YEAR or k % (unit * 100))]
        node = F.when(at.isin(known), node).otherwise(at) if known else at
    return F.when(hour.isNotNull(), node)


def _numbered(rows: DataFrame, order: list[str], most: int, uri: str) -> DataFrame:
    """rows with __leaf and __part. Slices are what range partitioning by leaf and order makes."""
    by = ["__leaf", *order]
    counts = _hours(rows, f"{uri}/hours")
    leaves, split = plan_leaves(counts, most)
    spark = rows.sparkSession
    leaf = F.broadcast(spark.createDataFrame([*leaves.items()], "__node long, __leaf string"))
    placed = rows.withColumn("__node", _node(split)).join(leaf, "__node", "left").withColumn("__leaf", F.coalesce("__leaf", F.lit(NULLS))).drop("__node", "__hour")
    sliced = common.stash(placed.repartitionByRange(*by).withColumn("__slice", F.spark_partition_id()), f"{uri}/sliced")
    sizes = sliced.groupBy("__leaf", "__slice").count()  # a row for each slice and leaf in it
    before = F.sum("count").over(Window.partitionBy("__leaf").orderBy("__slice")) - F.col("count")
    before = F.broadcast(sizes.select("__leaf", "__slice", before.alias("__before")))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__leaf", "__slice").orderBy(*order))
    numbered = sliced.join(before, ["__leaf", "__slice"]).withColumn("__part", F.floor((place - 1) / most) + 1).drop("__before", "__slice")
    out = common.stash(numbered, f"{uri}/numbered")
    common.remove(f"{uri}/sliced")
    return out


class _File:
    """A file that is being written: rows in order, in row groups of some size, with the digest of their keys."""

    def __init__(self, fs, root: str, leaf: str, part: int):
        self.fs, self.root, self.leaf, self.part = fs, root, leaf, part
        self.name, self.writer, self.waiting, self.held = f"{root}/.{uuid.uuid4().hex}.tmp", None, [], 0
        self.digest, self.n, self.new = hashlib.sha256(), 0, 0

    def add(self, rows, keys: list, new: int) -> None:
        text = ",".join("null" if x is None else str(x) for x in keys)
        self.digest.update(("," * bool(self.n) + text).encode())
        self.n, self.new = self.n + len(keys), self.new + new
        self.waiting.append(rows)
        self.held += len(keys)
        if self.held >= ROW_GROUP:
            self._flush()

    def _flush(self) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        rows = pa.concat_tables(self.waiting)
        self.writer = self.writer or pq.ParquetWriter(self.name, rows.schema, filesystem=self.fs, compression="zstd")
        self.writer.write_table(rows)
        self.waiting, self.held = [], 0

    def close(self, tag: str) -> tuple[str, str]:
        """(final name, digest). A task that is tried again makes the same name."""
        if self.held:
            self._flush()
        self.writer.close()
        told = self.digest.hexdigest()
        name = f"{self.leaf.replace('/', '_')}.{self.part:06d}.{tag}.parquet"
        try:
            self.fs.move(self.name, f"{self.root}/{name}")
        except OSError:
            if not common.exists_in(self.fs, f"{self.root}/{name}"):
                raise
            self.fs.delete_file(self.name)
        return name, told


def _write(rows: DataFrame, order: list[str], columns: list[str], key: str, folder: str) -> list[dict]:
    """One file for each (__leaf, __part), rows in order, by one task each; the manifest of these files."""
    n_columns, tag = len(columns), uuid.uuid4().hex[:8]
    names = [f.split()[0] for f in MANIFEST.split(", ")]

    def work(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        fs, root = common.open_fs(folder)
        fs.create_dir(root, recursive=True)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        at = None

        def told(file):
            name, digest = file.close(tag)
            row = [file.leaf, file.part, ",".join(columns), digest, f"{folder}/{name}", file.n, file.new, True]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            where = list(zip(table["__leaf"].to_pylist(), table["__part"].to_pylist(), strict=True))
            ends = [i for i in range(1, len(where)) if where[i] != where[i - 1]] + [len(where)] * bool(where)
            for a, b in zip([0, *ends], ends, strict=False):
                if at is None or (at.leaf, at.part) != where[a]:
                    if at:
                        yield told(at)
                    at = _File(fs, root, *where[a])
                own = table.slice(a, b - a)
                at.add(own.select(range(n_columns)), own[key].to_pylist(), pc.sum(pc.cast(own["__new"], pa.int64())).as_py())
        if at:
            yield told(at)

    by = ["__leaf", "__part"]
    ordered = rows.repartition(*by).sortWithinPartitions(*by, *order)
    return [r.asDict() for r in ordered.select(*columns, *by, "__new").mapInArrow(work, MANIFEST).collect()]


def lay_out(df: DataFrame, moment: Column, most: int, folder: str, uri: str, order: list[str], key: str, start: list[dict] | None = None, new: Column | None = None) -> list[dict]:
    """Lay df out in `folder`, a file for each leaf and part of at most `most` rows; the manifest's rows, in the order of leaves and parts.

    start: the manifest of a layout in the same folder of those rows of df for which `new` is false; its files whose leaf, part and rows
    recur stay as they are and the others go. Rows are ordered by moment, `order` and then all their columns, nulls first,
    so that only rows equal in all columns tie. Null moments are a leaf of their own. An empty df leaves an empty folder. Columns whose
    names begin with __ are not allowed. `uri` holds intermediate tables, which go.
    """
    columns = df.columns
    if any(c.startswith("__") for c in columns):
        raise ValueError("columns whose names begin with __ clash with the layout's own")
    order = ["__moment", *order, *(c for c in columns if c not in order)]
    marked = df.withColumn("__moment", moment).withColumn("__new", F.coalesce(new, F.lit(True)) if new is not None else F.lit(True))
    numbered = _numbered(marked.withColumn("__hour", hour_key(F.col("__moment"))), order, most, uri)
    # one row a file: as many as leaves and the rows over `most`
    parts = sorted(numbered.groupBy("__leaf", "__part").agg(F.count("*").alias("n"), F.sum(F.col("__new").cast("long")).alias("new")).collect())
    held = {(r["leaf"], r["part"]): r for r in start or []}
    stay, leaf, changed = {}, None, False
    for name, part, n, n_new in parts:
        # both layouts order the rows that are not new alike: a part's rows recur where none before it in its leaf and none in it are new
        changed = (changed if name == leaf else False) or n_new > 0
        leaf = name
        old = held.get((name, part))
        if old is not None and not changed and old["n_rows"] == n:
            stay[name, part] = old
    spark = df.sparkSession
    rest = numbered
    if stay:
        kept = F.broadcast(spark.createDataFrame([*stay], "__leaf string, __part long"))
        rest = numbered.join(kept, ["__leaf", "__part"], "left_anti")
    written = _write(rest, order, columns, key, folder)
    common.remove(uri)
    kept_files = [r | {"rewritten": False, "n_new": 0} for r in stay.values()]
    final = sorted([*written, *kept_files], key=lambda r: (r["leaf"], r["part"]))
    _sweep(folder, {r["path"].rpartition("/")[2] for r in final})
    return final


def _sweep(folder: str, names: set[str]) -> None:
    """Remove the files that are not in the manifest: those of the layout before, and what lost attempts left."""
    from pyarrow import fs as pafs

    fs, path = common.open_fs(folder)
    fs.create_dir(path, recursive=True)
    for f in fs.get_file_info(pafs.FileSelector(path)):
        if f.type == pafs.FileType.File and f.base_name not in names:
            fs.delete_file(f.path)


def moved_moment(ts: Column, key: Column) -> Column:
    """The contract's moment: for some of 128 classes of the key long before, for others its Monday 00:00. A null key leaves it as it is."""
    ts = ts.cast("timestamp_ntz")
    k = (F.crc32(F.encode(key.cast("string"), "UTF-8")) % 128).cast("int")
    monday = F.date_sub(ts.cast("date"), F.weekday(ts.cast("date"))).cast("timestamp_ntz")
    back = ts - F.make_dt_interval(days=(k + 6) * (k + 6) * (k + 6))
    return F.when(k < 16, back).when(k > 111, monday).otherwise(ts)


def rewrite_clicks(spark: SparkSession, clicks: DataFrame, folder: str, uri: str, parts: int = 650, until: str = "2024-03-01 00:00:00") -> DataFrame:
    """Lay out the clicks that arrived before `until`, then all, in the same folder; the manifest of the second layout."""
    most = 1 + clicks.count() // parts
    early = F.coalesce(F.col("arrived_at") < F.lit(until).cast("timestamp_ntz"), F.lit(False))
    moment = moved_moment(F.col("ts"), F.col("click_id"))
    order = ["arrived_at", "click_id"]
    first = lay_out(clicks.filter(early), moment, most, folder, f"{uri}/first", order, "click_id")
    final = lay_out(clicks, moment, most, folder, f"{uri}/final", order, "click_id", first, ~early)
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in final], MANIFEST)
