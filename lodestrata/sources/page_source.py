"""Page models and line files as Spark data sources: `spark.read.format("page_models")`, `readStream`, and `write.format("named_lines")`.

The source cuts JSON lines files into byte ranges, so a large file is the work of many tasks, and drops lines by the filters that Spark hands
down before it makes rows of them. The sink writes one file for each name and publishes them when all tasks are done.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql import types as T

from ..schema import PAGE

#: bytes of a partition, and rows of a batch that it gives
SPLIT, ROWS = 32 << 20, 500
COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
TESTS = {"==": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b, "any": lambda a, b: True}  # nulls pass none of them


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str, pattern: str) -> list[tuple[str, int, int]]:
    """(path, size, time of its last change in ns) of the files below a folder, or of the one file, whose names match a pattern with stars."""
    from fnmatch import fnmatch

    from pyarrow import fs as pafs

    fs, where = _fs(path)
    info = fs.get_file_info(where)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(where, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size, f.mtime_ns) for f in found if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern) and not f.base_name.startswith(("_", ".")))


def version_of(name: str) -> str:
    m = re.search(r"B(\d)(\d+)", name, re.IGNORECASE)
    return f"{m[1]}.{m[2]}" if m else "unknown"


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


def _ranges(files: list[tuple[str, int, int]], split: int) -> list[Range]:
    return [Range(path, a, min(a + split, size)) for path, size, _ in files for a in range(0, size, split)]


def _lines(fs, part: Range) -> Iterator[bytes]:
    """The lines that begin within the range."""
    with fs.open_input_file(part.path) as f:
        f.seek(max(0, part.first - 1))
        at, rest = max(0, part.first - 1), b""
        skip = part.first > 0  # what is before the first line end belongs to the range before
        while True:
            block = f.read(1 << 20)
            rest += block
            *whole, rest = rest.split(b"\n") if block else (rest, b"")
            for line in whole:
                if not skip:
                    if at >= part.last:
                        return
                    yield line
                skip, at = False, at + len(line) + 1
            if not block:
                return


def _rows(options: dict, schema: T.StructType, part: Range, tests: list[tuple[str, str, object]]):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, names, rows = to_arrow_schema(schema), schema.fieldNames(), []
    fs, _ = _fs(options["path"])
    source = part.path.rpartition("/")[2]
    given = {"source": source, "version": version_of(source)}
    for line in _lines(fs, part):
        if not line.strip():
            continue
        page = json.loads(line)
        if "toc" in page:
            continue
        page = {n: page.get(n) for n in names} | given
        if all(page.get(c) is not None and TESTS[op](page[c], v) for c, op, v in tests):
            rows.append(page)
        if len(rows) >= ROWS:
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()
            rows = []
    if rows:
        yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()


class PageModels(DataSource):
    """Options: path (a file or folder), pattern (*.json*), split (bytes). Columns are those of schema.PAGE; source is the file's name, version what the name tells."""

    @classmethod
    def name(cls) -> str:
        return "page_models"

    def schema(self) -> T.StructType:
        return PAGE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PageReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return PageStream(self.options, schema)


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema, self.tests = dict(options), schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of page_num, version and source are made here; the others stay Spark's."""
        for f in filters:
            here = getattr(f, "attribute", None) in (("page_num",), ("version",), ("source",))
            if here and isinstance(f, IsNotNull):
                self.tests.append((f.attribute[0], "any", None))
            elif here and type(f) in COMPARED and f.value is not None:
                self.tests.append((f.attribute[0], COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        """Files whose names tell another source or version have none."""
        own = [t for t in self.tests if t[0] != "page_num"]
        files = _files(self.options["path"], self.options.get("pattern", "*.json*"))
        kept = [f for f in files if all(TESTS[op]({"source": (n := f[0].rpartition("/")[2]), "version": version_of(n)}[c], v) for c, op, v in own)]
        return _ranges(kept, int(self.options.get("split", SPLIT)))

    def read(self, partition: Range):
        if partition is None:
            return iter(())
        return _rows(self.options, self.schema, partition, self.tests)


class PageStream(DataSourceStreamReader):
    """Files in the order of their last change: an offset is the (time, path) of the last one. Files are put in place whole, by a rename, later ones with later times."""

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = dict(options), schema

    def _all(self) -> list[tuple[int, str, int]]:
        return sorted((t, path, size) for path, size, t in _files(self.options["path"], self.options.get("pattern", "*.json*")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self._all()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _ranges([(path, size, t) for t, path, size in self._all() if low < (t, path) <= high], int(self.options.get("split", SPLIT)))

    def read(self, partition: Range):
        return _rows(self.options, self.schema, partition, [])


# -- the sink -----------------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class NamedLines(DataSource):
    """A sink of lines: column `name` is the file, `line` its next line. Option path: the folder. Each name is one task's."""

    @classmethod
    def name(cls) -> str:
        return "named_lines"

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ARG002
        return LineWriter(dict(self.options))


class LineWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        fs, root = _fs(self.path)
        task = TaskContext.get()
        folder = f"{root}/_staged-{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(folder, recursive=True)
        names, out = [], None
        try:
            for batch in iterator:
                for name, line in zip(batch.column("name").to_pylist(), batch.column("line").to_pylist(), strict=True):
                    if not names or names[-1] != name:
                        if name in names:
                            raise ValueError(f"the rows of {name} do not follow each other")
                        if out:
                            out.close()
                        names.append(name)
                        out = fs.open_output_stream(f"{folder}/{name}")
                    out.write((line or "").encode() + b"\n")
        finally:
            if out:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        done = [m for m in messages if m is not None]
        every = [n for m in done for n in m.names]
        if len(every) != len(set(every)):
            self.abort(messages)
            raise ValueError("several tasks wrote lines of one name")
        for m in done:
            for n in m.names:
                fs.move(f"{m.folder}/{n}", f"{root}/{n}")
        self._clear()

    def abort(self, messages: list) -> None:  # noqa: ARG002
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs as pafs

        fs, root = _fs(self.path)
        if fs.get_file_info(f"{root}/_staged-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_staged-{self.job}")


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let Spark hand filters down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageModels)
    spark.dataSource.register(NamedLines)


def write_named(df: DataFrame, path: str, name: str, order: list[str], line: str | None = None) -> None:
    """One file for each value of `name` (null: no file), its rows in order, as JSON or as the text of column `line`. Nothing shows before all is written; an abort leaves nothing.

    A file that has to be whole is written by one task, streaming.
    """
    register(df.sparkSession)
    columns = [c for c in df.columns if c != name]
    text = F.col(line) if line else F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = df.filter(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("name"), text.alias("line"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)])
    rows = rows.repartition("name").sortWithinPartitions("name", *[f"__{i}" for i in range(len(order))])
    rows.select("name", "line").write.format("named_lines").option("path", path).mode("append").save()
