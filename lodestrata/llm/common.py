"""What the operators share: the shared working folder, stored intermediate tables and file access from tasks."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI: the session's ``spark.checkpoint.dir``.

    Only in local mode (tests) may that be unset; a local folder is chosen then. On a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        master = conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir names no folder that {master} shares")
        root = os.path.join(tempfile.gettempdir(), "checkpoints", "lodestrata")
    return root.rstrip("/") if "://" in root else f"file://{os.path.abspath(root)}"


_made: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below the shared root; each call of an operator has its own. It is removed when the driver ends."""
    uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(lambda: [remove(u) for u in _made])
    _made.append(uri)
    return uri


def kept_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below the shared root, for files that stay."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(uri: str) -> None:
    """Delete a folder, if it is there and its file system can be reached."""
    with contextlib.suppress(OSError, ValueError):  # pyarrow's errors are of these kinds
        fs, path = open_fs(uri)
        fs.delete_dir(path)


def input_bytes(df: DataFrame) -> int:
    """What the optimizer takes the size of a frame to be, from files' sizes; 0 where it knows nothing."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def stash(df: DataFrame, uri: str, codec: str = "zstd") -> DataFrame:
    """Write `df` as a table in the shared folder and reread it: cuts lineage and survives lost executors."""
    df.write.option("compression", codec).parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def open_fs(uri: str):
    """(file system, path) of a URI, usable in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """Call write(stream) on a temporary name, then move it to `uri`: a retried or doubled task leaves one whole file.

    Where a file system does not move onto a file that is there, that file, which another attempt has written, stays.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(part) as out:
        write(out)
    try:
        fs.move(part, path)
    except OSError:
        if not exists(uri):
            raise
        fs.delete_file(part)


def exists(uri: str) -> bool:
    return exists_in(*open_fs(uri))


def exists_in(fs, path: str) -> bool:
    from pyarrow import fs as pafs

    return fs.get_file_info(path).type == pafs.FileType.File


def fetch(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(batch, column: int, limit: int = 1_500_000):
    """Ranges (start, end) of the rows of an Arrow batch whose texts hold about `limit` bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)
