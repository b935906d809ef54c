"""Makes the package importable in Python workers that do not share the driver's path."""

from __future__ import annotations

import itertools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the session's workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the driver and the executors share, the session's spark.checkpoint.dir; a local one where that is unset, in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored_at(df: DataFrame, uri: str) -> tuple[str, DataFrame]:
    """(the folder, df as it is stored there); the folder goes when the application ends."""
    spark = df.sparkSession
    df.write.parquet(uri)
    folder = spark._jvm.org.apache.hadoop.fs.Path(uri)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return uri, spark.read.schema(df.schema).parquet(uri)


def stored(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """Writes frames as Parquet below a working folder and reads them back: their plans end there, and lost executors do not cost them again.

    The folder goes when the application ends.
    """
    uri, numbers = working_folder(spark, name), itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        return stored_at(df, f"{uri}/{next(numbers)}")[1]

    return keep
