"""Deterministic chunk ids: version-5 UUIDs of the fields that identify a chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import ID_NAMESPACE


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5, without leaving the JVM."""
    data = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    h = F.sha1(data)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(source: Column, version: Column, kind: Column, page: Column, path: Column, index: Column, raw: Column) -> Column:
    digest = F.substring(F.sha2(F.encode(raw, "UTF-8"), 256), 1, 16)
    return uuid5(ID_NAMESPACE, F.concat_ws("|", source, version, kind, page.cast("string"), F.array_join(path, "/"), index.cast("string"), digest))
