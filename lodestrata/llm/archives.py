"""WARC records in ZIP packages: writer, and a reader that range-reads records without extraction (operator 4).

A package is a ZIP file (with ZIP64 records where sizes ask for them) of two stored members: `archive/data.warc.gz`,
one gzip member per WARC record, and `indexes/index.cdxj`, one line per record with its offset and length inside the
archive. Since members are stored, a record is at (member's data offset + record's offset) of the package. The reader
finds the end record, the ZIP64 end record where there is one, the central directory and the local headers itself.

Equal payloads: the record with the smallest page id is the response; the others are revisit records without payload
that refer to it. Which they are is found out on digests and page ids alone; payloads move once, dealt by page. Packages are
written under names that hold the task's attempt, by rename, and only those that the committed manifest names count, so
a lost, doubled or repeated task neither loses nor doubles a record.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: a package is closed when its archive has so many bytes or records
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 50_000
#: payloads of a task, about: there are as many tasks as that asks for
TASK_BYTES = 256 << 20
#: a digest or page that more than one of so many rows have is dealt out over SALTS tasks; there are HOT such at most
HOT, SALTS = 1_000, 64
#: rows that no digest or page is hot below, and bytes that a reader fetches at a time
LEAST_HOT, AHEAD = 500, 4 << 20
#: tasks that read packages, at most
READERS = 100_000
VERSION = b"WARC/1.1\r\n"
REFERS = "Lodestrata-Refers-To-Page"


# -- records --------------------------------------------------------------------------------------------------------


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def record_id(page_id, mark: str = "") -> str:
    """The name of a page's record; mark tells apart the records of a page that has several."""
    return f"<urn:lodestrata:page:{'null' if page_id is None else page_id}{':' if mark else ''}{mark}>"


def page_of(record: str | None) -> int | None:
    page = record.strip("<>").split(":")[3] if record else "null"
    return None if page == "null" else int(page)


def warc_record(page_id, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str, date: str = "1970-01-01T00:00:00Z", mark: str = "", named: bool = True) -> bytes:
    """mark: see record_id(). named: whether the record that a revisit refers to has its page's plain name; where its page has
    several records, the revisit tells the page in a field of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, mark)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(ch if ch > " " else "%20" for ch in url or "about:blank")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To" if named else REFERS, record_id(refers_to))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = lambda lines: dict(x.split(": ", 1) for x in lines if ": " in x)
    warc = fields(head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    if len(block) != int(warc["Content-Length"]):
        raise ValueError("a record ends early")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), payload


# -- packages -------------------------------------------------------------------------------------------------------


def write_package(out, records) -> int:
    """Write (page id, record bytes, type) from an iterator until a package is full; the number written."""
    index, at, n = [], 0, 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as member:
            for page_id, raw, kind in records:
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(raw) + packer.flush()
                member.write(data)
                index.append(f"{'null' if page_id is None else page_id} {json.dumps({'offset': at, 'length': len(data), 'type': kind})}\n")
                at, n = at + len(data), n + 1
                if at >= PACKAGE_BYTES or n >= PACKAGE_RECORDS:
                    break
        z.writestr(zipfile.ZipInfo(INDEX), "".join(index))
    return n


class Package:
    """Random-access reader of a package: f has size(), and read_at(number, offset)."""

    def __init__(self, size: int, read_at):
        self.read_at = read_at
        tail_size = min(size, 65_557)
        tail = read_at(tail_size, size - tail_size)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("not a ZIP file")
        n, length, start = struct.unpack_from("<HII", tail, end + 10)
        if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            where = size - tail_size + end - 20
            sign, _, at64, _ = struct.unpack("<4sIQI", read_at(20, where))
            if sign != b"PK\x06\x07":
                raise ValueError("the ZIP64 locator is missing")
            sign, n, length, start = struct.unpack("<4s28xQQQ", read_at(56, at64))
            if sign != b"PK\x06\x06":
                raise ValueError("the ZIP64 end record is missing")
        self.members = {}
        directory, at = read_at(length, start), 0
        for _ in range(n):
            sign, method, packed, plain, name_n, extra_n, note_n, local = struct.unpack_from("<4s6xH8xIIHHH8xI", directory, at)
            if sign != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            name = directory[at + 46 : at + 46 + name_n].decode()
            extra, k = directory[at + 46 + name_n : at + 46 + name_n + extra_n], 0
            while k + 4 <= len(extra):
                tag, m = struct.unpack_from("<HH", extra, k)
                if tag == 1:  # ZIP64: only the fields that overflow, in this order
                    values = iter(struct.unpack_from(f"<{m // 8}Q", extra, k + 4))
                    plain = next(values) if plain == 0xFFFFFFFF else plain
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    local = next(values) if local == 0xFFFFFFFF else local
                k += 4 + m
            self.members[name] = (method, packed, local)
            at += 46 + name_n + extra_n + note_n

    def locate(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's data in the package."""
        method, packed, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed")
        sign, name_n, extra_n = struct.unpack("<4s22xHH", self.read_at(30, local))
        if sign != b"PK\x03\x04":
            raise ValueError("a local header is damaged")
        return local + 30 + name_n + extra_n, packed

    def index(self) -> list[tuple[str, int, int, str]]:
        """(key, offset in the package, length, type) of all records."""
        base, _ = self.locate(ARCHIVE)
        at, n = self.locate(INDEX)
        rows = [line.split(" ", 1) for line in self.read_at(n, at).decode().splitlines()]
        return [(k, base + e["offset"], e["length"], e["type"]) for k, e in ((k, json.loads(e)) for k, e in rows)]

    def record(self, offset: int, length: int) -> bytes:
        return zlib.decompress(self.read_at(length, offset), 31)


class Ahead:
    """read_at(number, offset) of a file by ranges of some megabytes: records that lie side by side come by one request."""

    def __init__(self, size: int, read_at):
        self.size, self.read_at, self.start, self.block = size, read_at, 0, b""

    def __call__(self, n: int, offset: int) -> bytes:
        at = offset - self.start
        if at < 0 or at + n > len(self.block):
            self.start, at = offset, 0
            self.block = self.read_at(min(max(n, AHEAD), self.size - offset), offset)
        return self.block[at : at + n]


# -- the operator ---------------------------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, uri: str, key: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """pages' key, url and payload, its SHA-1 (binary), refers_to (the smallest key of its equal payloads), several (whether the row's
    key is on several rows) and named (whether that of refers_to is on one only).

    refers_to is null for a response. Payloads shorter than `least` bytes are all responses. Rows with a null key
    revisit the smallest key of their group; where all keys of a group are null, or a row repeats the smallest key,
    they are responses, since nothing names another record.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), url.cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # one row for each page and digest, combined map-side; payloads stay where they are
    pairs = common.stash(rows.groupBy("page_id", "sha1").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("html").cast("long")).alias("size")), f"{uri}/pairs")
    total, size = pairs.agg(F.sum("n"), F.sum(F.col("n") * F.col("size"))).first()
    bound = max((total or 0) / HOT, LEAST_HOT)
    twins = pairs.groupBy("page_id").agg(F.sum("n").alias("m")).filter("m > 1").select(F.col("page_id").alias("twin"))
    firsts = pairs.filter(F.col("size") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).filter("n > 1 AND first IS NOT NULL")
    firsts = firsts.join(twins, firsts["first"] == twins["twin"], "left").select("sha1", "first", "n", F.col("twin").isNull().alias("named"))
    firsts = common.stash(firsts, f"{uri}/firsts")
    common_ones = firsts.filter(F.col("n") > bound)  # HOT digests at most
    rare = pairs.join(F.broadcast(common_ones.select("sha1")), "sha1", "left_anti").join(firsts.filter(F.col("n") <= bound).drop("n"), "sha1", "left")
    known = rare.unionByName(pairs.join(F.broadcast(common_ones.drop("n")), "sha1"))
    known = known.join(twins, known["page_id"].eqNullSafe(twins["twin"]), "left_semi").withColumn("several", F.lit(True)).unionByName(known.join(twins, known["page_id"].eqNullSafe(twins["twin"]), "left_anti").withColumn("several", F.lit(False)))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    told = common.stash(known.withColumn("refers_to", refers).filter("several OR refers_to IS NOT NULL").select("page_id", "sha1", "n", "refers_to", "several", F.coalesce("named", F.lit(True)).alias("named")), f"{uri}/told")

    # what is told of a page and payload that many rows share is copied to SALTS tasks, over which those rows are dealt
    hot = told.filter(F.col("n") > bound)  # HOT at most
    spread = told.withColumn("salt", F.explode(F.when(F.col("n") > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    hot = hot.select(F.col("page_id").alias("hot_id"), F.col("sha1").alias("hot_sha1"))
    rows = rows.join(F.broadcast(hot), rows["page_id"].eqNullSafe(hot["hot_id"]) & (rows["sha1"] == hot["hot_sha1"]), "left")
    rows = rows.withColumn("salt", F.when(F.col("hot_sha1").isNotNull(), (F.monotonically_increasing_id() % SALTS).cast("int")).otherwise(0)).drop("hot_id", "hot_sha1")
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_BYTES))
    by = ["page_id", "sha1", "salt"]
    left = rows.repartition(n, *by).alias("l")
    right = spread.repartition(n, *by).hint("shuffle_hash").alias("r")  # the small side is hashed: payloads are neither sorted nor held
    on = F.col("l.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("l.sha1") == F.col("r.sha1")) & (F.col("l.salt") == F.col("r.salt"))
    return left.join(right, on, "left").select("l.page_id", "url", "html", "l.sha1", "refers_to", F.coalesce("several", F.lit(False)).alias("several"), F.coalesce("named", F.lit(True)).alias("named"))


def write_archives(pages: DataFrame, uri: str, key: str = "page_id", html: str = "html", least: int = 0, date: str | None = None) -> DataFrame:
    """Write a record per row of pages to packages under uri; the manifest (file, records). No rows: an empty manifest.

    date: the records' WARC-Date (default: the time of the call). Rows that repeat a key have record names of their own.
    """
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        part = f"{task.partitionId():06d}-{task.taskAttemptId()}"

        def records():
            at = 0
            for batch in batches:
                for a, b in common.text_batches(batch, 2, 2_000_000):
                    for page, url, text, sha1, refers, several, named in zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns), strict=True):
                        revisit, at = refers is not None, at + 1
                        mark = f"{part}-{at}" if several or page is None else ""
                        yield page, warc_record(page, url, text.encode(), refers, revisit, base64.b32encode(sha1).decode(), date, mark, named), "revisit" if revisit else "response"

        rest, k = records(), 0
        while (first := next(rest, None)) is not None:
            name, n = f"{uri}/part-{part}-{k:04d}.wacz", [0]

            def write(out, first=first, n=n):
                n[0] = write_package(out, _with_first(first, rest))

            common.publish(name, write)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n[0]], pa.int64())], names=["file", "records"])
            k += 1

    return common.stash(mark_revisits(pages, uri, key, html, least).mapInArrow(work, "file string, records long"), f"{uri}/manifest")


def _with_first(first, rest):
    """first, then the rest one by one: that a full package stops asking must not close what is left (as `yield from` would)."""
    yield first
    for record in rest:
        yield record  # noqa: UP028


def read_archives(manifest: DataFrame, key: str = "page_id", payload: bool = False) -> DataFrame:
    """Read the packages back: key, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked.

    A response's bytes and digest are computed from its payload and must agree with its headers; a revisit's are those that
    its headers hold for the full payload, which is in the record that it refers to (its payload is null here).
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = common.open_fs(uri)
                with fs.open_input_file(path) as f:
                    package = Package(f.size(), Ahead(f.size(), f.read_at))
                    rows, held = [], 0
                    for _, offset, length, _ in sorted(package.index(), key=lambda r: r[1]):
                        warc, http, body = parse_record(package.record(offset, length))
                        kind, told = warc["WARC-Type"], warc["WARC-Payload-Digest"].partition(":")[2]
                        if kind == "response" and (digest32(body) != told or len(body) != int(http["Content-Length"])):
                            raise ValueError(f"a payload in {uri} differs from its digest")
                        rows.append((page_of(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], int(http["Content-Length"]), told, kind, page_of(warc.get("WARC-Refers-To") or warc.get(REFERS)), body.decode() if payload and kind == "response" else None))
                        held += len(body) if payload else 0
                        if len(rows) >= 5000 or held > 8_000_000:
                            yield _table(pa, rows, payload)
                            rows, held = [], 0
                    if rows:
                        yield _table(pa, rows, payload)

    schema = "k long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * payload
    n = min(max(1, manifest.count()), READERS)
    return manifest.select("file").repartition(n).mapInArrow(work, schema).withColumnRenamed("k", key)


def _table(pa, rows, payload):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()][: 6 + payload]
    names = ["k", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payload]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


ARCHIVES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    (('0x' || substr(h, 1 + (i // 4) * 5, 5))::BIGINT >> (5 * (3 - i % 4))::BIGINT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
