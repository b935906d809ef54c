"""Token ids in a compact binary format: canonical length-limited Huffman codes from global counts (operator 3).

Files, in ascending document order, one for each range of documents:

    "LSHF" | u16 version | u16 end id flag | u32 vocabulary | u32 block size | u64 documents | u64 ids | u64 blocks | u64 payload bytes
    code length of each id, u8 (zlib, preceded by its u32 size)
    document ids, i64 (zlib, preceded by its u32 size)
    ids per document, u64 (zlib, preceded by its u32 size)
    bit offset of every block of `block` ids, u64
    payload: the codes, most significant bit first

Codes are canonical, so that the lengths alone give them. Every block begins at a checkpoint and can be decoded by
itself; the decoder looks the next MAX_BITS bits up in a table (id and length) for many blocks side by side.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe_trie import byte_level
from .segment import PieceCache, cut, is_safe, ragged

MAGIC, MAX_BITS, BLOCK = b"LSHF", 18, 128
#: text of a task, about, and of a file: a file's codes are in memory while it is written
TASK_BYTES, FILE_BYTES = 256 << 20, 64 << 20
HEADER = "<4sHHIIQQQQ"
#: tasks that read files, at most
READERS = 100_000


# -- codes ----------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.int64)
    n = len(order)
    # level by level, the merged list of leaves and packages; remembers which entries are leaves
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        levels.append(rank < n)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = 0
    for bits in range(1, MAX_BITS + 1):
        code <<= 1
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = code + np.arange(len(ids), dtype=np.uint32)
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for each value of the next MAX_BITS bits."""
    ids, sizes = np.zeros(1 << MAX_BITS, np.int32), np.zeros(1 << MAX_BITS, np.uint8)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = np.int64(1) << (MAX_BITS - lengths[used].astype(np.int64))
    at = codes[used].astype(np.int64) << (MAX_BITS - lengths[used].astype(np.int64))
    where = np.repeat(at - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
    ids[where] = np.repeat(used, span)
    sizes[where] = np.repeat(lengths[used], span)
    return ids, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, bytes]:
    """(bit offset of each block, payload)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    start = end - size
    words = np.zeros(total // 32 + 3, np.uint32)
    step = 1 << 20
    for a in range(0, len(ids), step):
        s, k = start[a : a + step], size[a : a + step]
        base = int(s[0]) >> 5
        at = (s >> 5) - base
        shifted = codes[ids[a : a + step]].astype(np.uint64) << (64 - (s & 31) - k).astype(np.uint64)
        n = int(at[-1]) + 2
        # codes never overlap, so the sum of the parts in a word is their union and stays below 2**32
        high = np.bincount(at, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n)
        low = np.bincount(at + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
        words[base : base + n] |= high.astype(np.uint32) | low.astype(np.uint32)
    return start[::block].astype(np.uint64), words.astype(">u4").tobytes()[: (total + 7) // 8]


def unpack(payload: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], block: int = BLOCK) -> np.ndarray:
    """The n ids of the blocks that begin at `offsets` (bits in payload); all blocks but the last are full."""
    ids, sizes = table
    out = np.empty((len(offsets), block), np.int32)
    pad = np.frombuffer(payload + bytes(16), np.uint8)
    # 32 bits from every byte on: enough for a code that begins at any bit of it
    wide = pad[:-3].astype(np.uint32) << 24
    wide |= pad[1:-2].astype(np.uint32) << 16
    wide |= pad[2:-1].astype(np.uint32) << 8
    wide |= pad[3:]
    at, most = offsets.astype(np.int64), len(wide) - 1
    mask = (1 << MAX_BITS) - 1
    for k in range(block):
        peek = (wide[np.minimum(at >> 3, most)] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32)) & mask
        out[:, k] = ids[peek]
        at += sizes[peek]
    return out.ravel()[:n]


# -- files ----------------------------------------------------------------------------------------------------------


def _zipped(a: np.ndarray) -> bytes:
    z = zlib.compress(a.tobytes(), 1)
    return struct.pack("<I", len(z)) + z


class TokenFile:
    """Reader of one file: `doc_ids`, `lengths`, and read(first, last) for the ids in a range, by its checkpoints."""

    def __init__(self, f):
        self.f = f
        head = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
        if head[0] != MAGIC:
            raise ValueError("not a token file")
        _, _, _, self.vocabulary, self.block, self.n_docs, self.n_ids, n_blocks, self.size = head
        part = lambda kind: np.frombuffer(zlib.decompress(f.read(struct.unpack("<I", f.read(4))[0])), kind)
        self.code_sizes, self.doc_ids, self.lengths = part(np.uint8), part("<i8"), part("<u8").astype(np.int64)
        self.offsets = np.frombuffer(f.read(8 * n_blocks), "<u8")
        self.at = f.tell()

    def read(self, first: int, last: int, table) -> np.ndarray:
        """Ids number first to last (not included), from the blocks that hold them alone."""
        if last <= first:
            return np.zeros(0, np.int32)
        a, b = first // self.block, (last - 1) // self.block + 1
        offsets = self.offsets[a:b].astype(np.int64)
        start = int(offsets[0]) // 8
        stop = int(self.offsets[b]) // 8 + 1 if b < len(self.offsets) else self.size
        self.f.seek(self.at + start)
        ids = unpack(self.f.read(min(stop, self.size) - start), offsets - start * 8, (b - a) * self.block, table, self.block)
        return ids[first - a * self.block : last - a * self.block]


# -- tokenising -----------------------------------------------------------------------------------------------------


class ByteBpe:
    """The tokenizers library's encoding of many texts; its model runs once for each distinct piece."""

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cache = PieceCache()

    def _fresh(self, words):
        run = self.tokenizer.model.tokenize
        return [[t.id for t in run(byte_level(w))] for w in words], None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        ok = is_safe(texts, self.specials)
        if ok.all():
            pieces = cut(texts, words=False)
            ids, lengths = self.cache.ids(self.cache.find(pieces, self._fresh))
            return ids, np.diff(ragged(ids, lengths, pieces.doc, len(texts)), prepend=0)
        out: list = [None] * len(texts)
        good = np.flatnonzero(ok)
        if len(good):
            ids, lengths = self.encode([texts[i] for i in good])
            for i, x in zip(good.tolist(), np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = x
        for i in np.flatnonzero(~ok).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate([*out, np.zeros(0, np.int32)]).astype(np.int32), np.array([len(x) for x in out], np.int64)


@functools.lru_cache(maxsize=1)
def byte_bpe(spec: str) -> ByteBpe:
    return ByteBpe(spec)


def _with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> np.ndarray:
    """ids with end_id after each document."""
    out = np.full(len(ids) + len(lengths), end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lengths + 1) - 1] = False
    out[keep] = ids
    return out


# -- the operator ---------------------------------------------------------------------------------------------------

SPOOL = "<Q"


def write_tokens(df: DataFrame, spec: str, uri: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append end_id to each document, and write all ids in ascending order of key to files under uri.

    Returns the manifest: file, first (number of ids in all files before), docs, ids. Null texts count as empty (the
    end id alone); a null key is stored as the least long and sorts first; rows with equal keys are all kept, in
    order of their texts' hashes, then of the texts. No rows: no files and an empty manifest.

    One shuffle deals the texts by ranges of key and hash, so that a key of many rows is split, in as many tasks as the input's
    size asks for. Each task tokenises its range into spool files of FILE_BYTES of text in the shared folder
    and returns its counts of ids; the driver gets one row per distinct id (bounded by the vocabulary) and one per
    file. With the code lengths, a second pass turns each spool file into a token file. Files appear whole, by rename, under
    names that hold the task's attempt; those of attempts that the committed counts do not name are never read.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-common.input_bytes(df) // TASK_BYTES))
    rows = rows.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")

    def spool(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bpe = byte_bpe(shared.value)
        task = TaskContext.get()
        total = np.zeros(0, np.int64)

        def parts():
            for batch in batches:
                for a, b in common.text_batches(batch, 1):
                    yield batch.slice(a, b - a)

        rest, k = parts(), 0
        while (first := next(rest, None)) is not None:
            keys, sizes, counts = [], [], np.zeros(0, np.int64)

            def write(out, first=first, keys=keys, sizes=sizes):
                nonlocal counts
                import zstandard

                packer, held = zstandard.ZstdCompressor(level=1), 0
                for part in _chained(first, rest):
                    ids, lengths = bpe.encode(part.column(1).to_pylist())
                    keys.append(part.column(0).to_numpy())
                    sizes.append(lengths + 1)
                    ids = _with_end(ids, lengths, end_id)
                    seen = np.bincount(ids, minlength=len(counts))
                    seen[: len(counts)] += counts
                    counts = seen
                    raw = ids.astype("<u2" if ids.max(initial=0) < 65536 else "<u4")
                    z = packer.compress(raw.tobytes())
                    out.write(struct.pack(SPOOL, len(z) << 1 | (raw.itemsize == 4)) + z)
                    held += part.column(1).nbytes
                    if held >= FILE_BYTES:
                        break
                out.write(struct.pack(SPOOL, 0))
                for a in (keys, sizes):
                    z = zlib.compress(np.concatenate([*a, np.zeros(0, np.int64)]).astype("<i8").tobytes(), 1)
                    out.write(struct.pack(SPOOL, len(z)) + z)

            name = f"{task.partitionId():06d}-{k:06d}-{task.taskAttemptId()}"
            common.publish(f"{uri}/spool/{name}", write)
            if len(counts) > len(total):
                total = np.concatenate([total, np.zeros(len(counts) - len(total), np.int64)])
            total[: len(counts)] += counts
            k += 1
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([name]), pa.array([sum(map(len, keys))], pa.int64())], names=["id", "n", "part", "docs"])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64()), pa.nulls(len(used), pa.string()), pa.nulls(len(used), pa.int64())], names=["id", "n", "part", "docs"])

    told = common.stash(rows.mapInArrow(spool, "id long, n long, part string, docs long"), f"{uri}/told")  # the committed attempts' files
    told = told.groupBy("id", "part").agg(F.sum("n").alias("n"), F.max("docs").alias("docs"))
    found = told.toPandas()  # a row for each id of the vocabulary that occurs, and for each file
    by_id = found[found["id"].notna()]
    counts = np.zeros(int(by_id["id"].max()) + 1 if len(by_id) else 0, np.int64)
    counts[by_id["id"].astype(int)] = by_id["n"]
    sizes = spark.sparkContext.broadcast(code_lengths(counts))
    files = found[found["part"].notna()].sort_values("part")
    manifest = [(f"{uri}/ids/{p}.lshf", f"{uri}/spool/{p}", int(d), int(m)) for p, d, m in zip(files["part"], files["docs"], files["n"], strict=True)]

    def encode(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            for target, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = common.open_fs(source)
                if not common.exists(target):
                    with fs.open_input_stream(path) as f:
                        common.publish(target, lambda out, f=f: _transcode(f, out, sizes.value))
                if common.exists(source):
                    fs.delete_file(path)
                yield pa.RecordBatch.from_arrays([pa.array([target])], names=["file"])

    if manifest:
        spark.createDataFrame(manifest, "file string, spool string, docs long, ids long").repartition(len(manifest)).mapInArrow(encode, "file string").agg(F.count("*")).collect()
    starts = np.cumsum([0, *(m[3] for m in manifest)]).tolist()
    return spark.createDataFrame([(m[0], s, m[2], m[3]) for m, s in zip(manifest, starts, strict=False)], "file string, first long, docs long, ids long")


def _chained(first, rest):
    yield first
    yield from rest


def _transcode(f, out, code_sizes) -> None:
    """A spool file to a token file. The codes are held in memory: those of FILE_BYTES of text, or of one longer text."""
    import zstandard

    opener = zstandard.ZstdDecompressor()
    offsets, payload, bits, left = [], [], 0, np.zeros(0, np.int32)
    codes = canonical(code_sizes)
    while True:
        head = struct.unpack(SPOOL, f.read(8))[0]
        if head:
            raw = np.frombuffer(opener.decompress(f.read(head >> 1)), "<u4" if head & 1 else "<u2").astype(np.int32)
            left = np.concatenate([left, raw])
        full = len(left) if not head else len(left) // BLOCK * BLOCK
        if full:
            o, p = pack(left[:full], codes, code_sizes)
            offsets.append(o + np.uint64(bits))
            payload.append(p)
            bits += len(p) * 8  # the next blocks begin at a byte
            left = left[full:]
        if not head:
            break
    doc_ids, lengths = (np.frombuffer(zlib.decompress(f.read(struct.unpack(SPOOL, f.read(8))[0])), "<i8") for _ in range(2))
    offsets = np.concatenate(offsets) if offsets else np.zeros(0, np.uint64)
    out.write(struct.pack(HEADER, MAGIC, 1, 1, len(code_sizes), BLOCK, len(doc_ids), int(lengths.sum()), len(offsets), sum(map(len, payload))))
    for a in (code_sizes, doc_ids, lengths.astype("<u8")):
        out.write(_zipped(np.ascontiguousarray(a)))
    out.write(offsets.astype("<u8").tobytes())
    for p in payload:
        out.write(p)


@functools.lru_cache(maxsize=2)
def _table_of(code_sizes: bytes):
    return decode_table(np.frombuffer(code_sizes, np.uint8))


def read_tokens(manifest: DataFrame, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Read the files back: key, start (ids of all documents before), n_tokens, ids_crc32, and the ids if keep_ids."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = common.open_fs(uri)
                with fs.open_input_file(path) as f:
                    t = TokenFile(f)
                    table = _table_of(t.code_sizes.tobytes())
                    ends = np.cumsum(t.lengths)
                    a = 0
                    while a < t.n_docs:  # documents with about a million ids at a time
                        first = int(ends[a] - t.lengths[a])
                        b = max(a + 1, int(np.searchsorted(ends, first + 1_000_000, "right")))
                        ids = t.read(first, int(ends[b - 1]), table)
                        raw = ids.astype("<u4").tobytes()
                        edges = (np.concatenate([[first], ends[a:b]]) - first).tolist()
                        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges, edges[1:], strict=False)]
                        columns = [pa.array(t.doc_ids[a:b]), pa.array(base + ends[a:b] - t.lengths[a:b]), pa.array(t.lengths[a:b]), pa.array(crc, pa.int64())]
                        if keep_ids:
                            columns.append(pa.array([ids[x:y].tolist() for x, y in zip(edges, edges[1:], strict=False)], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(columns, names=["k", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                        a = b

    schema = "k long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    files = manifest.select("file", "first")
    found = files.repartition(min(max(1, files.count()), READERS)).mapInArrow(work, schema)
    return found.withColumn("k", F.when(F.col("k") != F.lit(-(2**63)), F.col("k"))).withColumnRenamed("k", key)


def token_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
