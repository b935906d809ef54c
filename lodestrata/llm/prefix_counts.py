"""Token counts by prefix dynamic programming (operator 13).

The encoding of a prefix ends in exactly one token t: the one that BPE leaves beside the last token of the shorter
prefix before it. So the count at a prefix is the count before t plus one, and one pass from left to right gives the
exact count at every prefix. The counts are stored, as steps from character to character in blocks of bounded size;
totals, budgets and truncations are read from them without encoding a text again.

Two characters that no vocabulary piece holds side by side are never merged, so a text is cut there first and the pass is
made once for each distinct piece of a batch, in a bounded cache. Rows never move; long texts are taken in parts.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, text_batches
from .segment import PieceCache, Pieces, _hashes, _windows

BLANK = "▁"
#: characters of a stored block, and of the part of a long text that is worked on at a time
BLOCK, PART = 1 << 16, 1 << 22


class PrefixCounter:
    """Counts for a sentencepiece BPE model that leaves texts as they are but for its mark for blanks, one of them put before the text."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)  # for the vocabulary and its settings only
        if library.normalize(" a  Åﬁ") != f"{BLANK}{BLANK}a{BLANK}{BLANK}Åﬁ":
            raise ValueError("the model rewrites texts; only one that keeps them, with a blank before, is counted here")
        n = library.get_piece_size()
        if not any(library.is_byte(i) for i in range(n)):
            raise ValueError("the model has no bytes to fall back on")
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
        if any(library.is_unused(i) for i in plain):
            raise ValueError("the model has unused pieces")
        score = {library.id_to_piece(i): library.get_score(i) for i in plain}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        #: of each piece, when its merge comes; equal ones come from left to right
        self.rank = {p: order[s] for p, s in score.items()}
        chars = sorted({c for p in self.rank for c in p})
        #: tokens of each symbol that is no piece: its bytes
        self.bytes = {c: len(c.encode()) for c in chars if c not in self.rank}
        self.sizes: dict[str, list[int]] = {}
        tails: dict[str, set[int]] = {}
        for p in [*self.rank, *self.bytes]:
            tails.setdefault(p[-2:], set()).add(len(p))
        for tail in tails:
            self.sizes[tail] = sorted({k for c in range(len(tail)) for k in tails.get(tail[c:], ())}, reverse=True)
        self.kind = np.zeros(max(map(ord, chars)) + 2, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.rank:
            k = self.kind[[ord(c) for c in p]]
            self.joined[k[:-1], k[1:]] = True
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache = PieceCache()

    def split(self, token: str) -> tuple[str, str] | None:
        """The last merge of the token's own encoding; ('', '') of a single symbol, None if that encoding is not the token alone."""
        known = self.halves.get(token, 0)
        if known == 0:
            parts, made = list(token), ("", "")
            while len(parts) > 1:
                best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
                if best is None:
                    break
                i = best[1]
                made = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.halves[token] = made if len(parts) == 1 else None
        return known

    def adjacent(self, left: str, right: str) -> bool:
        """Whether BPE leaves the two tokens beside each other.

        Goes back in time: at each moment the later of the two sides' merges is undone, and a merge across the border
        must not have come before it.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            never, until = len(self.rank), len(self.rank) + 1
            while True:
                if self.rank.get(left + right, until) < until:
                    known = False
                    break
                a = self.rank[left] if len(left) > 1 else -1
                b = self.rank[right] if len(right) > 1 else -1
                if a == b == -1:
                    known = True
                    break
                if a > b:
                    until, left = a, self.split(left)[1]
                else:
                    until, right = min(b + 1, never), self.split(right)[0]
            self.fits[key] = known
        return known

    def steps(self, piece: str) -> list[int]:
        """What each character adds to the count of the prefix before it; below zero where it lets tokens merge."""
        rank, fits, n = self.rank, self.fits, len(piece)
        last, counts = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for k in self.sizes.get(piece[max(0, i - 2) : i]) or self.sizes.get(piece[i - 1], ()):
                if k > i:
                    continue
                token = piece[i - k : i]
                if token not in rank and token not in self.bytes or self.split(token) is None:
                    continue
                if k < i:
                    before = last[i - k]
                    ok = fits.get((before, token))
                    if not (self.adjacent(before, token) if ok is None else ok):
                        continue
                last[i], counts[i] = token, counts[i - k] + self.bytes.get(token, 1)
                break
            else:
                if n > 1:
                    raise AssertionError(f"no token ends at {i} of {piece!r}")
                counts[i] = len(piece.encode())
        return [b - a for a, b in zip(counts, counts[1:], strict=False)]

    def _fresh(self, pieces: list[str]):
        return [self.steps(p) for p in pieces], None

    def _begins(self, points: np.ndarray) -> np.ndarray:
        """Where a piece begins, by the characters alone."""
        out = np.ones(len(points), bool)
        for a, b in _windows(len(points)):
            kinds = self.kind[np.minimum(points[max(0, a - 1) : b], len(self.kind) - 1)]
            out[max(1, a) : b] = ~self.joined[kinds[:-1], kinds[1:]]
        return out

    def _counted(self, text: str, firsts: np.ndarray, final: bool = True) -> np.ndarray:
        """Steps of the characters of marked texts put together; firsts: where each begins. Not final: up to the last place where a piece begins."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = self._begins(points)
        begins[firsts] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(points))
        if not final:
            start, end = start[:-1], end[:-1]
        pieces = Pieces(text, points, start, end, _hashes(points, start, end), None)
        return self.cache.ids(self.cache.find(pieces, self._fresh))[0]

    def parts(self, texts: list[str]):
        """(number of the text, its next steps, whether they are its last), in order. Empty texts have no steps."""
        short = [t for t in texts if 0 < len(t) <= PART]
        marked = [BLANK + t.replace(" ", BLANK) for t in short]
        lengths = np.array([len(t) for t in marked], np.int64)
        firsts = np.cumsum(lengths) - lengths
        steps = self._counted("".join(marked), firsts) if marked else None
        k = 0
        for i, t in enumerate(texts):
            if not t:
                yield i, np.zeros(0, np.int32), True
            elif len(t) <= PART:
                own = steps[firsts[k] : firsts[k] + lengths[k]]
                k += 1
                yield i, np.append(own[0] + own[1], own[2:]), True
            else:
                yield from ((i, s, final) for s, final in self._long(t))

    def _long(self, text: str):
        at, part, first = 0, BLANK, True
        while True:
            taken = text[at : at + PART]
            at += len(taken)
            part, final = part + taken.replace(" ", BLANK), at >= len(text)
            steps = self._counted(part, np.zeros(1, np.int64), final)
            if first and len(steps) > 1:
                yield np.append(steps[0] + steps[1], steps[2:]), final
                first, part = False, part[len(steps) :]
            elif not first:
                yield steps, final
                part = part[len(steps) :]
            if final:
                return


@functools.lru_cache(maxsize=1)
def counter(model: bytes) -> PrefixCounter:
    return PrefixCounter(model)


def packed(steps: np.ndarray) -> bytes:
    """In the narrowest of 1, 2 and 4 bytes that holds each step."""
    for kind in (np.int8, np.int16):
        if not len(steps) or np.iinfo(kind).min <= steps.min() and steps.max() <= np.iinfo(kind).max:
            return steps.astype(kind).tobytes()
    return steps.astype("<i4").tobytes()


def unpacked(steps: bytes, n: int) -> np.ndarray:
    return np.frombuffer(steps, {1: np.int8, 2: "<i2", 4: "<i4"}[len(steps) // n] if n else np.int8).astype(np.int64)


def prefix_table(df: DataFrame, path: str, uri: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count, by the model file at `path`, every prefix of every text, and store the counts under `uri`.

    A row for each block of a row's text: its key, `row` (a number of the row), n_bytes of the text (UTF-8), chars and tokens
    before the block, n_chars and end_tokens of it, steps, and whether it is the text's last. Null texts count as empty; an empty
    text has one empty block. Rows with equal or null keys each have blocks of their own; other columns are not read.
    """
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, df.schema[key].dataType)]).add("n_bytes", "long").add("block", "integer").add("chars", "long").add("tokens", "long")
    schema = schema.add("n_chars", "integer").add("end_tokens", "long").add("steps", "binary").add("last", "boolean")

    def blocks(count, texts):
        where = (-1, 0, 0, 0)
        for i, steps, final in count.parts(texts):
            block, chars, tokens = where[1:] if where[0] == i else (0, 0, 0)
            for a in range(0, max(1, len(steps)), BLOCK):
                own = steps[a : a + BLOCK]
                end = tokens + int(own.sum())
                yield i, block, chars, tokens, len(own), end, packed(own), final and a + BLOCK >= len(steps)
                block, chars, tokens = block + 1, chars + len(own), end
            where = (i, block, chars, tokens)

    def work(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        count = counter(shared.value)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
        for batch in batches:
            for a, b in text_batches(batch, 2):
                own = batch.slice(a, b - a)
                rows = list(zip(*blocks(count, own.column(2).to_pylist()), strict=True))
                at = pa.array(rows[0], pa.int64())
                sizes = pc.cast(pc.binary_length(own.column(2)), pa.int64())
                columns = [own.column(0).take(at), own.column(1).take(at), sizes.take(at), *(pa.array(r, k) for r, k in zip(rows[1:], kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    return stash(rows.mapInArrow(work, schema), uri)


def totals(table: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Of each text: key, n_bytes, n_tokens, and whether it has more tokens than limit."""
    return table.filter("last").select(key, "n_bytes", F.col("end_tokens").alias("n_tokens"), (F.col("end_tokens") > limit).alias("over_limit"))


def truncated(table: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """Of each text the longest prefix of at most budget (0 or more) tokens: row, key, n_chars, n_tokens. A block is decoded where it can hold the answer only."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for chars, tokens, n, steps in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                counts = tokens + np.cumsum(unpacked(steps, n))
                within = np.flatnonzero(counts <= budget)
                out.append((chars + int(within[-1]) + 1, int(counts[within[-1]])) if len(within) else (0, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in out], pa.int64()), pa.array([t for _, t in out], pa.int64())], names=["row", key, "n_chars", "n_tokens"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, table.schema[key].dataType)]).add("n_chars", "long").add("n_tokens", "long")
    whole = F.col("end_tokens") <= budget
    done = table.filter(whole).select("row", key, (F.col("chars") + F.col("n_chars")).alias("n_chars"), F.col("end_tokens").alias("n_tokens"))
    rest = table.filter(~whole).select("row", key, "chars", "tokens", "n_chars", "steps").mapInArrow(work, schema)
    best = F.max(F.struct("n_chars", "n_tokens")).alias("best")
    return done.unionByName(rest).groupBy("row", key).agg(best).select("row", key, "best.n_chars", "best.n_tokens")


def tokens_at(table: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Of each text the count of its first n characters, of the whole text if it is shorter: row, key, n_chars, n_tokens."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for chars, tokens, held, steps in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                found.append(tokens + int(unpacked(steps, held)[: n - chars].sum()))
            lengths = pa.array([min(n, c + h) for c, h in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lengths, pa.array(found, pa.int64())], names=["row", key, "n_chars", "n_tokens"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, table.schema[key].dataType)]).add("n_chars", "long").add("n_tokens", "long")
    end = F.col("chars") + F.col("n_chars")
    asked = (F.col("chars") <= n) & ((end > n) | F.col("last"))
    return table.filter(asked).select("row", key, "chars", "tokens", "n_chars", "steps").mapInArrow(work, schema)
