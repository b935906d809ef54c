"""Near-duplicates by BagMinHash signatures of shingle multisets (operator 10).

A text's multiset holds its five-word shingles with their counts. Weights are discretised at the integers; each shingle
has a hierarchy of Poisson processes over its weight: one over (0, 1], (1, 2], (2, 4], (4, 8] and so on, each of
which splits down to unit weights by the bits of its points. A point has a time, a component and a weight level; a
text of weight w has the points whose level lies below w. A signature component is the time of its first point: two
texts agree in it with the probability of their weighted Jaccard similarity, without bias. Points are made in order
of time and only up to a horizon by which all components have one, so the cost is about that of reading the shingles.

Texts that share a band of components are candidates; pairs are verified on the whole multisets. Distinct texts are
compared by their normalised form's digest; copies are members of their class. In each bucket all texts are compared
with one leader, the one that meets most others; where verified links do not join a whole bucket, its texts outside
the leader's class are compared with all texts of other classes that share a rare unit of their prefixes, which
every pair of that similarity does. So no link between texts of a bucket can join classes unseen, and a bucket of many
copies is not paired out.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 26, 5
SIZE = BANDS * ROWS
#: so many digests (about 50 bytes each as a broadcast table, so 10 MB) are sent to all tasks at most; more are joined by a shuffle
BROADCAST_ROWS = 200_000
#: bytes or words whose wide arrays are in memory at a time
WINDOW = 1 << 19
#: rows of a bucket for each copy of its leader's text
SPREAD = 4_096
U = np.uint64


def normal(text: str | Column) -> Column:
    """Lower case, words separated by one blank; null counts as empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(t), r"[ \t\n\x0B\f\r]+", " "))


# -- multisets ------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, end) of the words of raw, which ends in a blank. A window at a time, whatever the length of a word."""
    hashes, ends, carried, begun = [], [], np.zeros(1, U), 0
    for a in range(0, len(raw), WINDOW):
        part = raw[a : a + WINDOW]
        blank = part == 32
        stop = np.flatnonzero(blank)
        # the place of each byte within its word, which may have begun before the window
        start = np.concatenate([[begun], stop + a + 1])
        lengths = np.diff(np.concatenate([[0], stop + 1, [len(part)]]))
        place = np.arange(a, a + len(part)) - np.repeat(start, lengths)
        mixed = _mix((part.astype(U) << U(40)) + place.astype(U) + U(0x9E3779B97F4A7C15))
        mixed[blank] = 0
        total = np.concatenate([np.zeros(1, U), np.cumsum(mixed, dtype=U)])
        sums = total[stop] - total[start[:-1].clip(a) - a]
        if len(stop):
            sums[:1] += carried
            begun = int(start[-1])
            carried = total[-1:] - total[begun - a : begun - a + 1]
        else:
            carried = carried + total[-1:]
        real = stop + a > start[:-1]
        hashes.append(_mix(sums[real]))
        ends.append(stop[real] + a)
    return np.concatenate(hashes), np.concatenate(ends)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles, number of shingles of each text). Fewer words than five make one shingle; none, none."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(raw):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    word, ends = _words(raw)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), ends, "left")
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    padded = np.concatenate([word, np.zeros(WORDS, U)])
    out, n_shingles = [], np.zeros(len(texts), np.int64)
    for a in range(0, len(word), WINDOW):
        own = doc[a : a + WINDOW]
        place_in = np.arange(a, a + len(own)) - first[own]
        # the words of a shingle, mixed with their places; a text of fewer words has those alone
        part = np.zeros(len(own), U)
        for k in range(WORDS):
            inside = place_in + k < n_words[own]
            part += np.where(inside, _mix(padded[a + k : a + k + len(own)] + U((k + 1) * 0xD6E8FEB86659FD93 % 2**64)), U(0))
        keep = (place_in + WORDS <= n_words[own]) | (place_in == 0)
        out.append(_mix(part[keep]))
        n_shingles += np.bincount(own[keep], minlength=len(texts))
    return np.concatenate([*out, np.zeros(0, U)]), n_shingles


def bags(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles of each text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(hashes)))


def jaccard(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two normalised texts; 1 if neither has words."""
    hashes, counts = shingles([a, b])
    doc, h, w = bags(hashes, counts)
    total = int(w.sum())
    if not total:
        return 1.0
    left, right = h[doc == 0], h[doc == 1]
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    both = int(np.minimum(w[doc == 0][i], w[doc == 1][j]).sum())
    return both / (total - both)


# -- signatures -----------------------------------------------------------------------------------------------------


def signatures(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures (first times) by text and component; infinite for texts without shingles."""
    sig = np.full(n_docs * size, np.inf)
    # processes: for each shingle and each dyadic block of weight levels that its weight reaches
    parts = [(doc, hashes, weights, np.zeros(len(doc), np.int64), 0)]
    low, k = 1, 1
    while len(own := np.flatnonzero(weights > low)):
        parts.append((doc[own], hashes[own], weights[own], np.full(len(own), low), k))
        low, k = low * 2, k + 1
    p_doc = np.concatenate([p[0] for p in parts])
    seed = np.concatenate([_mix(p[1] + U((p[4] + 1) * 0xA24BAED4963EE407 % 2**64)) for p in parts])
    span = np.concatenate([np.maximum(p[3], 1) for p in parts]).astype(np.float64)
    room = np.concatenate([p[2] - p[3] for p in parts])  # levels of the block that lie below the weight
    total = np.bincount(doc, weights=weights, minlength=n_docs)
    horizon = size * (np.log(size) + 2) / np.maximum(total, 1)
    t, step = np.zeros(len(p_doc)), np.zeros(len(p_doc), np.int64)
    active = np.arange(len(p_doc))
    live = total > 0
    while True:
        while len(active):
            c = int(np.clip(100_000 // len(active), 1, 64))
            n = step[active][:, None] + np.arange(1, c + 1)
            h = _mix(seed[active][:, None] + n.astype(U) * U(0x9E3779B97F4A7C15))
            u = ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
            gaps = -np.log(u) / span[active][:, None]
            gaps[:, 0] += t[active]
            times = np.cumsum(gaps, axis=1)
            inside = times <= horizon[p_doc[active]][:, None]
            g = _mix(h ^ U(0x5851F42D4C957F2D))
            component = ((g & U(0xFFFFFFFF)) * U(size)) >> U(32)
            # the point's weight level: each bit splits the block's interval once more
            level = (g >> U(32)) % span[active].astype(U)[:, None]
            good = inside & (level < room[active].astype(U)[:, None])
            at = (p_doc[active][:, None] * size + component.astype(np.int64))[good]
            np.minimum.at(sig, at, times[good])
            # a process goes on behind its last point within the horizon; the next is made again when it is needed
            n_in = inside.sum(axis=1)
            moved = np.flatnonzero(n_in)
            t[active[moved]] = times[moved, n_in[moved] - 1]
            step[active[moved]] += n_in[moved]
            active = active[n_in == c]
        live &= ~np.isfinite(sig.reshape(n_docs, size)).all(axis=1)
        if not live.any():
            return sig.reshape(n_docs, size)
        horizon[live] *= 1.4
        active = np.flatnonzero(live[p_doc])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=U), (len(sig), 1))
    for r in range(ROWS):
        key = _mix(key * U(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key


def _sign(batches):
    import pyarrow as pa

    for batch in batches:
        for a, b in common.text_batches(batch, 1):
            texts = batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist()
            hashes, counts = shingles(texts)
            sig = signatures(*bags(hashes, counts), len(texts))
            keys = band_keys(sig).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            some = counts > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), lists], names=["node", "n", "bands"]).filter(pa.array(some))


@functools.lru_cache(maxsize=64)
def _bag(text: bytes):
    hashes, counts = shingles([text])
    _, h, w = bags(hashes, counts)
    return h, w


def _similarity(batches):
    import pyarrow as pa

    for batch in batches:
        for a, b in common.text_batches(batch, 3):
            part = batch.slice(a, b - a)
            out = []
            for x, y in zip(part.column(2).cast(pa.binary()).to_pylist(), part.column(3).cast(pa.binary()).to_pylist(), strict=True):
                (h1, w1), (h2, w2) = _bag(x), _bag(y)
                _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
                both = int(np.minimum(w1[i], w2[j]).sum())
                out.append(both / max(1, int(w1.sum()) + int(w2.sum()) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.float64())], names=["a", "b", "s"])


# -- classes --------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, uri: str) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the least node that each is joined to. Labels halve their distance in each
    round by a jump to the label's label; every round is a table in the shared folder."""
    both = common.stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{uri}/both")
    labels = common.stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{uri}/0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = common.stash(low.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")), f"{uri}/{k}")
        changed = new.filter("label != old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, s) with the similarity of the two texts of each pair. pairs: a, b and copies, the number of copies of a's text that its pairs
    are dealt out over."""
    left = texts.select(F.col("node").alias("a"), F.col("norm").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("norm").alias("y"))
    dealt = pairs.withColumn("copy", F.pmod(F.xxhash64("b"), "copies").cast("int"))
    heads = pairs.select("a", "copies").distinct().join(left, "a").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return dealt.join(right, "b").join(heads, ["a", "copies", "copy"]).select("a", "b", "x", "y").mapInArrow(_similarity, "a binary, b binary, s double")


def _texts(base: DataFrame, nodes: DataFrame, uri: str) -> DataFrame:
    """(node, norm), one row for each of the nodes."""
    n = nodes.count()
    few = F.broadcast(nodes) if n <= BROADCAST_ROWS else nodes
    return common.stash(base.join(few, "node", "left_semi").groupBy("node").agg(F.first("norm").alias("norm")), uri)


def _units(batches):
    import pyarrow as pa

    for batch in batches:
        for a, b in common.text_batches(batch, 1):
            texts = batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist()
            doc, h, w = bags(*shingles(texts))
            # the k-th copy of a shingle is a unit of its own, so that multisets become sets
            nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            units = _mix(np.repeat(h, w) + nth.astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=w, minlength=len(texts)).astype(np.int64))])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(units))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["node", "units"])


def _sharing_prefix(left: DataFrame, texts: DataFrame, similar: float, uri: str) -> DataFrame:
    """(a, b): pairs of the texts `left` (node, n, label, odd) in different classes, one of them odd, that can be similar.

    In any order of all units, two sets of that similarity share one of their first n - ceil(similar * n) + 1. With rare
    units first, texts that were changed in many places have only units of their own there, and meet nobody.
    """
    units = texts.join(left.select("node"), "node", "left_semi").mapInArrow(_units, "node binary, units array<long>")
    rows = common.stash(units.select("node", F.size("units").alias("n"), F.explode("units").alias("u")), f"{uri}/units")
    counts = rows.groupBy("u").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    first = (F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1).cast("int")
    ranked = rows.join(counts, "u", "left").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "u"))).alias("us"))
    prefix = ranked.select("node", F.posexplode(F.slice("us", F.lit(1), first)).alias("p", "x")).filter("x.c > 1").select("node", "p", F.col("x.u").alias("u"))
    prefix = common.stash(prefix.join(left, "node"), f"{uri}/prefix")
    odd = prefix.filter("odd").select("u", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "label", "p")])
    # by their first common unit two similar sets have room behind it for all that they must share
    needed = F.ceil((F.col("n1") + F.col("n")) * (similar / (1 + similar)) - 1e-9)
    fits = (F.least(F.col("n1") - F.col("p1"), F.col("n") - F.col("p")) >= needed) & (F.col("label1") != F.col("label")) & (~F.col("odd") | (F.col("node1") < F.col("node"))) & (F.least("n", "n1") >= F.greatest("n", "n1") * similar - 1e-9)
    met = odd.join(prefix, "u").filter(fits)
    return met.select(F.least("node", "node1").alias("a"), F.greatest("node", "node1").alias("b")).distinct()


def classes(docs: DataFrame, uri: str, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of docs: key, class_id (the smallest key of its class), class_size, n_shingles, links, kept.

    Texts belong together if a chain of verified links (weighted Jaccard of five-word shingles at least `similar`) or
    equality after normal() joins them; null counts as empty, and texts without words form one class. links: the number
    of verified links of the row's distinct text. kept: the key is class_id. Null keys stay null and are never class_id unless all keys
    of the class are null; rows that repeat a key and a text are marked alike. Only key and text are read.
    """
    return _classes(docs, uri, key, text, similar).drop("node")


def node(text: str | Column) -> Column:
    """The digest by which classes() tells texts apart."""
    return F.unhex(F.md5(normal(text).cast("binary")))


def _classes(docs: DataFrame, uri: str, key: str, text: str, similar: float) -> DataFrame:
    """classes() with each row's node."""
    base = docs.select(F.col(key).cast("long").alias("id"), normal(text).alias("norm"), node(text).alias("node"))
    rows = common.stash(base.select("id", "node"), f"{uri}/rows")
    base = base.select("node", "norm")
    signed = common.stash(base.mapInArrow(_sign, "node binary, n long, bands array<long>").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands")), f"{uri}/signed")

    buckets = signed.select("node", "n", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = common.stash(buckets.join(sizes, "band"), f"{uri}/shared")
    # the leader is the text that meets most others, which is near the middle of its copies
    met = shared.groupBy("node").agg(F.sum("m").alias("met"))
    leaders = shared.join(met, "node").groupBy("band").agg(F.max_by("node", F.struct("met", "node")).alias("leader"))
    held = common.stash(shared.join(leaders, "band").select("band", "node", "n", "leader", "m"), f"{uri}/held")
    star = held.filter("node != leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg((F.max("m") / SPREAD + 1).cast("int").alias("copies"))
    star = common.stash(star, f"{uri}/star")
    texts = _texts(base, held.select("node").distinct(), f"{uri}/texts")
    seen = common.stash(_verify(star, texts), f"{uri}/seen")
    linked = seen.filter(F.col("s") >= similar)
    labels = components(linked, f"{uri}/cc1")

    # buckets that the links have not joined: texts outside the leader's class against those of other classes
    own = held.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    head = labels.select(F.col("node").alias("leader"), F.col("label").alias("head"))
    own = own.join(head, "leader", "left").withColumn("odd", F.col("label") != F.coalesce("head", "leader"))
    split = own.filter("odd").select("band").distinct()
    left = own.join(split, "band", "left_semi").groupBy("node", "n", "label").agg(F.max("odd").alias("odd"))
    left = common.stash(left, f"{uri}/left")
    pairs = _sharing_prefix(left, texts, similar, uri)
    pairs = pairs.join(seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = common.stash(_verify(common.stash(pairs.withColumn("copies", F.lit(1)), f"{uri}/pairs"), texts).filter(F.col("s") >= similar), f"{uri}/more")
    links = linked.unionByName(more)
    if more.limit(1).count():
        labels = components(links, f"{uri}/cc2")

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    found = labels.join(degree, "node", "left").join(signed.select("node", "n"), "node", "full").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"), "n")
    found = found.join(rows.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "node", "right").withColumn("label", F.coalesce("label", "node"))
    found = common.stash(found, f"{uri}/found")
    whole = found.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    by_node = common.stash(found.join(whole, "label").select("node", "class_id", "class_size", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), f"{uri}/classes")
    return rows.join(by_node, "node").select("node", F.col("id").alias(key), "class_id", "class_size", "n_shingles", "links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, uri: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one document of each class, all columns.

    A row goes by its text and its key together: the same key on a text of another class, and null keys there, stay.
    """
    gone = _classes(docs, uri, key, text, SIMILAR).filter("not kept").select(F.col("node").alias("__node"), F.col(key).alias("__gone")).distinct()
    gone = common.stash(gone, f"{uri}/gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, (node(text) == F.col("__node")) & F.col(key).cast("long").eqNullSafe(F.col("__gone")), "left_anti")
