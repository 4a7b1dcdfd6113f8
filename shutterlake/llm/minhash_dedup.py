"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Documents become multisets of hashed five-word shingles.  A shingle weighs its
   count times a damped inverse document frequency: 1 up to a share ``common`` of
   all documents, from there falling with the logarithm of the share to ``floor``.
   The floor keeps a large group of copies from thinning out what makes it alike.
   Frequent shingles come from lossy counting over all documents.
2. Each document gets ``bands * rows`` weighted samples; two documents agree in a
   sample with a probability that is their weighted Jaccard similarity.
3. Documents that agree in a whole band share a bucket.  Each text's multiset goes
   once to each of its buckets (buckets of the same texts count once), and a bucket
   is settled where its sets are: all links between its members are found, and as
   many given back as join its classes.  A bucket beyond ``cell_bytes`` is dealt
   over cells that hold two of its blocks each, so that each pair of its members
   still meets and no task holds more than one cell.
4. Inside a cell, sets are held as differences from what most of them have (their
   frequent shingles), or as they are if that is shorter.  A member outside the
   cell's largest class is held against the members with which it shares a part
   of its difference, through an inverted index, or whose differences are so small
   that they need share none.  The similarity that decides is the exact weighted
   Jaccard similarity of the two multisets: with ``L`` the sum of absolute weight
   differences and ``S`` the sum of both weights, it is (S - L) / (S + L).
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 3
    common: float = 0.02
    floor: float = 0.85
    #: The search for frequent shingles lets none pass whose share is short by no more than this; those found are counted anew.
    slack: float = 0.002
    #: Bytes of the sets that are compared in one place.
    cell_bytes: int = 32 << 20


STEP = 0x9E3779B97F4A7C15
GOLD = np.uint64(STEP)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x + GOLD
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def _seed(k: int) -> np.uint64:
    return np.uint64(STEP * k % (1 << 64))


#: A word is hashed as a polynomial in an odd base over its UTF-8 bytes, modulo 2**64; prefix sums give all words of a text at once.
CHUNK = 1 << 18
_BYTE = mix(np.arange(256, dtype=np.uint64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
BASE = 0x9E6C63D0876A9A4F


class _Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of UTF-8 text, some at a time."""
    whole = np.frombuffer(data, np.uint8)
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(whole):
        end = min(at + CHUNK, len(whole))
        while end < len(whole) and not _SPACE[whole[end]]:
            more = np.flatnonzero(_SPACE[whole[end : end + CHUNK]])
            end += int(more[0]) if len(more) else min(CHUNK, len(whole) - end)
        part = whole[at:end]
        blank = np.concatenate([[True], _SPACE[part], [True]])
        starts = np.flatnonzero(blank[:-1] & ~blank[1:])
        ends = np.flatnonzero(~blank[:-1] & blank[1:])
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:-1], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def counted(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text in order, their counts, and where each text's begin (one more at the end).

    Lower case, cut at white space; a text of fewer words is one shingle.
    """
    raw = [t.encode() if t.isascii() else " ".join(t.split()).encode("utf-8", "surrogatepass") for t in ((t or "").lower() for t in texts)]
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    words, places = _word_hashes(b"\n".join(raw))
    bounds = np.searchsorted(places, begins)
    lengths = np.diff(bounds)
    sizes = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    rolled = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size if len(rolled) else 0):
        rolled = mix(rolled ^ words[k : k + len(rolled)])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    keys = np.empty(starts[-1], np.uint64)
    for i in range(len(raw)):
        a, b, w = starts[i], starts[i + 1], bounds[i]
        if lengths[i] >= size:
            keys[a:b] = rolled[w : w + b - a]
            keys[a:b].sort()
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(lengths[i]):
                one = mix(one ^ words[w + k : w + k + 1])
            keys[a:b] = one
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[starts[:-1][sizes > 0]] = True
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))), np.searchsorted(at, starts)


def _blocks_of(texts: list[str | None], most: int = CHUNK):
    """The texts, some at a time: as many as have so many characters."""
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _idf(share: np.ndarray, p: NearDupParams) -> np.ndarray:
    return np.clip(1 - (1 - p.floor) * np.log(np.maximum(share, p.common) / p.common) / -np.log(p.common), p.floor, 1).astype(np.float32)


def _weights(keys: np.ndarray, counts: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    weights = counts.astype(np.float32)
    hit = np.zeros(len(keys), bool)
    if len(common[0]) and len(keys):
        at = np.minimum(np.searchsorted(common[0], keys), len(common[0]) - 1)
        hit = common[0][at] == keys
        weights[hit] *= common[1][at[hit]]
    return weights, hit


def multisets(texts: list[str | None], common: tuple[np.ndarray, np.ndarray], p: NearDupParams):
    """(distinct shingles in order, their weights, which are frequent) of each text; ``common``: frequent shingles in order and their factors."""
    for block in _blocks_of(texts):
        keys, counts, starts = counted(block, p.shingle)
        weights, hit = _weights(keys, counts, common)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield keys[a:b], weights[a:b], hit[a:b]


def weighted(text: str, common: tuple[np.ndarray, np.ndarray], p: NearDupParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return next(multisets([text], common, p))


def jaccard(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of (keys, weights, ...); 0 if both are empty. Rounded, so that sums taken in another order compare alike."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return round(shared / total, 9) if total else 0.0


def samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` consistent weighted samples of each set of a concatenation of non-empty sets, and their places; shape (sets, n)."""
    out = np.empty((len(starts), n), np.uint64)
    places = np.empty((len(starts), n), np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    # A weight of one takes level 0 whatever its draw is.
    other = np.flatnonzero(weights != 1)
    log_weight = np.log(weights[other])
    low = np.uint32((1 << 24) - 1)
    scale, half = np.float32(2.0**-24), np.float32(2.0**-25)

    def product(x):
        """Of two uniform numbers of 24 bits each, from the low parts of both halves."""
        halves = x.view(np.uint32) & low
        u = halves.astype(np.float32)
        u *= scale
        u += half
        return u[0::2] * u[1::2]

    for j in range(n):
        x = mix(keys ^ _seed(2 * j + 1))
        y = mix(x)
        r = np.log(product(x))
        np.negative(r, out=r)
        log_c = np.log(product(y))
        np.negative(log_c, out=log_c)
        np.log(log_c, out=log_c)
        beta = ((x >> np.uint64(24)) & np.uint64(0xFF)).astype(np.float32) + ((x >> np.uint64(48)) & np.uint64(0xFF00)).astype(np.float32)
        beta += np.float32(0.5)
        beta *= np.float32(2.0**-16)
        beta -= 1
        log_a = log_c + r * beta
        if len(other):
            level = np.floor(log_weight / r[other] + (beta[other] + 1))
            log_a[other] -= r[other] * level
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == np.repeat(least, sizes))
        at = at[np.searchsorted(at, starts)]
        places[:, j] = at
        kept = keys[at] ^ _seed(2 * j + 2)
        if len(other):
            t = np.zeros(len(keys), np.int64)
            t[other] = level.astype(np.int64)
            kept ^= t[at].astype(np.uint64)
        out[:, j] = mix(kept)
    return out, places


def _blocks(sets: list[tuple], most: int = 32_768):
    """Numbers of the non-empty sets, some at a time, with their keys and weights end to end."""
    block: list[int] = []
    size = 0
    for i, one in enumerate(sets):
        if len(one[0]):
            block.append(i)
            size += len(one[0])
        if block and (size >= most or i == len(sets) - 1):
            starts = np.cumsum([0] + [len(sets[k][0]) for k in block[:-1]])
            yield block, starts, np.concatenate([sets[k][0] for k in block]), np.concatenate([sets[k][1] for k in block])
            block, size = [], 0


def signatures(sets: list[tuple], p: NearDupParams) -> list[list[int] | None]:
    """64-bit keys of the buckets of each set, one for each band whatever it holds; None for an empty one."""
    out: list[list[int] | None] = [None] * len(sets)
    for block, starts, keys, weights in _blocks(sets):
        drawn, _ = samples(keys, weights, starts, p.bands * p.rows)
        buckets = np.zeros((len(block), p.bands), np.uint64) + np.arange(p.bands, dtype=np.uint64)
        for r in range(p.rows):
            buckets = mix(buckets ^ drawn[:, r :: p.rows])
        for k, row in zip(block, buckets.astype(np.int64), strict=True):
            out[k] = row.tolist()
    return out


@contextlib.contextmanager
def arrow_rows(spark, rows: int):
    """Arrow batches of at most so many rows, for actions within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def common_shingles(docs: DataFrame, p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than a share ``common`` of all documents, and their factors.

    A first pass finds candidates: every partition counts in full and reports what
    at least a share ``slack`` of its own documents has; whatever all partitions
    leave out of a count is less than that share of all.  A second pass counts the
    candidates in all documents, so that the result is the same however the rows
    are dealt.  There are at most (distinct shingles of a mean document) /
    (common - slack) candidates, at any number of documents.
    """
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    texts = docs.select("text")
    # Partitions of too few documents would report single occurrences.
    parts = max(1, int(total * p.slack / 4))

    def search(batches):
        store.starts("minhash")
        held, n = np.zeros(0, np.uint64), 0
        counts = np.zeros(0, np.int64)
        block, size = [], 0

        def fold():
            nonlocal held, counts, block, size
            keys = np.concatenate([held, *block])
            keys, at = np.unique(keys, return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, np.ones(size, np.int64)]), minlength=len(keys)).astype(np.int64)
            held, block, size = keys, [], 0

        for batch in batches:
            for some in _blocks_of(batch.column(0).to_pylist()):
                n += len(some)
                found = counted(some, p.shingle)[0]
                block.append(found)
                size += len(found)
                if size > 4_000_000:
                    fold()
                    # Lossy counting: what is below its share so far can start anew, at a loss that the share bounds.
                    kept = counts > n * p.slack / 2
                    held, counts = held[kept], counts[kept]
        fold()
        kept = counts >= max(2, n * p.slack / 2)
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(held[kept].view(np.int64)), "n": pa.array(counts[kept])})

    def listed(frame, least):
        return frame.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > least * total).collect()

    found = listed(texts.coalesce(parts).mapInArrow(search, "shingle long, n long"), p.common - p.slack)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    candidates = np.sort(np.array([r["shingle"] for r in found], np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def count(batches):
        store.starts("minhash")
        keys = shared.value
        counts = np.zeros(len(keys), np.int64)
        for batch in batches:
            for some in _blocks_of(batch.column(0).to_pylist()):
                there = counted(some, p.shingle)[0]
                at = np.minimum(np.searchsorted(keys, there), len(keys) - 1)
                counts += np.bincount(at[keys[at] == there], minlength=len(keys))
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    found = listed(texts.mapInArrow(count, "shingle long, n long"), p.common)
    keys = np.array([r["shingle"] for r in found], np.int64).view(np.uint64)
    share = np.array([r["n"] for r in found], np.float64) / total
    order = np.argsort(keys)
    return keys[order], _idf(share, p)[order]


def _signed(docs: DataFrame, common, p: NearDupParams) -> DataFrame:
    """(id, node, n, bands) of each row: node is a digest of the whole text, n its distinct shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def sign(batches):
        store.starts("minhash")
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = list(multisets(part.column(2).to_pylist(), shared.value, p))
                sizes = pa.array([len(s[0]) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, pa.array(signatures(sets, p), pa.list_(pa.int64()))], names=["id", "node", "n", "bands"])

    return docs.select("id", F.unhex(F.md5("text")).alias("node"), "text").mapInArrow(sign, "id long, node binary, n long, bands array<long>")


CELL = "bucket long, i int, j int"


def _sets(docs: DataFrame, common, p: NearDupParams) -> DataFrame:
    """(bucket, i, j, id, keys, weights): the multiset of a text, once for each of its cells; ``docs`` are (id, text, cells)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make(batches):
        store.starts("minhash")
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = list(multisets(part.column(1).to_pylist(), shared.value, p))
                cells = part.column(2)
                at = np.repeat(np.arange(len(sets)), cells.value_lengths().to_numpy())
                made = [pa.array([s[c].tobytes() for s in sets], pa.binary()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cells.flatten().flatten(), part.column(0).take(pa.array(at)), *(m.take(pa.array(at)) for m in made)], names=["bucket", "i", "j", "id", "keys", "weights"])

    return docs.select("id", "text", "cells").mapInArrow(make, f"{CELL}, id long, keys binary, weights binary")


class _Differences:
    """Multisets of one cell as differences from a reference, with an inverted index of what some of them share."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        n = len(sets)
        owner = np.repeat(np.arange(n), [len(k) for k, _ in sets])
        weights = np.concatenate([w for _, w in sets]).astype(np.float64)
        self.size = np.bincount(owner, weights, n)
        uniq, first, key, held = np.unique(np.concatenate([k for k, _ in sets]), return_index=True, return_inverse=True, return_counts=True)
        # The reference has what more than half of the members have; that makes the differences least.
        common = np.flatnonzero(2 * held > n)
        reference = np.zeros(len(uniq))
        reference[common] = weights[first[common]]
        there = np.zeros((n, len(common)), bool)
        place = np.full(len(uniq), -1)
        place[common] = np.arange(len(common))
        inside = place[key] >= 0
        there[owner[inside], place[key[inside]]] = True
        lacks, lacked = np.nonzero(~there)
        delta = weights - reference[key]
        some = delta != 0
        owner = np.concatenate([owner[some], lacks])
        key = np.concatenate([key[some], common[lacked]])
        delta = np.concatenate([delta[some], -reference[common[lacked]]])
        self.length = np.bincount(owner, np.abs(delta), n)
        # What one member has alone can't be shared.
        many = np.bincount(key, minlength=len(uniq)) > 1
        kept = many[key]
        owner, key, delta = owner[kept], key[kept], delta[kept]
        order = np.argsort(owner, kind="stable")
        self.keys, self.deltas = key[order], delta[order]
        self.own = np.searchsorted(owner[order], np.arange(n + 1))
        order = np.argsort(key, kind="stable")
        self.members, self.parts = owner[order], delta[order]
        self.lists = np.searchsorted(key[order], np.arange(len(uniq) + 1))

    def alike(self, x: int) -> np.ndarray:
        """Weighted Jaccard similarity of x with each member."""
        a, b = self.own[x], self.own[x + 1]
        keys, mine = self.keys[a:b], self.deltas[a:b]
        starts, counts = self.lists[keys], self.lists[keys + 1] - self.lists[keys]
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        mine, theirs = np.repeat(mine, counts), self.parts[at]
        both = np.abs(mine) + np.abs(theirs) - np.abs(mine - theirs)
        apart = self.length[x] + self.length - np.bincount(self.members[at], both, len(self.length))
        total = self.size[x] + self.size
        return (total - apart) / np.maximum(total + apart, 1e-300)


def cell_links(sets: list[tuple[np.ndarray, np.ndarray]], similarity: float, near: int = 4) -> list[tuple[int, int]]:
    """Pairs of places that join the sets of a cell as all its pairs of at least the similarity would.

    The ``near`` members that differ least from the reference are held against all.
    Pairs inside the class that is then largest are joined; any other pair has a
    member outside, and each of these is held against all members.
    """
    n = len(sets)
    if n == 2:
        return [(0, 1)] if jaccard(*sets) >= similarity else []
    data = _Differences(sets)
    label = np.arange(n)
    links = []

    def probe(x):
        found = np.flatnonzero(np.round(data.alike(x), 9) >= similarity)
        for other in np.unique(label[found]).tolist():
            if other != label[x]:
                links.append((x, int(found[np.argmax(label[found] == other)])))
                label[label == other] = label[x]

    first = np.argsort(data.length, kind="stable")[:near].tolist()
    for x in first:
        probe(x)
    names, counts = np.unique(label, return_counts=True)
    for x in np.flatnonzero(label != names[np.argmax(counts)]).tolist():
        if x not in first:
            probe(x)
    return links


def _cells(batches):
    """Runs of rows of one cell (their first columns are bucket, i, j), which may reach over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            name = tuple(names[:, a].tolist())
            if held and name != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = name
    if held:
        yield held


def cells_of(members: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, cells) of what shares a bucket; ``members`` are (bucket, id, bytes), cells structs of bucket, i, j.

    Of buckets that hold the same texts one is kept.  A bucket of g blocks (g > 1)
    makes a cell of each pair of blocks, so a member goes to g - 1 cells.
    """
    same = ["n", "first", "mark"]
    buckets = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.sum("bytes").alias("bytes")
    )
    buckets = buckets.where("n > 1").groupBy(*same).agg(F.min("bucket").alias("bucket"), F.first("bytes").alias("bytes"))
    blocks = F.ceil(2 * F.col("bytes") / p.cell_bytes).cast("int")
    buckets = buckets.select("bucket", F.when(F.col("bytes") > p.cell_bytes, blocks).otherwise(1).alias("g"))
    block = F.pmod(F.xxhash64("id", "bucket"), F.col("g")).cast("int")

    def cell(i, j):
        return F.struct(F.col("bucket"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    others = F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda k: k != F.col("block"))
    cells = F.when(F.col("g") == 1, F.array(cell(F.lit(0), F.lit(0)))).otherwise(F.transform(others, lambda k: cell(F.least("block", k), F.greatest("block", k))))
    return members.join(buckets, "bucket").withColumn("block", block).select("id", cells.alias("cells")).groupBy("id").agg(F.flatten(F.collect_list("cells")).alias("cells"))


def cell_pairs(sets: DataFrame, p: NearDupParams) -> DataFrame:
    """(a, b): links that join what shares a cell and is similar enough."""

    def solve(batches):
        store.starts("minhash")
        for rows in _cells(batches):
            table = pa.Table.from_batches(rows)
            ids = table.column(3).to_numpy()
            parts = [(np.frombuffer(k, np.uint64), np.frombuffer(w, np.float32)) for k, w in zip(table.column(4).to_pylist(), table.column(5).to_pylist(), strict=True)]
            found = cell_links(parts, p.similarity)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return sets.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(solve, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of the edges (a, b).

    Every node takes the least root around it, then its root's root; halving
    paths this way takes about log(diameter) rounds, each written to the shared
    folder.  Hot nodes are pre-aggregated or lie on a side that can be split.
    """
    both = store.materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    roots = store.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = store.materialize(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "roots")
        if step.where("root != old").isEmpty():
            return step.select("node", "root")
        roots = step.select("node", "root")


def classes(docs: DataFrame, params: NearDupParams = NearDupParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``id_col`` and ``class_id``, the least id of its class.

    A class holds equal texts and what chains of pairs of at least the given
    similarity join.  Null texts count as empty, and empty texts (also of white
    space alone, if equal) are copies of each other.  Rows that repeat an id are
    one document, judged by one of its texts; a null id is its own class (null).
    Other columns are not looked at.  Without rows the result is empty.
    """
    p, spark = params, docs.sparkSession
    rows = store.spread(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    common = common_shingles(rows, p)
    signed = store.materialize(_signed(rows, common, p), "signed")
    known = signed.where("id is not null")
    # One text for each id, one id for each text; both counted map-side first.
    chosen = known.groupBy("id").agg(F.min("node").alias("node"))
    nodes = store.materialize(chosen.groupBy("node").agg(F.min("id").alias("rep")), "nodes")
    reps = known.join(nodes, (known["id"] == nodes["rep"]) & (known["node"] == nodes["node"]), "left_semi").dropDuplicates(["id"])
    members = reps.select("id", (12 * F.col("n")).alias("bytes"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = store.materialize(members.join(shared, "bucket").select("bucket", "id", "bytes"), "members")
    wanted = store.materialize(reps.select("id", "node").join(cells_of(members, p), "id"), "wanted")
    with arrow_rows(spark, 1000):
        # What is wanted grows with the input: it is never broadcast.
        needed = rows.join(wanted.hint("merge"), "id").where(F.unhex(F.md5("text")) == F.col("node"))
        links = store.materialize(cell_pairs(_sets(needed, common, p), p), "links")
    labels = components(links).withColumnRenamed("node", "id").withColumnRenamed("root", "label")
    labelled = nodes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("node", F.coalesce("label", "rep").alias("class_id"))
    of_id = chosen.join(labelled, "node").select("id", "class_id")
    return signed.select("id").join(of_id, "id", "left").select(F.col("id").alias(id_col), "class_id")


def keep_one(docs: DataFrame, params: NearDupParams = NearDupParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that have an earlier document in their class.

    Rows with a null id stay, and so do all rows of the least id of a class, also
    if they repeat it; null and empty texts are copies of each other.  No rows: no
    rows.  All columns stay as they are, whatever their names.
    """
    found = classes(docs, params, id_col=id_col, text_col=text_col)
    drop = found.where(F.col("class_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(drop, id_col, "left_anti")
