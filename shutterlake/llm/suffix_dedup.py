"""Exact removal of long repeated byte strings by suffix arrays of shards.

A string of ``length`` bytes counts as repeated where it also starts in a
document with a smaller id.  Suffixes of the whole corpus are too many to sort
by shuffling them, so shards of *contexts* are sorted that hold every candidate:

1. Every string of ``length`` bytes has an anchor: its 24-byte substring of the
   least hash.  Equal strings have equal anchors at equal offsets.  A scan writes
   each partition's texts to a file of its own, with the places of anchors, and
   asks about every anchor: its hash, a hash of its context (all bytes that
   strings around it can take), its document.  Equal contexts of one frame are
   asked about once, for the least document; requests are packed by hash.
2. Anchors of one document alone need nothing.  A context that an earlier
   document has too is repeated whole.  What is left is the first document of
   each context of an anchor that has several: its bytes are asked for.
3. Those contexts are gathered by anchor hash.  Induced sorting gives a shard's
   suffix array, common prefixes with sorted neighbours in text order tell the
   runs of equal strings, and the least document of a run tells which to remove.
4. Each scan partition's file is read again with the answers to its questions.

Text is never shuffled; a request is 12 bytes for about every 14 bytes of text,
an answer two bits.  Buckets follow the bytes of all texts, so a bucket's size does
not grow with the input; a context that very many documents share is asked about
once a frame.  Contexts are told apart by 96 bits of hash: among n of them two that
differ are taken for one with a probability below n * n / 2**97.  An anchor that very
many documents have among *different* bytes brings all its contexts to one bucket.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store
from shutterlake.llm.suffix_sort import permuted_prefixes, suffix_array

ANCHOR = 24
FRAME = 4_000_000
#: Bytes of text that a bucket of requests stands for.
BUCKET = 16_000_000
NONE, WHOLE, ASK = 0, 1, 2
NO_ID = np.iinfo(np.int64).max
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; shorter by seven."""
    if len(data) < 8:
        return np.zeros(0, U)
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))).view("<u8").ravel()


def hashes(words: np.ndarray, n: int, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``size`` bytes from each of the first ``n`` places (or those in ``at``) on; ``size`` is 8 or more."""
    take = (lambda o: words[o : o + n]) if at is None else (lambda o: words[at + o])
    h = mix(take(0) ^ U(0x9E3779B97F4A7C15))
    for o in range(8, size, 8):
        h = mix(h ^ take(min(o, size - 8)))
    return h


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` of each ``width`` neighbours, by doubling."""
    n, step, y = len(x) - width + 1, 1, x
    while step * 2 <= width:
        y = pick(y[:-step], y[step:])
        step *= 2
    return pick(y[:n], y[width - step : width - step + n]) if step < width else y


def anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Places of anchors of one text: where a hash is the least of some ``length``-byte string."""
    n, width = len(data) - ANCHOR + 1, length - ANCHOR + 1
    if n < width:
        return np.zeros(0, np.int64)
    h = hashes(words_of(data), n, ANCHOR)
    least = _slide(h, width, np.minimum)
    edge = np.zeros(width - 1, U)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == h)


class Frame:
    """Some documents' bytes one after the other, with their anchors."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, places: np.ndarray, owner: np.ndarray, length: int, again: np.ndarray | None = None):
        self.ids, self.sizes, self.data, self.places, self.owner, self.length = ids, sizes, data, places, owner, length
        #: Two rows: anchors whose context another anchor of the frame has, and that anchor, of the least document.
        self.again = np.zeros((2, 0), np.int64) if again is None else again
        self.starts = np.cumsum(sizes) - sizes
        self.reach = length - ANCHOR

    @classmethod
    def of(cls, ids: list, texts: list[bytes], length: int) -> Frame:
        sizes = np.array([len(t) for t in texts], np.int64)
        names = np.array([NO_ID if i is None else i for i in ids], np.int64)
        places, owner, at = [], [], 0
        for k, t in enumerate(texts):
            if ids[k] is not None:
                found = anchors(np.frombuffer(t, np.uint8), length)
                places.append(found + at)
                owner.append(np.full(len(found), k, np.int64))
            at += len(t)
        none = [np.zeros(0, np.int64)]
        return cls(names, sizes, np.frombuffer(b"".join(texts), np.uint8), np.concatenate(none + places), np.concatenate(none + owner), length)

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.ids, self.sizes, self.data)] + [zlib.compress(np.diff(self.places, prepend=0).astype("<u4").tobytes(), 1), np.bincount(self.owner, minlength=len(self.ids)).astype("<u4").tobytes(), zlib.compress(self.again.astype("<u4").tobytes(), 1)]
        parts[2] = zlib.compress(parts[2], 3)
        return struct.pack("<6Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_file(cls, f, length: int) -> Frame | None:
        head = f.read(48)
        if not head:
            return None
        parts = [f.read(n) for n in struct.unpack("<6Q", head)]
        counts = np.frombuffer(parts[4], "<u4")
        return cls(
            np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.int64), np.frombuffer(zlib.decompress(parts[2]), np.uint8),
            np.cumsum(np.frombuffer(zlib.decompress(parts[3]), "<u4").astype(np.int64)), np.repeat(np.arange(len(counts)), counts), length,
            np.frombuffer(zlib.decompress(parts[5]), "<u4").astype(np.int64).reshape(2, -1),
        )

    def asked(self) -> np.ndarray:
        """Numbers of the anchors that are asked about."""
        return np.delete(np.arange(len(self.places)), self.again[0])

    def unite(self, h: np.ndarray, c: np.ndarray) -> None:
        """Finds the anchors that need not be asked about, from their hashes and their contexts'."""
        doc = self.ids[self.owner]
        order = np.lexsort((doc, mix(h ^ (c * U(0x9E3779B97F4A7C15)))))
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        self.again = np.stack([order[~new], first[~new]])

    def bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of the contexts of the anchors numbered ``at``."""
        p, k = self.places[at], self.owner[at]
        return np.maximum(p - self.reach, self.starts[k]), np.minimum(p + self.length, self.starts[k] + self.sizes[k])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each anchor and of its context; a context cut off by a text's end differs from any other."""
        pad = 2 * self.length
        words = words_of(np.concatenate([np.zeros(pad, np.uint8), self.data, np.zeros(pad + 8, np.uint8)]))
        p = self.places + pad
        h = hashes(words, 0, ANCHOR, p)
        low, high = self.bounds(np.arange(len(p)))
        left, right = (self.places - low).astype(U), (high - self.places).astype(U)
        size = self.length + self.reach
        whole = (left == self.reach) & (right == self.length)
        c = np.empty(len(p), U)
        c[whole] = hashes(words, 0, size, p[whole] - self.reach)
        # At a text's ends the bytes beyond are another text's: they are blanked out, one context at a time.
        raw = self.data.tobytes()
        for k in np.flatnonzero(~whole):
            c[k] = int.from_bytes(hashlib.blake2b(raw[low[k] : high[k]], digest_size=8).digest(), "little")
        c[~whole] = mix(c[~whole] ^ (left[~whole] * U(256) + right[~whole]))
        return h, c


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(40)) % U(buckets)).astype(np.int64)


def _groups(buckets: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its members in order)."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    return [(int(buckets[g[0]]), g) for g in np.split(order, cuts) if len(g)]


def _low48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _runs(ids: np.ndarray) -> bytes:
    """Document ids of requests, which come in runs."""
    cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return struct.pack("<Q", len(cuts)) + zlib.compress(ids[cuts].astype("<i8").tobytes() + np.diff(np.append(cuts, len(ids))).astype("<u4").tobytes(), 1)


def _from_runs(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", data)
    raw = zlib.decompress(data[8:])
    return np.repeat(np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n :], "<u4"))


def _pack(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def _unpack(data: bytes, n: int) -> list[bytes]:
    at, out = 8 * n, []
    for size in struct.unpack_from(f"<{n}Q", data):
        out.append(data[at : at + size])
        at += size
    return out


MESSAGE = "shard int, frame int, bucket int, kind int, payload binary"


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["shard", "frame", "bucket", "kind", "payload"])


def _messages(table: pa.Table) -> list[tuple]:
    return sorted(zip(*(table.column(k).to_pylist() for k in ("shard", "frame", "bucket", "kind", "payload")), strict=True), key=lambda r: r[:4])


def scan(rows: DataFrame, folder: str, length: int, buckets: int) -> DataFrame:
    """Writes each partition's frames to its file and asks about their anchors; a message of bucket -1 tells that a shard is there."""

    def run(batches):
        shard, frame = TaskContext.get().partitionId(), 0
        with store.writing(f"{folder}/shard-{shard:06d}") as out:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
                start = size = 0
                for k, t in enumerate(texts):
                    size += len(t)
                    if size >= FRAME or k == len(texts) - 1:
                        one = Frame.of(ids[start : k + 1], texts[start : k + 1], length)
                        h, c = one.keys()
                        one.unite(h, c)
                        out.write(one.to_bytes())
                        at = one.asked()
                        h, c, asked = h[at], c[at], one.ids[one.owner[at]]
                        made = [(shard, frame, b, NONE, _pack(_low48(h[g]), _low48(c[g]), _runs(asked[g]))) for b, g in _groups(_bucket(h, buckets))]
                        yield from _table(made).to_batches()
                        start, size, frame = k + 1, 0, frame + 1
        if frame:
            yield from _table([(shard, -1, -1, NONE, b"")]).to_batches()

    return rows.mapInArrow(run, MESSAGE)


def answer_anchors(messages: list[tuple]) -> list[tuple]:
    """Two bits for each request of a bucket: nothing repeats, all repeats, or the bytes are needed."""
    parts = [_unpack(m[4], 3) for m in messages]
    h = np.concatenate([_from48(p[0]) for p in parts])
    c = np.concatenate([_from48(p[1]) for p in parts])
    doc = np.concatenate([_from_runs(p[2]) for p in parts])
    sizes = [len(p[0]) // 6 for p in parts]
    order = np.lexsort((doc, c, h))
    hs, cs, ds = h[order], c[order], doc[order]
    new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
    new_c = new_h | np.concatenate([[True], cs[1:] != cs[:-1]])
    first_c = np.flatnonzero(new_c)
    least = np.repeat(ds[first_c], np.diff(np.append(first_c, len(ds))))
    first_h = np.flatnonzero(new_h)
    contexts = np.add.reduceat(new_c.astype(np.int64), first_h)
    apart = np.minimum.reduceat(ds, first_h) != np.maximum.reduceat(ds, first_h)
    several = np.repeat((contexts > 1) & apart, np.diff(np.append(first_h, len(ds))))
    code = np.where(ds > least, WHOLE, np.where(several, ASK, NONE))
    answers = np.empty(len(code), np.uint8)
    answers[order] = code
    out, at = [], 0
    for (shard, frame, bucket, _, _), n in zip(messages, sizes, strict=True):
        own = answers[at : at + n]
        at += n
        if own.any():
            out.append((shard, frame, bucket, 0, zlib.compress(own.tobytes(), 1)))
    return out


def ask_contexts(path: str, answers: list[tuple], length: int, buckets: int) -> list[tuple]:
    """The contexts that are needed, by bucket."""
    by_frame: dict[int, list] = {}
    for m in answers:
        by_frame.setdefault(m[1], []).append(m)
    shard = answers[0][0]
    out, number = [], 0
    with store.reading(path) as f:
        while (frame := Frame.from_file(f, length)) is not None:
            wanted = by_frame.get(number)
            if wanted:
                asked = frame.asked()
                members = dict(_groups(_bucket(_anchor_hashes(frame)[asked], buckets)))
                for _, _, bucket, _, payload in wanted:
                    at = asked[members[bucket]][np.frombuffer(zlib.decompress(payload), np.uint8) == ASK]
                    if len(at):
                        low, high = frame.bounds(at)
                        text = frame.data.tobytes()
                        parts = b"".join([text[a:b] for a, b in zip(low, high, strict=True)])
                        out.append((shard, number, bucket, 0, _pack((high - low).astype("<u4").tobytes(), zlib.compress(parts, 1), _runs(frame.ids[frame.owner[at]]))))
            number += 1
    return out


def _anchor_hashes(frame: Frame) -> np.ndarray:
    words = words_of(np.concatenate([frame.data, np.zeros(ANCHOR + 8, np.uint8)]))
    return hashes(words, 0, ANCHOR, frame.places)



def repeated_starts(contexts: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, the offsets of strings that a context of a smaller document has too."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join([c + b"\0" for c in contexts]), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    text = data.astype(np.int16) + 1
    text[ends] = 0
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    fits = np.arange(len(data)) + length <= ends[owner]
    chosen = order[fits[order]]
    if not len(chosen):
        return [np.zeros(0, np.int64)] * len(contexts)
    # Bytes alone don't tell a part's end from a zero byte: only suffixes that hold a string are compared.
    _, common = permuted_prefixes(np.concatenate([data, np.zeros(length + 8, np.uint8)]), chosen, length)
    new = common[chosen] < length
    new[0] = True
    run = np.flatnonzero(new)
    doc = docs[owner[chosen]]
    least = np.repeat(np.minimum.reduceat(doc, run), np.diff(np.append(run, len(chosen))))
    hit = np.sort(chosen[doc > least])
    cuts = np.searchsorted(hit, starts[1:])
    return [h - s for h, s in zip(np.split(hit, cuts), starts, strict=True)]


def answer_contexts(messages: list[tuple], length: int) -> list[tuple]:
    """Bit masks of repeated strings of each context of a bucket."""
    contexts: list[bytes] = []
    docs, sizes = [], []
    for m in messages:
        raw_sizes, raw, ids = _unpack(m[4], 3)
        n = np.frombuffer(raw_sizes, "<u4").astype(np.int64)
        text, at = zlib.decompress(raw), np.cumsum(n) - n
        contexts += [text[a : a + k] for a, k in zip(at.tolist(), n.tolist(), strict=True)]
        docs.append(_from_runs(ids))
        sizes.append(len(n))
    doc = np.concatenate(docs)
    found = repeated_starts(contexts, doc, length)
    masks = np.array([int(sum(1 << int(k) for k in f)) for f in found], np.uint64)
    out, at = [], 0
    for (shard, frame, bucket, _, _), n in zip(messages, sizes, strict=True):
        if masks[at : at + n].any():
            out.append((shard, frame, bucket, 1, zlib.compress(masks[at : at + n].tobytes(), 1)))
        at += n
    return out


def apply_answers(path: str, answers: list[tuple], length: int, buckets: int):
    """(frame, removed) for each frame of a shard: which bytes go."""
    by_frame: dict[int, list] = {}
    for m in answers:
        by_frame.setdefault(m[1], []).append(m)
    number = 0
    with store.reading(path) as f:
        while (frame := Frame.from_file(f, length)) is not None:
            change = np.zeros(len(frame.data) + 1, np.int64)
            got = by_frame.get(number, [])
            code, mask = np.zeros(len(frame.places), np.uint8), np.zeros(len(frame.places), U)
            if got:
                asked = frame.asked()
                members = dict(_groups(_bucket(_anchor_hashes(frame)[asked], buckets)))
                for m in sorted(got, key=lambda m: m[3]):
                    at = asked[members[m[2]]]
                    if m[3] == 0:
                        code[at] = np.frombuffer(zlib.decompress(m[4]), np.uint8)
                    else:
                        mask[at[code[at] == ASK]] = np.frombuffer(zlib.decompress(m[4]), U)
            if frame.again.size:
                at, first = frame.again
                later = frame.ids[frame.owner[at]] > frame.ids[frame.owner[first]]
                code[at] = np.where(later, WHOLE, code[first])
                mask[at] = mask[first]
            low, high = frame.bounds(np.flatnonzero(code == WHOLE))
            np.add.at(change, low, 1)
            np.add.at(change, high, -1)
            some = np.flatnonzero((code == ASK) & (mask != 0))
            low, mask = frame.bounds(some)[0], mask[some]
            for k in range(length - ANCHOR + 1 if len(some) else 0):
                hit = low[(mask >> U(k)) & U(1) == 1] + k
                np.add.at(change, hit, 1)
                np.add.at(change, hit + length, -1)
            yield frame, np.cumsum(change[:-1]) > 0
            number += 1


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _answers(docs: DataFrame, folder: str, length: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    rows = store.spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))

    def first(table: pa.Table) -> pa.Table:
        messages = _messages(table)
        return _table([(m[0], -1, -1, 0, b"") for m in messages] if messages[0][2] < 0 else answer_anchors(messages))

    codes = store.materialize(scan(rows, folder, length, buckets).groupBy("bucket").applyInArrow(first, MESSAGE), "codes")

    def second(table: pa.Table) -> pa.Table:
        messages = _messages(table)
        return _table(ask_contexts(f"{folder}/shard-{messages[0][0]:06d}", messages, length, buckets))

    def third(table: pa.Table) -> pa.Table:
        return _table(answer_contexts(_messages(table), length))

    asked = codes.where("bucket >= 0").groupBy("shard").applyInArrow(second, MESSAGE)
    masks = store.materialize(asked.groupBy("bucket").applyInArrow(third, MESSAGE), "masks")
    return codes.unionByName(masks)


def remove_repeats(docs: DataFrame, length: int = 50, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the ``kept`` bytes of every row.

    Every byte goes that is covered by a string of ``length`` bytes which also
    starts in a row with a smaller id; strings are judged on the input, never
    across rows.  Null texts are empty.  Rows with equal ids don't remove from
    each other; a null id neither removes nor is removed from.  Texts shorter
    than ``length`` stay whole.  No rows: no rows.  Other columns are not looked at.
    """
    if length < 2 * ANCHOR or length - ANCHOR >= 64:
        raise ValueError(f"length must be from {2 * ANCHOR} to {ANCHOR + 63}")
    spark = docs.sparkSession
    folder = store.new_folder(spark, "bytes")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("double")).alias("n")).first()["n"] or 0
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / BUCKET))
    answers = _answers(docs, folder, length, buckets, id_col, text_col)
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts]

    def last(table: pa.Table) -> pa.Table:
        messages = _messages(table)
        rows = []
        for frame, gone in apply_answers(f"{folder}/shard-{messages[0][0]:06d}", [m for m in messages if m[1] >= 0], length, buckets):
            for i, a, n in zip(frame.ids.tolist(), frame.starts.tolist(), frame.sizes.tolist(), strict=True):
                out = gone[a : a + n]
                kept = frame.data[a : a + n][~out].tobytes()
                spans = int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1])) if n else 0
                rows.append((None if i == NO_ID else i, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    schema = "id long, " + RESULT + (", kept binary" if texts else "")
    return answers.groupBy("shard").applyInArrow(last, schema).withColumnRenamed("id", id_col)
