"""Token-id output: concatenated id arrays with Elias-Fano coded document boundaries.

A shard is two files.  ``*.ids`` holds the ids of its documents one after the
other, in 2 or 4 bytes each as the vocabulary needs.  ``*.idx`` holds, for n
documents, the n ends and the n document ids as Elias-Fano sequences: the low
``l`` bits of each value packed, the high bits in unary, so that a value takes
about ``2 + l`` bits.  Every 64th one of the unary part is sampled, and
``select`` counts on from there; there is no table of 64-bit offsets.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store

MAGIC = b"SLTOK1\0\0"
SAMPLE = 64
#: Values whose low bits are spread out at once; a multiple of eight.
BLOCK = 1 << 16


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        ones = ((v >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        # Low bits of a block of values at once; a block of whole eights ends at a byte.
        places = np.arange(low_bits, dtype=np.uint64)
        low = b"".join(pack((v[a : a + BLOCK, None] >> places & np.uint64(1)).astype(np.uint8).ravel()) for a in range(0, n, BLOCK))
        return cls(n, low_bits, low, pack(unary), ones[::SAMPLE].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return struct.pack("<QBQQQ", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, low_bits, *sizes = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        parts = []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(n, low_bits, *parts), at

    def _low(self, i: int) -> int:
        value = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return value

    def select(self, i: int) -> int:
        """The i-th value: one sample, then the set bits of at most the bytes up to the next sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rank = int(self.samples[i // SAMPLE]), i % SAMPLE
        end = int(self.samples[i // SAMPLE + 1]) + 1 if i // SAMPLE + 1 < len(self.samples) else len(self.high) * 8
        byte = at >> 3
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (end >> 3) + 1], bitorder="little")[at & 7 :])
        return (at + int(ones[rank]) - i) << self.low_bits | self._low(i)

    def block(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, from the samples around them; nothing else is decoded."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        first, last = i // SAMPLE, (j - 1) // SAMPLE + 1
        at = int(self.samples[first])
        end = int(self.samples[last]) if last < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[at >> 3 : (end + 7) >> 3], bitorder="little")[at & 7 :]
        ones = np.flatnonzero(bits)[i - first * SAMPLE : j - first * SAMPLE] + at
        high = (ones - np.arange(i, j)) << self.low_bits
        at, end = i * self.low_bits, j * self.low_bits
        low = np.unpackbits(self.low[at >> 3 : (end + 7) >> 3], bitorder="little")[at & 7 : (at & 7) + end - at]
        return high | (low.reshape(j - i, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1, dtype=np.int64)

    def values(self) -> np.ndarray:
        return self.block(0, self.n).astype(np.uint64)


#: Letters below this are letters in every version of Unicode's tables.
LATIN_END = "\u0250"
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The byte-level alphabet: visible bytes stand for themselves, the others follow from 256 on in order.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - _PLAIN))}


class CachedEncoder:
    """The tokenizers library, asked once for each distinct stretch between single spaces.

    The pre-tokenizer cuts before a space that is the first or the last character
    of a run of white space, so a text is the join of its stretches' ids unless
    a space stands inside a run; such a text goes to the library whole, and so
    does every text if the file describes another kind of tokenizer.
    """

    INNER_SPACE = re.compile(r"\s \s")
    #: Characters of the stretches whose ids are kept (each counts 30 more), and the longest that is kept.
    LIMIT, LONGEST = 30_000_000, 64
    MARKS = ",.;:!?"

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.held = 0
        made = json.loads(self.library.to_str())
        cut, model = made["pre_tokenizer"] or {}, made["model"]
        #: Stretches can be encoded apart: byte letters, the usual pattern, no text added or changed, merges alone.
        self.parts = (
            (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True) and made["normalizer"] is None and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and all(chr(x) in model["vocab"] for x in BYTE_LETTERS.values()) and all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in made["added_tokens"])
            and not any(t["normalized"] or t["single_word"] for t in made["added_tokens"])
        )
        self.marks = dict(zip(self.MARKS + "\n", self._whole([*self.MARKS, "\n"]), strict=True))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _stretches(self, words: set[str], space: str) -> list[tuple[str, bytes]]:
        """Ids of each word after ``space``. Latin letters alone are one token to the pre-tokenizer, so the library's model gets them directly."""
        # ASCII letters stand for their own bytes; others are spelt in the alphabet of bytes.
        plain = [w for w in words if w.isascii() and w.isalpha()]
        latin = [w for w in words if not w.isascii() and w.isalpha() and max(w) < LATIN_END]
        rest = list(words.difference(plain, latin))
        tokenize, kind, mark = self.library.model.tokenize, "HI"[self.width == 4], space.translate(BYTE_LETTERS)
        spelt = chain((mark + w for w in plain), ((space + w).encode().decode("latin-1").translate(BYTE_LETTERS) for w in latin))
        made = [array(kind, [t.id for t in tokenize(w)]).tobytes() for w in spelt]
        return [*zip(chain(plain, latin), made, strict=True), *zip(rest, self._whole([space + w for w in rest]), strict=True)]

    def _learn(self, missing: set[str]) -> None:
        """Ids of stretches, each after a space.

        A line break between two other characters is a token's worth of its own
        to the pre-tokenizer, and so is one of ``,.;:!?`` at the end of letters.
        Stretches are taken apart there first, as their parts are far fewer.
        """
        lines = {w: w.split("\n") for w in missing if "\n" in w}
        lines = {w: parts for w, parts in lines.items() if not any(p == "" or p != p.strip() for p in parts)}
        words = {parts[0] for parts in lines.values()} | missing.difference(lines)
        ended = {w: (w[:-1], w[-1]) for w in words if len(w) > 1 and w[-1] in self.MARKS and w[-2].isalpha()}
        bare = ({a for a, _ in ended.values()} | words.difference(ended)).difference(self.known)
        heads = {p for parts in lines.values() for p in parts[1:]}
        cut = {p: (p[:-1], p[-1]) for p in heads if len(p) > 1 and p[-1] in self.MARKS and p[-2].isalpha()}
        begin = ({a for a, _ in cut.values()} | heads.difference(cut)).difference(self.heads)
        self.known.update(self._stretches(bare, " "))
        self.heads.update(self._stretches(begin, ""))
        marks = self.marks
        self.known.update((w, self.known[a] + marks[m]) for w, (a, m) in ended.items())
        self.heads.update((w, self.heads[a] + marks[m]) for w, (a, m) in cut.items())
        for w, (first, *rest) in lines.items():
            self.known[w] = self.known[first] + b"".join(marks["\n"] + self.heads[p] for p in rest)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as bytes, in order."""
        cut = [t.split(" ") if self.parts and not self.INNER_SPACE.search(t) else None for t in texts]
        first = [c[0] for c in cut if c]
        words = set(chain.from_iterable(islice(c, 1, None) for c in cut if c))
        missing = words.difference(self.known)
        size = sum(map(len, missing))
        if self.held + size + 30 * len(missing) > self.LIMIT:
            self.known, self.heads, self.held = {}, {}, 0
            missing, size = words, sum(map(len, words))
        # Long stretches are asked for each time they come: what is kept has a bound in bytes.
        long = [w for w in missing if len(w) > self.LONGEST]
        before = len(self.heads)
        self._learn(missing.difference(long) if long else missing)
        self.held += size + 30 * (len(missing) + len(self.heads) - before)
        known = {**{w: self.known[w] for w in words.difference(long)}, **dict(zip(long, self._whole([" " + w for w in long]), strict=True))} if long else self.known
        firsts = iter(self._whole(first))
        for t, c in zip(texts, cut, strict=True):
            yield self._whole([t])[0] if c is None else next(firsts) + b"".join([known[w] for w in c[1:]])


_encoders: dict[tuple, CachedEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> CachedEncoder:
    """One for each worker process: its cache serves all tasks there."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = CachedEncoder(path, special_as_text)
    return _encoders[key]


def pieces(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: Documents whose boundaries are decoded at once.
DOCUMENTS = 4096
#: A shard holds about so many bytes of text, each document counting ``OVERHEAD`` more for its boundaries, which a task keeps.
SHARD_BYTES, LEAST_BYTES, OVERHEAD = 512 << 20, 8 << 20, 64
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
RESULT = "start long, n_tokens long, ids_crc32 long, id_first long, id_last long"


def shard_count(rows: DataFrame) -> int:
    """Shards by the bytes of all texts, whatever the session's settings: none above ``SHARD_BYTES``, and smaller ones down to ``LEAST_BYTES`` while cores are idle."""
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD)).first()[0] or 0
    return max(1, -(-size // SHARD_BYTES), min(3 * rows.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, *, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> list:
    """Encodes all documents in ascending id order into shards below ``folder``; the manifest, a row a shard.

    Ranges of ids are sampled and dealt by Spark, as many as the bytes of the texts
    ask for, so a shard is one sorted range and nothing is held but one range's
    boundaries.  Null ids come first.  Rows of one id are ranged by how their texts
    begin, so an id that very many rows share is dealt over several shards.
    """

    def write(batches):
        store.starts("tokens", _encoders.clear)
        shard = TaskContext.get().partitionId()
        code = encoder(tokenizer_path, special_as_text)
        end = np.array([end_id], code.dtype).tobytes()
        path = f"{folder}/shard-{shard:06d}"
        ends, ids = array("q"), array("q")
        nulls = total = 0
        with store.writing(f"{path}.ids") as out:
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for a, b in pieces(texts):
                    for data in code.encode(texts[a:b]):
                        out.write(data + end)
                        total += len(data) // code.width + 1
                        ends.append(total)
                names = batch.column(0).to_pylist()
                nulls += sum(n is None for n in names)
                ids.extend(n for n in names if n is not None)
        if ends:
            base = ids[0] if ids else 0
            with store.writing(f"{path}.idx") as out:
                out.write(MAGIC + struct.pack("<BQq", code.width, nulls, base))
                out.write(EliasFano.encode(ends).to_bytes() + EliasFano.encode(np.asarray(ids, np.int64) - base).to_bytes())
        else:
            store.remove(f"{path}.ids")
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard] * bool(ends), pa.int32()), "path": pa.array([path] * bool(ends), pa.string()), "n_docs": pa.array([len(ends)] * bool(ends), pa.int64()), "n_tokens": pa.array([total] * bool(ends), pa.int64())}
        )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # A text's first characters order as the text does, and a sample of them stays small.
    ordered = rows.repartitionByRange(shard_count(rows), "id", F.substring("text", 1, 32)).sortWithinPartitions("id", "text")
    return sorted(ordered.mapInArrow(write, MANIFEST).collect())


def read_index(path: str) -> tuple[int, EliasFano, EliasFano, int, int]:
    """Bytes of an id, ends, document ids that aren't null, what is to be added to these, and how many null ones come first."""
    with store.reading(f"{path}.idx") as f:
        data = f.read()
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{path}.idx is no index of token ids")
    width, nulls, base = struct.unpack_from("<BQq", data, len(MAGIC))
    ends, at = EliasFano.from_bytes(data, len(MAGIC) + struct.calcsize("<BQq"))
    names, _ = EliasFano.from_bytes(data, at)
    return width, ends, names, base, nulls


def read_document(path: str, i: int) -> np.ndarray:
    """The ids of the i-th document of a shard, by two selects and one seek."""
    width, ends, *_ = read_index(path)
    start = ends.select(i - 1) if i else 0
    with store.reading(f"{path}.ids") as f:
        f.seek(start * width)
        return np.frombuffer(f.read((ends.select(i) - start) * width), f"<u{width}")


def read_shards(spark, manifest: list, *, id_col: str = "doc_id", step: int = 4_000_000) -> DataFrame:
    """One row a document from the files: id, start over all shards, tokens, crc32 of the ids in 4 bytes each."""

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                width, ends, names, base, nulls = read_index(path)
                with store.reading(f"{path}.ids") as f:
                    for i in range(0, ends.n, DOCUMENTS):
                        j = min(ends.n, i + DOCUMENTS)
                        stops = ends.block(i, j)
                        starts = np.concatenate([[ends.select(i - 1) if i else 0], stops[:-1]])
                        sums, firsts, lasts = [], [], []
                        k = 0
                        while k < len(stops):
                            end = max(k + 1, int(np.searchsorted(stops, starts[k] + step)))
                            block = np.frombuffer(f.read(int(stops[end - 1] - starts[k]) * width), f"<u{width}").astype("<u4")
                            for a, b in zip(starts[k:end] - starts[k], stops[k:end] - starts[k], strict=True):
                                sums.append(zlib.crc32(block[a:b]))
                                firsts.append(int(block[a]))
                                lasts.append(int(block[b - 1]))
                            k = end
                        named = (names.block(max(i - nulls, 0), max(j - nulls, 0)) + base).tolist()
                        yield pa.RecordBatch.from_pydict({
                            id_col: pa.array([None] * (j - i - len(named)) + named, pa.int64()), "start": pa.array(starts + first), "n_tokens": pa.array(stops - starts),
                            "ids_crc32": pa.array(sums, pa.int64()), "id_first": pa.array(firsts, pa.int64()), "id_last": pa.array(lasts, pa.int64()),
                        })

    rows, first = [], 0
    for shard in manifest:
        rows.append((shard["path"], first))
        first += shard["n_tokens"]
    shards = spark.createDataFrame(rows, "path string, first long").repartition(max(1, len(rows)))
    return shards.mapInArrow(read, f"{id_col} long, {RESULT}")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Writes the shards and reads them back: ``id_col, start, n_tokens, ids_crc32, id_first, id_last``.

    Null and empty texts are one end id.  Repeated ids stay, ordered by text;
    null ids come first.  Without rows the result is empty.  Other columns are
    not looked at.  The driver holds a row for each shard only.
    """
    spark = docs.sparkSession
    folder = store.new_folder(spark, "tokens")
    manifest = write_shards(docs, tokenizer_path, end_id, folder, id_col=id_col, text_col=text_col, special_as_text=special_as_text)
    return read_shards(spark, manifest, id_col=id_col)
