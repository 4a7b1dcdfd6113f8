"""Alignment of two tokenizers: who owns each byte.

Both tokenizers cover the same bytes: a space and the text.  ``np.repeat`` of the
token numbers over the bytes gives an owner for each byte, once for A and once for
B.  Consecutive distinct pairs of owners are the overlaps (links), and places where
both owners change cut the tokens into groups.

A text without double spaces is the join of its stretches between spaces, for
both tokenizers, and each space is a cut; so each distinct stretch is aligned once a
worker, and other texts whole.  Links are counted in two steps: tasks write the
ids of their documents' links into chunk files of the shared folder and give each
chunk's distinct pairs with counts to Spark, which sums them over the corpus; then
each chunk gets the sums of its own pairs and reads its file again.  A chunk ends
when its distinct pairs or its bytes reach a bound, so no task needs the table of
all pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store
from shutterlake.llm.sentencepiece_codec import BAR
from shutterlake.llm.token_output import BYTE_LETTERS, LATIN_END, _encoders, encoder

#: Bytes whose owners are held at once, where tokens of both end together that often.
BLOCK = 1 << 20
#: What ends a chunk: distinct pairs of ids, and bytes of links.
CHUNK_PAIRS, CHUNK_BYTES = 4_000_000, 1 << 28
#: Links whose distinct pairs are counted at once.
COUNTED = 4_000_000
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def owners(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers (a, b) of each link in order, and the first tokens (a, b) of each group.

    ``sizes_a`` and ``sizes_b`` are bytes of the tokens and have one sum.  Owners are
    held for blocks that end where tokens of both do.
    """
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    stops = [0, *both[np.unique(np.searchsorted(both, np.arange(BLOCK, int(ends_a[-1]), BLOCK)))].tolist(), int(ends_a[-1])]
    links_a, links_b, groups_a, groups_b = [], [], [], []
    for start, stop in zip(stops, stops[1:], strict=False):
        if start == stop:
            continue
        a0, a1 = np.searchsorted(ends_a, [start, stop], side="right")
        b0, b1 = np.searchsorted(ends_b, [start, stop], side="right")
        own_a = np.repeat(np.arange(a0, a1, dtype=np.int32), sizes_a[a0:a1])
        own_b = np.repeat(np.arange(b0, b1, dtype=np.int32), sizes_b[b0:b1])
        new_a, new_b = np.ones(len(own_a), bool), np.ones(len(own_b), bool)
        np.not_equal(own_a[1:], own_a[:-1], out=new_a[1:])
        np.not_equal(own_b[1:], own_b[:-1], out=new_b[1:])
        link, cut = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
        links_a.append(own_a[link])
        links_b.append(own_b[link])
        groups_a.append(own_a[cut])
        groups_b.append(own_b[cut])
    return tuple(map(np.concatenate, (links_a, links_b, groups_a, groups_b)))


class Aligner:
    """Aligned stretches of one pair of vocabularies, kept in a table bounded by characters."""

    #: Characters of the stretches that are kept in each of two generations (each stretch counts 60 more), and the longest that is kept.
    LIMIT, LONGEST = 18_000_000, 64
    #: Stretches that are aligned at once.
    STEP = 20_000
    #: Texts that aren't the join of their stretches: spaces beside white space, or the bar that stands for a space.
    WHOLE = re.compile(rf"\s \s|  |^ |{BAR}")

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        code = encoder(path_a, True)
        self.a, self._whole_a, self.dtype = code.library, code._whole, code.dtype
        self.b = m = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {chr(x): b for b, x in BYTE_LETTERS.items()} | {chr(x): x for x in range(256) if x not in BYTE_LETTERS}
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if m.is_byte(i) else p.replace(BAR, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        if len(self.bytes_a) * len(self.bytes_b) > 1 << 32:
            raise ValueError("pairs of these vocabularies need more than 32 bits")
        #: Whether both cut before each space, so that stretches can be taken apart.
        self.parts = code.parts and not any(BAR in p.lstrip(BAR) for p in pieces)
        self.ranks = self._ranked() if self.parts else None
        self.bar = [m.piece_to_id(BAR)]
        #: The younger generation becomes the older one when it is full; what is met again moves to the younger.
        self.known: dict[str, tuple[int, str, bytes] | None] = {}
        self.older: dict[str, tuple[int, str, bytes] | None] = {}
        self.held = 0

    def _ranked(self):
        """The same vocabulary by ranks, which is several times faster for Latin letters: ids in the order of merges."""
        import public_tokenizers
        import tiktoken

        model = json.loads(self.a.to_str())["model"]
        made = [model["vocab"]["".join(pair)] for pair in model["merges"]]
        if made != sorted(made) or len(set(made)) < len(made):
            return None
        ranks = {self.bytes_a[i]: i for i in {*made, *(model["vocab"][chr(b if b not in BYTE_LETTERS else BYTE_LETTERS[b])] for b in range(256))}}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, word: str) -> bool:
        """Stretches that may be joined for the ranks: no white space at either end, Latin letters."""
        return bool(word) and word == word.strip() and (word.isascii() or max(word) < LATIN_END)

    def _align(self, words: list[str], joined: bool = False) -> list[tuple[int, str, bytes] | None]:
        """For each stretch, which a space goes before: (tokens of A and, times 2**32, of B; groups as text; links as pairs of ids), or None where a tokenizer changes bytes.

        All stretches lie one after the other in one array of owners.
        """
        if not words:
            return []
        text = " " + " ".join(words)
        data = text.encode()
        sizes = np.fromiter((len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in words), np.int64, len(words))
        a = self.ranks.encode_to_numpy(text) if joined and self.ranks else np.concatenate([np.frombuffer(x, self.dtype) for x in self._whole_a([" " + w for w in words])])
        # Nothing after a space, as at the end of a text, is the bar alone.
        ids_b = [ids or self.bar for ids in self.b.encode(words, num_threads=1)]
        b = np.fromiter(chain.from_iterable(ids_b), np.int64, sum(map(len, ids_b)))
        list_a, list_b = a.tolist(), b.tolist()
        if b"".join(map(self.bytes_a.__getitem__, list_a)) != data or b"".join(map(self.bytes_b.__getitem__, list_b)) != data:
            return [self._align([w])[0] for w in words] if len(words) > 1 else [None]
        a = a.astype(np.int64)
        link_a, link_b, group_a, group_b = owners(self.sizes_a[a], self.sizes_b[b])
        pairs = (a[link_a] * len(self.bytes_b) + b[link_b]).astype("<u4").tobytes()
        # Stretches end where tokens of both do, so theirs are ranges of tokens, links and groups.
        stops = np.cumsum(sizes)
        ends_a, ends_b = (np.concatenate([[0], np.searchsorted(np.cumsum(x), stops) + 1]) for x in (self.sizes_a[a], self.sizes_b[b]))
        links, groups = np.searchsorted(link_a, ends_a).tolist(), np.searchsorted(group_a, ends_a).tolist()
        counts = (np.diff(ends_a) + (np.diff(ends_b) << 32)).tolist()
        names = self.names
        text_a, text_b = [names[i] for i in list_a], [names[i] for i in list_b]
        cuts_a, cuts_b = [*group_a.tolist(), len(list_a)], [*group_b.tolist(), len(list_b)]
        parts = [f"{','.join(text_a[x:y])}|{','.join(text_b[z:w])}" for x, y, z, w in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:], strict=False)]
        return [(n, ";".join(parts[g:h]), pairs[4 * x : 4 * y]) for n, g, h, x, y in zip(counts, groups, groups[1:], links, links[1:], strict=False)]

    def _learn(self, words: list[str]) -> dict[str, tuple[int, str, bytes] | None]:
        made = {}
        for kind in (True, False):
            some = [w for w in words if self._plain(w) is kind]
            for k in range(0, len(some), self.STEP):
                made.update(zip(some[k : k + self.STEP], self._align(some[k : k + self.STEP], joined=kind), strict=True))
        return made

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """``n_a, n_b, n_groups, groups, links`` of each text; nothing for null and empty texts and those whose bytes a tokenizer changes."""
        cut = [t.split(" ") if t and self.parts and not self.WHOLE.search(t) else None for t in texts]
        words = set().union(*[c for c in cut if c])
        if self.held > self.LIMIT:
            self.older, self.known, self.held = self.known, {}, 0
        missing = words.difference(self.known)
        again = missing.intersection(self.older)
        new = {w: self.older[w] for w in again} | self._learn([w for w in missing.difference(again) if len(w) <= self.LONGEST])
        self.known.update(new)
        self.held += sum(map(len, new)) + 60 * len(new)
        known, long = self.known, [w for w in missing if len(w) > self.LONGEST]
        if long:
            known = {w: known[w] for w in words.difference(long)} | self._learn(long)
        for t, c in zip(texts, cut, strict=True):
            found = [known[w] for w in c] if c else self._align([t]) if t else [None]
            if None in found:
                yield 0, 0, 0, "", b""
            else:
                counts, groups, links = zip(*found, strict=True)
                n, text = sum(counts), ";".join(groups)
                yield n & 0xFFFFFFFF, n >> 32, text.count(";") + 1, text, b"".join(links)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _forget() -> None:
    _aligners.clear()
    _encoders.clear()


class _Counts:
    """Distinct pairs of a chunk and how often each is linked."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, links: bytes) -> None:
        self.waiting.append(links)
        self.size += len(links)
        if self.size >= 4 * COUNTED:
            self.settle()

    def settle(self) -> None:
        keys, n = np.unique(np.frombuffer(b"".join(self.waiting), "<u4"), return_counts=True)
        self.waiting, self.size = [], 0
        both = np.concatenate([self.keys, keys])
        self.keys, at = np.unique(both, return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, n]), len(self.keys)).astype(np.int64)


def _rows(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i - start >= 2000:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def write_chunks(docs: DataFrame, path_a: str, path_b: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_pairs: int = CHUNK_PAIRS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Aligns all documents into chunk files below ``folder``; ``chunk, pair, n`` of each chunk, with a null pair so that each chunk has a row."""
    rows = store.spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")))

    def write(batches):
        store.starts("alignment", _forget)
        align = aligner(path_a, path_b)
        context = TaskContext.get()
        # A task that is tried again writes files of its own names, and only those of a finished one are in the result.
        chunk = context.taskAttemptId() << 20
        todo = ((b.column(0).slice(i, j - i), texts[i:j]) for b in batches for texts in [b.column(1).to_pylist()] for i, j in _rows(texts))
        batch = next(todo, None)
        while batch is not None:
            counts, size = _Counts(), 0
            with store.writing(f"{folder}/chunk-{chunk}") as out:
                writer = None
                while batch is not None and size < chunk_bytes and len(counts.keys) < chunk_pairs:
                    ids, texts = batch
                    made = list(align.documents(texts))
                    links = [x[4] for x in made]
                    for x in links:
                        counts.add(x)
                    size += sum(map(len, links))
                    part = pa.RecordBatch.from_arrays(
                        [ids, *[pa.array([x[k] for x in made], pa.int64()) for k in range(3)], pa.array([hashlib.sha256(x[3].encode()).hexdigest() if x[3] else "" for x in made], pa.string()), pa.array(links, pa.large_binary())],
                        names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
                    )
                    writer = writer or pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                    writer.write_batch(part)
                    batch = next(todo, None)
                writer.close()
            counts.settle()
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "pair": pa.array([None], pa.int64()), "n": pa.array([0], pa.int64())})
            for k in range(0, len(counts.keys), 100_000):
                keys = counts.keys[k : k + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(keys), chunk)), "pair": pa.array(keys), "n": pa.array(counts.n[k : k + 100_000])})
            chunk += 1

    return rows.mapInArrow(write, "chunk long, pair long, n long")


def read_chunks(sums: DataFrame, folder: str, id_col: str, kind: str, path_a: str, path_b: str) -> DataFrame:
    """A row for each document of the chunks; ``sums`` has ``chunk, pair, total, best``."""

    def read(table: pa.Table) -> pa.Table:
        pairs, order = table.column("pair").to_numpy(), None
        known = table.column("pair").is_valid().to_numpy()
        keys = pairs[known].astype(np.int64)
        order = np.argsort(keys)
        keys = keys[order]
        total, best = (table.column(c).to_numpy()[known].astype(np.int64)[order] for c in ("total", "best"))
        out = []
        with store.reading(f"{folder}/chunk-{table.column('chunk')[0].as_py()}") as f:
            for batch in pa.ipc.open_stream(f):
                links = batch.column("links").to_pylist()
                n = np.array([len(x) // 4 for x in links], np.int64)
                at = np.searchsorted(keys, np.frombuffer(b"".join(links), "<u4"))
                ends = np.concatenate([[0], np.cumsum(n)])
                summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[at])])[ends])  # noqa: E731, B023
                out.append(pa.table([batch.column("id"), batch.column("n_a"), batch.column("n_b"), batch.column("n_groups"), pa.array(n), pa.array(summed(best)), pa.array(summed(total)), batch.column("groups_sha256")], names=[id_col, *[c.split()[0] for c in RESULT.split(", ")]]))
        return pa.concat_tables(out)

    return sums.groupBy("chunk").applyInArrow(read, f"{id_col} {kind}, {RESULT}")


def align_tokens(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_pairs: int = CHUNK_PAIRS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document.

    A is a byte-level tokenizer file over a space and the text, B a merge-type
    SentencePiece model that adds the space itself; special tokens' strings in texts are
    plain text.  ``n_best``: links whose pair of ids is linked as often in the corpus as
    any pair of their B id; ``count_sum``: how often their pairs are linked, over all links.
    Null and empty texts, and those whose bytes either tokenizer changes (a text that holds
    the bar U+2581), have zeros and ''.  Rows with equal ids, and null ids, each give a row
    and each count; other columns are not looked at; no documents give none.
    """
    spark = docs.sparkSession
    folder = store.new_folder(spark, "alignment")
    width = len(aligner(path_a, path_b).bytes_b)
    counts = store.materialize(write_chunks(docs, path_a, path_b, folder, id_col=id_col, text_col=text_col, chunk_pairs=chunk_pairs, chunk_bytes=chunk_bytes), "pairs")
    sums = counts.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("total"))
    # At most one row for each id of B.
    best = sums.groupBy((F.col("pair") % width).alias("_b")).agg(F.max("total").alias("_most"))
    judged = sums.join(F.broadcast(best), F.col("pair") % width == F.col("_b")).select("pair", "total", (F.col("total") == F.col("_most")).cast("int").alias("best"))
    wanted = counts.select("chunk", "pair").join(judged, "pair", "left")
    return read_chunks(wanted, folder, id_col, docs.select(id_col).dtypes[0][1], path_a, path_b)
