"""SentencePiece merge-type encoding by backtracking, and decoding.

Merging takes the best adjacent pair again and again.  The same result is found
from left to right: take the longest piece that an Aho-Corasick automaton finds
at a position, check that it may stand beside its left neighbour (merging both
again must leave the border in place), else take the next shorter piece, else
step back and mark the position as failed in a bit field.  Time is linear in the
text, whatever the order of merges.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store

BAR = "▁"


class MergeCodec:
    """The pieces of a merge-type model with byte fallback, an identity normaliser and a leading space."""

    #: Characters of the stretches whose ids are kept (each counts 30 more), and the longest that is kept.
    LIMIT, LONGEST = 16_000_000, 64
    #: Borders of two pieces that are kept with their verdict.
    BORDERS = 2_000_000
    UNITS = re.compile(f"{BAR}+[^{BAR}]*")

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(m.get_piece_size()) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)]
        self.bytes = {int(m.id_to_piece(i)[1:-1], 16): i for i in special if m.is_byte(i)}
        ids = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if i not in set(special)}
        self.score = {p: m.get_score(i) for p, i in ids.items()}
        self.id_of = ids
        # Pieces never hold a bar after another character, so a text can be cut before each run of bars.
        if any(BAR in p.lstrip(BAR) or p.startswith(BAR * 2) and p.strip(BAR) for p in ids):
            raise ValueError("pieces of this model cross words")
        if len(self.bytes) != 256 or any(c not in ids for p in ids for c in p):
            raise ValueError("this model lacks byte pieces or single characters")
        single = sorted(p for p in ids if len(p) == 1)
        merged = sorted((p for p in ids if len(p) > 1 and p.strip(BAR)), key=lambda p: -self.score[p])
        if len({self.score[p] for p in merged}) < len(merged):
            raise ValueError("two pieces of this model have one score")
        self._build(single, merged, ahocorasick.Automaton())
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.held = 0
        self.borders: dict[int, bool] = {}

    def _build(self, single: list[str], merged: list[str], automaton) -> None:
        """Ranks: characters first, then pieces from the first merge to the last."""
        rank = {p: r for r, p in enumerate(single + merged)}
        self.size = [len(p) for p in rank]
        self.ids = [self.id_of[p] for p in rank]
        self.shorter = [-1] * len(rank)
        self.split = [(r, r) for r in range(len(rank))]
        self.pairs: dict[tuple[int, int], int] = {}
        reachable = set(range(len(single)))
        for p in merged:
            r = rank[p]
            cuts = [(rank[p[:k]], rank.get(p[k:], r)) for k in range(len(p) - 1, 0, -1) if p[:k] in rank]
            for left, right in cuts:
                if left < r and right < r and left in reachable and right in reachable and self.fits(left, right):
                    self.pairs[left, right] = r
                    self.split[r] = (left, right)
                    reachable.add(r)
                    break
        for p, r in rank.items():
            if r in reachable:
                automaton.add_word(p, (len(p) - 1, r))
                self.shorter[r] = next((rank[p[:k]] for k in range(len(p) - 1, 0, -1) if rank.get(p[:k], -1) in reachable), -1)
        automaton.make_automaton()
        self.automaton = automaton
        self.characters = set(single)
        self.unknown = re.compile("[^" + re.escape("".join(single)) + "]")

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters again leaves the border between them.

        Both sides are taken apart from the latest merge to the earliest; a pair
        across the border that merges before the later of the two refutes it.
        """
        pairs, split, least = self.pairs, self.split, len(self.size)
        while True:
            if pairs.get((left, right), least) < least:
                return False
            if left > right:
                least = left
                left = split[left][1]
                if left == least:
                    least, right = right + 1, split[right][0]
                    if right + 1 == least:
                        return True
            else:
                least = right + 1
                right = split[right][0]
                if right + 1 == least:
                    least, left = left, split[left][1]
                    if left == least:
                        return True

    def ranks(self, text: str) -> list[int]:
        """Ranks of the pieces of a stretch of known characters."""
        n, size, shorter, borders = len(text), self.size, self.shorter, self.borders
        longest = [0] * n
        # Matches come by their ends, so the longest from a place comes last.
        for end, (back, r) in self.automaton.iter(text):
            longest[end - back] = r
        if n == 0 or size[longest[0]] == n:
            return longest[:1]
        if len(borders) > self.BORDERS:
            borders.clear()
        failed, out, at = bytearray((n >> 3) + 1), [], 0
        token, pieces = longest[0], len(size)
        while True:
            end = at + size[token]
            good = not failed[end >> 3] >> (end & 7) & 1
            if good and out:
                border = out[-1] * pieces + token
                good = borders.get(border)
                if good is None:
                    good = borders[border] = self.fits(out[-1], token)
            if good:
                out.append(token)
                if end == n:
                    return out
                at = end
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= size[token]

    def _run(self, n: int) -> list[int]:
        """Ids of a run of bars.  Their pieces share one score, so the leftmost pair goes first; runs are short and their ids are kept."""
        parts, alive = [BAR] * n, [True] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(a, b):
            if a >= 0 and b < n and parts[a] + parts[b] in self.id_of:
                heapq.heappush(queue, (-self.score[parts[a] + parts[b]], a, b, len(parts[a]) + len(parts[b])))

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, size = heapq.heappop(queue)
            if alive[a] and alive[b] and after[a] == b and len(parts[a]) + len(parts[b]) == size:
                parts[a] += parts[b]
                alive[b] = False
                after[a] = after[b]
                if after[b] < n:
                    before[after[b]] = a
                offer(before[a], a)
                offer(a, after[a])
        return [self.id_of[p] for p, ok in zip(parts, alive, strict=True) if ok]

    def _stretch(self, text: str) -> list[int]:
        if not self.unknown.search(text):
            return [self.ids[r] for r in self.ranks(text)]
        out, at = [], 0
        for m in self.unknown.finditer(text):
            out += [self.ids[r] for r in self.ranks(text[at : m.start()])]
            out += [self.bytes[b] for b in m[0].encode()]
            at = m.end()
        return out + [self.ids[r] for r in self.ranks(text[at:])]

    def unit(self, text: str) -> list[int]:
        """Ids of a run of bars and what follows it up to the next bar."""
        rest = text.lstrip(BAR)
        bars = len(text) - len(rest)
        if not rest:
            return self._run(bars)
        ids = self._stretch(BAR + rest)
        if bars == 1:
            return ids
        # The last bar merges into the word before bars merge with each other, or it stays with them.
        return self._run(bars) + ids[1:] if ids[0] == self.id_of[BAR] else self._run(bars - 1) + ids

    def units(self, text: str) -> Iterable[tuple[str, tuple[int, ...]]]:
        """(ids as text, ids) for each stretch of a text; each distinct one is encoded once."""
        if not text:
            return []
        text = BAR + text.replace(" ", BAR)
        keys = [u[1:] for u in self.UNITS.findall(text)] if BAR * 2 in text else text[1:].split(BAR)
        missing = set(keys).difference(self.known)
        if self.held > self.LIMIT:
            self.known, self.held = {}, 0
            missing = set(keys)
        known, long = self.known, {}
        for k in missing:
            ids = self.unit(BAR + k)
            made = " ".join(map(str, ids)), tuple(ids)
            if len(k) > self.LONGEST:
                long[k] = made
            else:
                known[k] = made
                self.held += len(k) + 30
        return [long[k] if k in long else known[k] for k in keys] if long else [known[k] for k in keys]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for _, ids in self.units(text)))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_codecs: dict[str, MergeCodec] = {}


def codec(path: str) -> MergeCodec:
    """One for each worker process: its table of encoded words serves all tasks there."""
    if path not in _codecs:
        _codecs[path] = MergeCodec(path)
    return _codecs[path]


def encoded(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """``id_col, ids, decoded``: the ids of each whole text with the end id, and what they decode to.

    Null and empty texts are the end id alone and decode to ''.  Rows with equal
    ids each give a row; other columns are not looked at.  No shuffle.
    """

    def run(batches):
        store.starts("sentencepiece", _codecs.clear)
        code = codec(model_path)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                ids = [[*code.encode(t or ""), end_id] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([code.decode(x) for x in ids], pa.string())], names=[id_col, "ids", "decoded"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"{_kind(docs, id_col)}, ids array<int>, decoded string")


ROWS = 500


def digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of what ``encoded`` gives, taken where the ids are made."""

    def run(batches):
        store.starts("sentencepiece", _codecs.clear)
        code = codec(model_path)
        for batch in batches:
            counts, hashes, texts = [], [], []
            for t in batch.column(1).to_pylist():
                units = code.units(t or "")
                ids = [*chain.from_iterable(x for _, x in units), end_id]
                counts.append(len(ids))
                hashes.append(hashlib.sha256(" ".join([*[s for s, _ in units], str(end_id)]).encode()).hexdigest())
                texts.append(hashlib.sha256(code.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"{_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return store.spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")))


def _kind(docs: DataFrame, id_col: str) -> str:
    return f"{id_col} {docs.select(id_col).dtypes[0][1]}"
