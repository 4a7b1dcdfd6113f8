"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Test items are cut into segments of at most ``segment`` words and indexed.  A
training text is read in overlapping passages of twice that length; each is a
query of its distinct words against the index.  Scores are divided by what the
segment's own words would score, so the threshold means the same for all items.
What is retrieved is verified: the item's question and its answer must both be
found again, by their five-word shingles (a short answer counts as part of the
question, as one changed word would hide it).

A passage enters the search only if it could succeed: a segment's words of least
impact are left out of its *essential* lists as long as they can't reach half
the threshold together, and the essential words that a passage shares with a
segment must make up for the rest.  This bound is safe, and it is taken for many
passages at once.
"""

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store

PUNCTUATION = ".,;:!?\"'()[]{}<>«»¿¡*#|…-–—"


@dataclass(frozen=True)
class DecontaminationParams:
    segment: int = 48
    threshold: float = 0.5
    shingle: int = 5
    #: Of all the item's shingles, and of the question's and the answer's each.
    overlap: float = 0.8
    part_overlap: float = 0.5
    #: A shorter answer counts with the question.
    answer_words: int = 8
    k1: float = 1.2
    b: float = 0.75
    block: int = 64
    #: Characters of test items in one index; more items make more indexes, searched one after the other, with the same statistics.
    index_chars: int = 8_000_000


def words(text: str) -> list[str]:
    """Lower-case words without punctuation around them."""
    return [w for x in text.lower().split() if (w := x.strip(PUNCTUATION))]


def question_and_answer(text: str) -> tuple[str, str]:
    """The last line is the answer, or else the last sentence; '' where there is one sentence only."""
    text = text.strip()
    head, cut, tail = text.rpartition("\n")
    if cut and head.strip():
        return head, tail
    ends = [m.end() for m in re.finditer(r"[.?!]\s+", text)]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


def grams(tokens: list[str], size: int) -> set[tuple[str, ...]]:
    """All shingles; a shorter list is one."""
    if not tokens:
        return set()
    return {tuple(tokens[k : k + size]) for k in range(max(1, len(tokens) - size + 1))}


def cut(text: str, size: int) -> list[Counter]:
    """The words of an item's segments: as few as hold ``size`` words at most, of one length."""
    tokens = words(text)
    parts = max(1, math.ceil(len(tokens) / size))
    step = math.ceil(len(tokens) / parts)
    return [Counter(tokens[k * step : (k + 1) * step]) for k in range(parts) if tokens[k * step : (k + 1) * step]]


class Statistics:
    """Number, mean length and document frequencies of the segments of all items, however many indexes these make."""

    def __init__(self, texts, p: DecontaminationParams):
        self.n = total = 0
        self.found: Counter = Counter()
        for text in texts:
            for c in cut(text, p.segment):
                self.n += 1
                total += c.total()
                self.found.update(c.keys())
        self.mean = total / max(1, self.n)

    def idf(self, word: str) -> float:
        d = self.found[word]
        return math.log(1 + (self.n - d + 0.5) / (d + 0.5))


class _Made:
    """A sequence of what a function gives for each place."""

    def __init__(self, make, n: int):
        self.make, self.n = make, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int):
        if not 0 <= i < self.n:
            raise IndexError(i)
        return self.make(i)


class Index:
    """Segments of test items with their impacts: lists in order of segments, one after the other in flat arrays, in blocks with their maxima.

    About 10 bytes for each character of the items; shingles are made when an item is verified.
    """

    def __init__(self, items: list[tuple], p: DecontaminationParams, statistics: Statistics | None = None):
        self.p = p
        self.items = items
        known = statistics or Statistics((text for _, text in items), p)
        names: dict[str, int] = {}
        self.item_of = array("i")
        term, segment, impact, essential = array("i"), array("i"), array("d"), array("b")
        rest = array("d")
        for i, (_, text) in enumerate(items):
            for c in cut(text, p.segment):
                norm = p.k1 * (1 - p.b + p.b * c.total() / known.mean)
                gains = {w: known.idf(w) * f * (p.k1 + 1) / (f + norm) for w, f in c.items()}
                own = sum(gains.values())
                left, spared = p.threshold / 2, 0.0
                for w in sorted(c, key=lambda w: (gains[w], w)):
                    x = gains[w] / own
                    term.append(names.setdefault(w, len(names)))
                    segment.append(len(self.item_of))
                    impact.append(x)
                    essential.append(x >= left)
                    if x < left:
                        left -= x
                        spared += x
                    else:
                        left = 0
                rest.append(spared)
                self.item_of.append(i)
        self.term = names
        self.rest = np.array(rest)
        term, segment, impact = np.array(term), np.array(segment), np.array(impact)
        order = np.lexsort((segment, term))
        needed = order[np.array(essential, bool)[order]]
        bounds = np.arange(len(names) + 1)
        self.starts, self.segments, self.impacts = np.searchsorted(term[needed], bounds), segment[needed], impact[needed]
        begins = np.searchsorted(term[order], bounds)
        self.begins, self.at, self.gain = array("q", begins.tolist()), array("i", segment[order].tolist()), array("d", impact[order].tolist())
        # A list's blocks begin anew with it, so their places follow from its own.
        blocks = -(-np.diff(begins) // p.block)
        self.first_block = array("q", np.concatenate([[0], np.cumsum(blocks)]).tolist())
        cuts = np.concatenate([np.arange(a, b, p.block) for a, b in zip(begins[:-1], begins[1:], strict=True)] or [np.zeros(0, np.int64)])
        self.block_max = array("d", np.maximum.reduceat(impact[order], cuts).tolist() if len(cuts) else [])
        self.list_max = array("d", np.maximum.reduceat(impact[order], begins[:-1]).tolist() if len(names) else [])

    @property
    def lists(self) -> _Made:
        """(segment, impact) of each term."""
        return _Made(lambda t: [(self.at[k], self.gain[k]) for k in range(self.begins[t], self.begins[t + 1])], len(self.term))

    def parts(self, i: int) -> tuple[set, set]:
        """Shingles of an item's question and answer."""
        text = self.items[i][1]
        q, a = question_and_answer(text)
        if len(words(a)) < self.p.answer_words:
            q, a = text, ""
        return grams(words(q), self.p.shingle), grams(words(a), self.p.shingle)

    @property
    def questions(self) -> _Made:
        return _Made(lambda i: self.parts(i)[0], len(self.items))

    @property
    def answers(self) -> _Made:
        return _Made(lambda i: self.parts(i)[1], len(self.items))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All segments of at least the threshold and their scores, by block-max WAND over the terms' lists."""
        need = self.p.threshold - 1e-9
        size, at, gain, maxima = self.p.block, self.at, self.gain, self.block_max
        # A cursor: its segment, its place, its list's begin and end, the list's maximum and first block.
        cursors = [[at[a], a, a, b, self.list_max[t], self.first_block[t]] for t in terms for a, b in ((self.begins[t], self.begins[t + 1]),) if b > a]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[4]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # The blocks that would hold the target bound its score more closely than whole lists do.
            near, after = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for _, place, begin, end, _, block in cursors[: pivot + 1]:
                k = (place - begin) // size
                while (last := min(end, begin + (k + 1) * size) - 1) < end - 1 and at[last] < target:
                    k += 1
                near += maxima[block + k]
                after = min(after, at[last] + 1)
            to = target + 1
            if near < need:
                to = max(to, after) if after != math.inf else to
            elif cursors[0][0] == target:
                score = sum(gain[c[1]] for c in cursors[: pivot + 1])
                if score >= need:
                    found.append((target, score))
            else:
                to = target
            for c in cursors[: pivot + 1]:
                c[1] = bisect_left(at, to, c[1], c[3])
                c[0] = at[c[1]] if c[1] < c[3] else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def passages(self, ids: np.ndarray, starts: np.ndarray, doc_of: np.ndarray) -> list[tuple[int, int]]:
        """(document, passage) of those that may reach the threshold, for the term ids (-1: none) of concatenated documents."""
        step, n = self.p.segment, len(self.rest)
        at = np.flatnonzero(ids >= 0)
        at = at[self.starts[ids[at] + 1] > self.starts[ids[at]]]
        if not len(at):
            return []
        passage = (at - starts[at]) // step
        doc, term = doc_of[at], ids[at].astype(np.int64)
        # A position lies in the passage that begins in its step and in the one before.
        doc, term = np.tile(doc, 2), np.tile(term, 2)
        passage = np.concatenate([passage, passage - 1])
        doc, passage, term = (x[passage >= 0] for x in (doc, passage, term))
        width = int(passage.max()) + 1
        place, term = np.divmod(np.unique((doc * width + passage) * len(self.term) + term), len(self.term))
        size = self.starts[term + 1] - self.starts[term]
        each = np.repeat(self.starts[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        keys, back = np.unique(np.repeat(place, size) * n + self.segments[each], return_inverse=True)
        reach = np.bincount(back, weights=self.impacts[each]) + self.rest[keys % n]
        return [divmod(int(k), width) for k in np.unique(keys[reach >= self.p.threshold - 1e-9] // n)]


class _Terms(dict):
    """Term ids of words as they stand in texts; kept up to a bound of characters (each word counts 60 more), long ones not at all."""

    LIMIT, LONGEST = 40_000_000, 64

    def __init__(self, index: Index):
        super().__init__()
        self.term, self.held = index.term, 0

    def __missing__(self, word: str) -> int:
        w = word.strip(PUNCTUATION)
        # Words of punctuation alone are no words: they take no place in a passage.
        value = self.term.get(w, -1) if w else -2
        if len(word) <= self.LONGEST:
            if self.held > self.LIMIT:
                self.clear()
                self.held = 0
            self[word] = value
            self.held += len(word) + 60
        return value


def matches(index: Index, terms: _Terms, texts: list[str | None]) -> list[list[tuple[int, float, float, float, float]]]:
    """For each text the (item, score, overlap of question, answer and both) of all that the search retrieves."""
    arrays = [np.array(list(map(terms.__getitem__, (t or "").lower().split())), np.int64) for t in texts]
    arrays = [a[a != -2] for a in arrays]
    sizes = np.array([len(a) for a in arrays], np.int64)
    out: list[list] = [[] for _ in texts]
    if not sizes.sum() or not len(index.rest):
        return out
    starts = np.cumsum(sizes) - sizes
    hits: dict[int, dict[int, float]] = {}
    for doc, passage in index.passages(np.concatenate(arrays), np.repeat(starts, sizes), np.repeat(np.arange(len(texts)), sizes)):
        a = arrays[doc][passage * index.p.segment : (passage + 2) * index.p.segment]
        for s, score in index.search(np.unique(a[a >= 0]).tolist()):
            best = hits.setdefault(doc, {})
            best[index.item_of[s]] = max(score, best.get(index.item_of[s], 0.0))
    for doc, best in hits.items():
        own = words(texts[doc])
        have = grams(own, index.p.shingle)
        parts = {i: index.parts(i) for i in best}
        shorter = {n: grams(own, n) for both in parts.values() for g in both for n in {len(x) for x in g} if n != index.p.shingle}

        def found(wanted, have=have, shorter=shorter):
            return sum(g in (have if len(g) == index.p.shingle else shorter[len(g)]) for g in wanted)

        for i, score in sorted(best.items()):
            q, a = parts[i]
            x, y = found(q), found(a)
            out[doc].append((i, round(score, 6), x / len(q), y / len(a) if a else 1.0, (x + y) / (len(q) + len(a))))
    return out


def verified(match: tuple, p: DecontaminationParams) -> bool:
    return match[4] >= p.overlap and match[2] >= p.part_overlap and match[3] >= p.part_overlap


def indexes(items: DataFrame, p: DecontaminationParams, id_col: str, text_col: str):
    """Indexes of all items that have a word, each over a bounded number of characters; a pass over all items gives their common statistics."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(r"\S")).distinct()
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / p.index_chars))

    def block(k):
        found = [(r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()]
        return sorted((x for x in found if words(x[1])), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    if blocks == 1:
        yield Index(block(0), p)
        return
    known = Statistics((r["text"] for k in range(blocks) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).select("text").collect()), p)
    for k in range(blocks):
        yield Index(block(k), p, known)


#: A worker's term ids for the index it used last.
_last: list = [None, None]


def _terms(index: Index) -> _Terms:
    if _last[0] is not index:
        _last[:] = [index, _Terms(index)]
    return _last[1]


def _forget() -> None:
    _last[:] = [None, None]


BATCH = 256


def find_leaks(
    docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams(), *,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``id_col, item_id_col, score, question_overlap, answer_overlap, leaked``: a row for each document and item retrieved.

    Null and empty texts, and items without words, match nothing.  A document
    shorter than a passage is one passage.  Rows that repeat an id each give
    their rows; other columns are not looked at.  No shuffle: an index is
    broadcast, and its size has a bound that documents don't raise.
    """
    spark = docs.sparkSession
    p = params
    kinds = docs.select(id_col).dtypes[0][1], items.select(item_id_col).dtypes[0][1]
    schema = f"{id_col} {kinds[0]}, {item_id_col} {kinds[1]}, score double, question_overlap double, answer_overlap double, leaked boolean"
    texts = store.spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")))
    found = None
    for index in indexes(items, p, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches, shared=shared):
            store.starts("decontamination", _forget)
            index = shared.value
            kind = None
            for batch in batches:
                kind = batch.schema.field(0).type
                for k in range(0, batch.num_rows, BATCH):
                    part = batch.slice(k, BATCH)
                    rows = [(n, *m) for n, ms in enumerate(matches(index, _terms(index), part.column(1).to_pylist())) for m in ms]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(0).take(pa.array([r[0] for r in rows])).cast(kind), pa.array([index.items[r[1]][0] for r in rows]),
                                *[pa.array([r[c] for r in rows], pa.float64()) for c in (2, 3, 4)], pa.array([verified(r[1:], index.p) for r in rows]),
                            ],
                            names=[f.split()[0] for f in schema.split(", ")],
                        )

        part = texts.mapInArrow(scan, schema)
        found = part if found is None else found.union(part)
    return found


def remove_leaks(
    docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams(), *,
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which no item is verified, with all their columns; decided where a row is read.

    Null and empty texts stay, and so does every row if there are no items with
    words; very long texts are searched whole; repeated rows and null ids are judged
    each by itself.  No rows: no rows.  Columns may have any names.
    """
    spark = docs.sparkSession
    docs = store.spread(docs)
    for index in indexes(items, params, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        docs = docs.where(~_leaks(shared)(F.col(text_col)))
    return docs


def _leaks(shared):
    @F.pandas_udf("boolean")
    def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for texts in parts:
            values = texts.tolist()
            flags = []
            for k in range(0, len(values), BATCH):
                flags += [any(verified(m, index.p) for m in ms) for ms in matches(index, _terms(index), values[k : k + BATCH])]
            yield pd.Series(flags, dtype=bool)

    return leaks
