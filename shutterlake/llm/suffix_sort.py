"""Suffix arrays by induced sorting.

Over few values NumPy does a bucket's work at a time; over many (the strings of
names, whose buckets hold a few suffixes each) LMS substrings are sorted by their
symbols and suffixes are induced one by one.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour.
Leftmost S suffixes (LMS) split the text into substrings; one induced pass sorts
these, equal ones get one name, and the string of names is sorted in turn.  A
last induced pass, linear in the text, sorts all suffixes from the sorted LMS
ones.  Texts are concatenations of parts: value 0 ends a part, and such ends
count as distinct values in order of position.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True for S: smaller than the right neighbour's suffix. A part's end is S, as nothing is smaller."""
    n = len(t)
    differs = np.empty(n, bool)
    differs[-1] = True
    differs[:-1] = t[:-1] != t[1:]
    differs |= t == 0
    smaller = np.empty(n, bool)
    smaller[-1] = True
    smaller[:-1] = t[:-1] < t[1:]
    smaller[t == 0] = True
    # A run of one value is as its last member is.
    at = np.where(differs, np.arange(n), n)
    return smaller[np.minimum.accumulate(at[::-1])[::-1]]


class _Buckets:
    """Suffixes by first value, filled from one end in batches."""

    def __init__(self, t: np.ndarray, sigma: int):
        self.t, self.sigma = t, sigma
        self.parts: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def put(self, suffixes: np.ndarray) -> None:
        keys = self.t[suffixes]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for part in np.split(suffixes[order], cuts):
            self.parts[self.t[part[0]]].append(part)


def _induce_in_batches(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from LMS suffixes given in order within each first value."""
    none = np.zeros(0, np.int64)
    seeds = _Buckets(t, sigma)
    if len(lms):
        seeds.put(lms)
    seed = [np.concatenate(p) if p else none for p in seeds.parts]
    large = _Buckets(t, sigma)

    def before(batch, wanted_s):
        pred = batch[batch > 0] - 1
        return pred[is_s[pred] == wanted_s]

    for c in range(sigma):
        done = 0
        # A run of one value induces into its own bucket, a batch for each further member.
        while done < len(large.parts[c]):
            batch = np.concatenate(large.parts[c][done:])
            done = len(large.parts[c])
            pred = before(batch, False)
            if len(pred):
                large.put(pred)
        pred = before(seed[c], False)
        if len(pred):
            large.put(pred)
    small = _Buckets(t, sigma)
    out: list[np.ndarray] = []
    for c in range(sigma - 1, -1, -1):
        done = 0
        if c == 0:
            # Part ends are told apart by their places, and nothing else is this small.
            out.append(np.flatnonzero(t == 0)[::-1])
            break
        while done < len(small.parts[c]):
            batch = np.concatenate(small.parts[c][done:])
            done = len(small.parts[c])
            pred = before(batch, True)
            pred = pred[t[pred] > 0]
            if len(pred):
                small.put(pred)
        ls = np.concatenate(large.parts[c])[::-1] if large.parts[c] else none
        pred = before(ls, True)
        pred = pred[t[pred] > 0]
        if len(pred):
            small.put(pred)
        out += [*small.parts[c], ls]
    return np.concatenate(out)[::-1]


def _induce_one_by_one(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The same over values whose buckets are small."""
    n = len(t)
    counts = np.bincount(t, minlength=sigma)
    tails = np.cumsum(counts)
    order = np.full(n, -1, np.int64)
    keys = t[lms]
    by_value = np.argsort(keys, kind="stable")
    keys = keys[by_value]
    order[tails[keys] - np.searchsorted(keys, keys, "right") + np.arange(len(keys))] = lms[by_value]
    out, head, tail = order.tolist(), (tails - counts).tolist(), tails.tolist()
    # The list is filled ahead of its reader.  A bucket of -1: the suffix belongs to the other pass.
    bucket = np.where(is_s, -1, t).tolist()
    for at in out:
        if at > 0:
            c = bucket[at - 1]
            if c >= 0:
                out[head[c]] = at - 1
                head[c] += 1
    bucket = np.where(is_s & (t > 0), t, -1).tolist()
    for at in reversed(out):
        if at > 0:
            c = bucket[at - 1]
            if c >= 0:
                tail[c] -= 1
                out[tail[c]] = at - 1
    # Part ends are told apart by their places.
    ends = np.flatnonzero(t == 0)
    return np.concatenate([ends, np.array(out[len(ends) :], np.int64)])


#: Suffixes that a bucket must have on average for batches to pay.
BATCH = 64


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from LMS suffixes given in order within each first value."""
    return (_induce_one_by_one if len(t) < BATCH * sigma else _induce_in_batches)(t, is_s, lms, sigma)


def _named(t: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """A name for each LMS substring in ``ordered``: equal substrings, equal names; part ends are all distinct."""
    n = len(t)
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = n - lms[-1]
    a, b = ordered[:-1], ordered[1:]
    same = (length[a] == length[b]) & (t[a] == t[b]) & (t[a] != 0)
    live = np.flatnonzero(same)
    k = 1
    while len(live):
        live = live[length[a[live]] > k]
        x, y = a[live] + k, b[live] + k
        # A substring that runs into a part's end differs there: ends are distinct.
        unequal = (t[x] != t[y]) | (t[x] == 0)
        same[live[unequal]] = False
        live = live[~unequal]
        k += 1
    return np.concatenate([[0], np.cumsum(~same)])


def _sorted_substrings(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """A name for each LMS substring in text order, by sorting them symbol after symbol; equal ones get one name.

    A symbol counts with its type (larger suffixes before smaller ones), so that equal
    substrings end together; part ends are distinct symbols before all others.  Only
    what is tied so far is looked at again.
    """
    ends = t == 0
    symbol = 2 * np.where(ends, np.cumsum(ends) - 1, t + int(ends.sum())) + is_s
    length = np.diff(np.append(lms, len(t) - 1)) + 1
    # The place in order at which a group of equals begins.
    rank = np.zeros(len(lms), np.int64)
    live, k = np.arange(len(lms)), 0
    while len(live):
        key, own = symbol[lms[live] + k], rank[live]
        order = np.lexsort((key, own))
        live, key, own = live[order], key[order], own[order]
        new_group = np.concatenate([[True], own[1:] != own[:-1]])
        new_block = new_group | np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(live))
        group, block = np.maximum.accumulate(np.where(new_group, at, 0)), np.maximum.accumulate(np.where(new_block, at, 0))
        rank[live] = own + block - group
        single = new_block & np.concatenate([new_block[1:], [True]])
        k += 1
        live = live[~single & (length[live] > k)]
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of ``t`` (integers, 0 at the end of each part) in order."""
    t = np.asarray(t)
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    if t[-1] != 0:
        raise ValueError("the last value must end a part")
    sigma = int(t.max()) + 1
    is_s = classify(t)
    lms = np.flatnonzero((is_s & ~np.concatenate([[True], is_s[:-1]])) | (t == 0))
    if n < BATCH * sigma:
        names = _sorted_substrings(t, is_s, lms)
        ordered = lms[np.argsort(names, kind="stable")]
    else:
        mark = np.zeros(n, bool)
        mark[lms] = True
        first = induce(t, is_s, lms, sigma)
        ordered = first[mark[first]]
        at = np.empty(n, np.int64)
        at[ordered] = _named(t, ordered, lms)
        names = at[lms]
    if names.max() < len(lms) - 1:
        # Names of part ends are the least; they stay ends one level up.
        ends = t[lms] == 0
        ordered = lms[suffix_array(np.where(ends, 0, names - int(ends.sum()) + 1))]
    return induce(t, is_s, ordered, sigma)


def permuted_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in text order: its predecessor in ``order`` (-1: none) and their common prefix, up to ``most``.

    ``t``: bytes of the text followed by ``most`` + 8 others.  ``order`` may leave suffixes out.
    """
    n = len(t) - most - 8
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(t, (len(t) - 7, 8), (1, 1))).view("<u8").ravel()
    common = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    k = 0
    while k < most and len(live):
        apart = words[live + k] ^ words[np.minimum(before[live] + k, len(words) - 1)]
        # The lowest set bit lies in the first byte that differs.
        low = apart & (~apart + np.uint64(1))
        equal = np.where(apart == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)) // 8)
        common[live] = np.minimum(k + equal, most)
        live = live[apart == 0]
        k += 8
    return before, common
