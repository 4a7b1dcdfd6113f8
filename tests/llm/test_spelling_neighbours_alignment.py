"""Spelling variants, nearest neighbours and alignment against plain versions of the same."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import alignment, nearest, queries, spelling

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# --- spelling ---------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words, factor=5):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def got_variants(frame):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect())


@pytest.mark.parametrize("most", [128, 4])
def test_near_words_of_hot_and_cold_segments(spark, most):
    r = random.Random(3)
    stems = ["recall", "straßen", "çedillaé", "ab", "x", "aaaaaaaaaa"]
    words = {}
    for s in stems:
        for _ in range(30):
            k = r.randrange(len(s) + 1)
            words[r.choice([s[:k] + r.choice("abcé") + s[k:], s[:k] + r.choice("abcé") + s[k + 1 :], s[:k] + s[k + 1 :], s])] = r.choice([5, 6, 30, 31, 200, 1500])
    words.pop("", None)
    frame = spark.createDataFrame([(w, n, "other") for w, n in words.items()], "word string, n long, l string")
    assert got_variants(spelling.variants(frame, most=most)) == plain_variants(words)


def test_a_long_word_and_a_chain(spark):
    long = "ab" * 3000
    words = {long: 500, long + "c": 50, long[:-1] + "d" + "c": 6, "abcdef": 5, "abcdeg": 25, "abcdegh": 125, "abcdxgh": 625}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["abcdef"]["root"] == "abcdxgh" and got["abcdxgh"]["form"] is None
    assert got[long + "c"]["form"] == long and got[long[:-1] + "dc"]["root"] == long


def test_words_of_texts(spark, docs, odd_rows):
    rows = [*odd_rows, *[(100 + k, "Çaptain captain's Wonderful wonderful×ly ÉCOLES écoles straße " * 3) for k in range(300)], (None, "wonderful " * 20)]
    want = collections.Counter()
    lower = str.maketrans(spelling.UPPER, spelling.UPPER.lower())
    for row in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", row[1] or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if row[0] is None else row[0]}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs(rows)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert got_variants(spelling.spelling_variants(docs(rows))) == plain_variants(got)


def test_no_words(spark, docs):
    assert spelling.spelling_variants(docs([])).collect() == []
    assert spelling.spelling_variants(docs([(1, None), (2, "")])).collect() == []


def test_spelling_query(spark):
    words = {r["word"]: r["n"] for r in spelling.word_counts(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert got_variants(queries.op11_spelling(spark, DATA)) == plain_variants(words)


# --- nearest neighbours ---------------------------------------------------------------


def exact(rows, asked, k):
    """The k largest inner products of each asked row: {query: [(id, score)]}."""
    out = {}
    for q, x in asked:
        found = sorted((-float(np.dot(np.array(x, float), np.array(y, float))), i) for i, y in rows if i != q)
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "q", 1.0) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score double").repartition(3)


def found_of(frame):
    out = collections.defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_few_rows_are_found_whole_with_ties_and_copies(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 5)]) for i in range(60)]
    rows = [(i, v) for i, v in rows if any(v)] + [(200 + i, [1.0, 2.0, 0.0, 0.0, 3.0]) for i in range(40)]
    frame = vectors(spark, rows)
    got, want = found_of(nearest.nearest(frame, frame.where("vec_id % 20 = 0"), 20)), exact(rows, [x for x in rows if x[0] % 20 == 0], 20)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9 and all(len(got[q]) == 20 for q in want)
    for q in want:
        assert [x for x in got[q]] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    # Lists are all probed where few rows are asked for: then nothing is missing, in any order of ties.
    some = [x for x in rows if x[0] >= 190 or x[0] < 12]
    frame = vectors(spark, some)
    assert found_of(nearest.nearest(frame, frame.where("vec_id = 200 or vec_id = 220"), 20)) == exact(some, [x for x in some if x[0] in (200, 220)], 20)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [2.0, 0.0]), (4, [-1.0, 0.0])]
    frame = vectors(spark, rows)
    assert found_of(nearest.nearest(frame, frame.where("vec_id % 20 = 0"), 20)) == exact(rows, rows[:2], 20)
    one = vectors(spark, rows[:1])
    assert nearest.nearest(one, one, 20).collect() == []


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [None, 1.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [3.0, 1.0]), (6, [3.0]), (7, []), (5, [3.0, 1.0])]
    frame = vectors(spark, rows)
    assert found_of(nearest.nearest(frame, frame.where("vec_id % 20 = 0"), 3)) == {0: [(5, 5.0)]}
    none = frame.limit(0)
    assert nearest.nearest(none, none).collect() == []
    assert nearest.nearest(frame, frame.limit(0)).collect() == []


def test_cells_of_a_hot_list_and_lengths_that_differ(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 150)
    monkeypatch.setattr(nearest, "QUERIES", 20)
    r = np.random.default_rng(9)
    near = r.normal(size=12) * 3
    rows = [(i, (near + r.normal(size=12) * 0.2 if i % 3 == 0 else r.normal(size=12) * r.choice([0.5, 1, 4])).tolist()) for i in range(1500)]
    frame = vectors(spark, rows)
    got, want = found_of(nearest.nearest(frame, frame.where("vec_id % 20 = 0"), 20)), exact(rows, [x for x in rows if x[0] % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_scan_abandons_but_keeps_the_nearest():
    r = np.random.default_rng(2)
    rows, asked = r.normal(size=(3000, 64)), r.normal(size=(50, 64))
    all_ = nearest.distances(asked, rows)
    best = np.sort(all_, 1)[:, 60]
    q, i = nearest.scan(rows, asked, best, 20)
    found = collections.defaultdict(set)
    for a, b in zip(q.tolist(), i.tolist(), strict=True):
        found[a].add(b)
    assert np.mean([len(found[k] & set(all_[k].argsort()[:20].tolist())) / 20 for k in range(50)]) > 0.99
    assert len(q) < 50 * 25


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got, want = found_of(queries.op12_nearest(spark, DATA)), exact(rows, [x for x in rows if x[0] % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    exactly = {q: {i: float(np.dot(np.array(v, float), np.array(dict(rows)[q], float))) for i, v in rows} for q in got}
    assert all(abs(s - exactly[q][i]) < 1e-12 for q, hits in got.items() for i, s in hits)


# --- alignment ------------------------------------------------------------------------------


def plain_alignment(rows):
    """By walking both token lists, with whole texts and the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    know = alignment.aligner(A, B)
    counts, made = collections.Counter(), []
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts_a, parts_b = [know.bytes_a[x] for x in ids_a], [know.bytes_b[x] for x in ids_b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            made.append((i, 0, 0, "", []))
            continue
        ends = [np.cumsum(list(map(len, p))).tolist() for p in (parts_a, parts_b)]
        j = k = 0
        links, groups = [(0, 0)], [([ids_a[0]], [ids_b[0]])]
        while (j, k) != (len(ids_a) - 1, len(ids_b) - 1):
            x, y = ends[0][j], ends[1][k]
            if x == y:
                groups.append(([], []))
            if x <= y:
                j += 1
                groups[-1][0].append(ids_a[j])
            if y <= x:
                k += 1
                groups[-1][1].append(ids_b[k])
            links.append((j, k))
        links = [(ids_a[j], ids_b[k]) for j, k in links]
        counts.update(links)
        made.append((i, len(ids_a), len(ids_b), ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups), links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (repr(i), n, m, text.count(";") + 1 if text else 0, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "") for i, n, m, text, links in made
    )


def got_alignment(frame):
    return sorted((repr(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in frame.collect())


ODD = ["a  b", " lead", "trail ", "▁bar", "x <|endoftext|> y <s> </s>", "naïve café 日本語 😀", "tab\there", "a\n\nb \n c", "Hello,\nworld. (yes)", "\x00\x01", "é" * 50, "w" * 300, "  ", "  x", "ﬁ ligature"]


def test_alignment_of_odd_texts(spark, docs, odd_rows):
    rows = [*[(r[0], r[1]) for r in odd_rows], *[(50 + k, t) for k, t in enumerate(ODD)]]
    assert got_alignment(alignment.align_tokens(docs(rows), A, B)) == plain_alignment(rows)


def test_chunks_end_at_their_bounds(spark, docs):
    rows = [(k, f"word{k} and some other text, {k * 7919} of it") for k in range(5000)]
    assert got_alignment(alignment.align_tokens(docs(rows), A, B, chunk_pairs=100, chunk_bytes=20_000)) == plain_alignment(rows)


def test_no_documents_to_align(spark, docs):
    assert alignment.align_tokens(docs([]), A, B).collect() == []


def test_owners_in_blocks(monkeypatch):
    r = np.random.default_rng(4)
    a = r.integers(1, 6, 4000)
    total = int(a.sum())
    b = np.diff(np.unique(np.concatenate([[0, total], r.integers(1, total, 3000), np.cumsum(a)[::7]])))
    whole = alignment.owners(a, b)
    monkeypatch.setattr(alignment, "BLOCK", 64)
    assert all((x == y).all() for x, y in zip(whole, alignment.owners(a, b), strict=True))


def test_alignment_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got_alignment(queries.op13_alignment(spark, DATA)) == plain_alignment(rows)
