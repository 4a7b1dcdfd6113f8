"""The parts whose results can be computed another way: against that way."""

import gzip
import hashlib
import io
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shutterlake.llm import decontaminate, license_scan, minhash_dedup, pii, quality_rules, sentencepiece_codec, store, suffix_dedup, token_output, url_filter, warc
from shutterlake.llm.queries import vocabulary
from shutterlake.llm.sentencepiece_codec import MergeCodec
from shutterlake.llm.suffix_sort import permuted_prefixes, suffix_array
from shutterlake.llm.token_output import CachedEncoder, EliasFano

ALPHABET = list("abthe in  \n\t.,;:!?éçñ0123'▁\x85\u3000\x1c") + ["☃", "the ", "ing", "\n\n", "  ", "𝒳", "\x00", "'s", "x.\nY"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=50).map("".join)


@pytest.fixture(scope="module")
def pieces():
    return MergeCodec(vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    return CachedEncoder(vocabulary("byte_bpe_50k.json"))


def test_sentencepiece_is_the_library(pieces):
    @settings(max_examples=500, deadline=None)
    @given(TEXTS)
    def check(text):
        assert pieces.encode(text) == pieces.library.encode(text)

    check()
    for bars in [*range(1, 40), 300]:
        for rest in ("", "x", "\n", "the"):
            assert pieces.encode(" " * bars + rest) == pieces.library.encode(" " * bars + rest)


def test_texts_without_spaces(pieces):
    r = random.Random(4)
    for made in ("".join(r.choice("abcdefghij\n☃e") for _ in range(300_000)), "the" * 300_000, "a" * 50_000, "".join(r.choice("的一是不了人我在有他") for _ in range(100_000))):
        assert pieces.encode(made) == pieces.library.encode(made)
    assert all(len(k) <= pieces.LONGEST for k in pieces.known)


def test_digests_of_a_table(spark, docs, odd_rows):
    path = vocabulary("piece_bpe_32k.model")
    library = MergeCodec(path).library
    want = []
    for i, t, *_ in odd_rows:
        ids = [*library.encode(t or ""), 2]
        want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [(r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepiece_codec.digests(docs(odd_rows), path).collect()]
    assert sorted(got) == sorted(want)


def test_tokens_are_the_library(encoder):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(TEXTS, max_size=5))
    def check(texts):
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]

    check()


@given(st.lists(st.integers(0, 1 << 40), max_size=300).map(sorted))
def test_elias_fano(values):
    coded, _ = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert coded.values().tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_by_blocks(monkeypatch):
    values = np.cumsum(np.random.default_rng(3).integers(0, 5000, 3001))
    whole = EliasFano.encode(values).to_bytes()
    monkeypatch.setattr(token_output, "BLOCK", 64)
    assert EliasFano.encode(values).to_bytes() == whole and EliasFano.from_bytes(whole)[0].values().tolist() == values.tolist()


def test_shards_follow_bytes_and_split_an_id_of_many_rows(spark, docs, encoder, monkeypatch):
    rows = [(None if k % 3 else k, f"text {k} " + "word " * 50) for k in range(400)]
    monkeypatch.setattr(token_output, "SHARD_BYTES", 8_000)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        manifest = token_output.write_shards(docs(rows, 3), vocabulary("byte_bpe_50k.json"), 2, store.new_folder(spark, "tokens"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(manifest) > 12 and max(m["n_docs"] for m in manifest) < 80
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    got = sorted(token_output.read_shards(spark, manifest).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(i, len(encoder.library.encode(t, add_special_tokens=False).ids) + 1) for i, t in want]
    empty = docs(rows, 1).where("doc_id < -1")
    assert token_output.write_shards(empty, vocabulary("byte_bpe_50k.json"), 2, store.new_folder(spark, "tokens")) == []


def test_suffix_array_and_prefixes():
    r = random.Random(3)
    for _ in range(150):
        top = r.choice([2, 3, 5, 200])
        t = np.array([x for _ in range(r.randrange(1, 8)) for x in [*(r.randrange(1, top) for _ in range(r.randrange(0, 25))), 0]], np.int64)
        ends = np.cumsum(t == 0)
        want = sorted(range(len(t)), key=lambda i: [(0, int(ends[j])) if t[j] == 0 else (1, int(t[j])) for j in range(i, len(t))])
        order = suffix_array(t)
        assert order.tolist() == want
        data = np.concatenate([t.astype(np.uint8), np.zeros(28, np.uint8)])
        before, common = permuted_prefixes(data, order, 20)
        raw = data.tobytes()
        for j in range(len(t)):
            if before[j] >= 0:
                a, b = raw[j : j + 20], raw[before[j] : before[j] + 20]
                k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                assert common[j] == k


def brute_repeats(rows, length=50):
    out = []
    grams = [(i, {t[k : k + length] for k in range(len(t) - length + 1)}) for i, t in rows]
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if i is not None and any(j is not None and j < i and t[k : k + length] in g for j, g in grams):
                gone[k : k + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = len(re.findall("1+", "".join(map(str, gone.astype(int)))))
        out.append((i or 0, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(spark, docs):
    r = random.Random(11)
    shared = ["".join(r.choice("abc é\x00") for _ in range(n)) for n in (49, 50, 51, 90, 200)] + ["a" * 120, "ab" * 60]
    rows = [(None, shared[3])]
    for i in range(60):
        parts = [r.choice([*shared, "".join(r.choice("xyz ") for _ in range(r.randrange(60)))]) for _ in range(r.randrange(4))]
        rows.append((i // 2 if i % 10 == 0 else i, "".join(parts)))
    got = sorted((x["doc_id"] or 0, x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(docs(rows, 3)).collect())
    assert got == brute_repeats([(i, t.encode()) for i, t in rows])


def test_near_duplicates_against_brute_force(spark, docs):
    r = random.Random(5)
    vocabulary_ = [f"w{k}" for k in range(500)]
    rows, base = [], [[r.choice(vocabulary_) for _ in range(200)] for _ in range(6)]
    for i in range(90):
        words = list(base[i % 6])
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 12])):
            words[r.randrange(200)] = r.choice(vocabulary_)
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(r.choice(vocabulary_) for _ in range(120))) for i in range(30)]
    p = minhash_dedup.NearDupParams()
    frame = docs(rows)
    common = minhash_dedup.common_shingles(frame.select("text"), p)
    sets = {i: minhash_dedup.weighted(t, common, p) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and minhash_dedup.jaccard(sets[i], sets[j]) >= p.similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {x["doc_id"]: x["class_id"] for x in minhash_dedup.classes(frame, p).collect()}
    assert got == {i: find(i) for i in root}


def test_samples_agree_as_often_as_sets_are_alike():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 62, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[:220], r.integers(0, 1 << 62, 60).astype(np.uint64)]))
    wa, wb = np.ones(len(a), np.float32), np.ones(len(b), np.float32)
    wa[:50], wb[np.isin(b, a[:50])] = 3, 2
    drawn = minhash_dedup.samples(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a)]), 3000)[0]
    assert abs((drawn[0] == drawn[1]).mean() - minhash_dedup.jaccard((a, wa), (b, wb))) < 0.04


def test_pairs_alike_through_a_frequent_passage_share_a_bucket():
    r, p = np.random.default_rng(7), minhash_dedup.NearDupParams()
    sets = []
    for _ in range(200):
        keys = r.integers(0, 1 << 62, 1132).astype(np.uint64)
        frequent, ours = keys[:900], keys[900:]
        for rest in (ours[:20], ours):
            both = np.concatenate([frequent, rest])
            order = np.argsort(both)
            sets.append((both[order], np.ones(len(both), np.float32), np.isin(both, frequent)[order]))
    assert minhash_dedup.jaccard(sets[0], sets[1]) > p.similarity
    signed = minhash_dedup.signatures(sets, p)
    assert sum(not set(a) & set(b) for a, b in zip(signed[::2], signed[1::2], strict=True)) <= 1


def classes_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def families(seed, n, words=80):
    """Copies of two bases with up to seven other words each, and passages that unlike texts share."""
    r = random.Random(seed)
    vocabulary_ = [f"w{k}" for k in range(400)]
    base = [[r.choice(vocabulary_) for _ in range(words)] for _ in range(2)]
    passage = [r.choice(vocabulary_) for _ in range(30)]
    texts = []
    for i in range(n):
        made = list(base[i % 2]) if i % 5 else [r.choice(vocabulary_) for _ in range(r.randrange(4, 60))] + passage
        for _ in range(r.randrange(8) if i % 5 else 0):
            made[r.randrange(len(made))] = r.choice(vocabulary_)
        texts.append(" ".join(made * (2 if i % 7 == 0 else 1)))
    return texts


@pytest.mark.parametrize("seed", range(8))
def test_links_of_a_cell_join_what_all_pairs_join(seed):
    p = minhash_dedup.NearDupParams()
    keys = np.unique(np.concatenate([minhash_dedup.counted([t])[0] for t in families(seed, 4)]))[:150]
    common = (keys, np.full(len(keys), 0.9, np.float32))
    for n in (2, 3, 5, 60):
        sets = [s[:2] for s in minhash_dedup.multisets(families(seed, n), common, p)]
        for similarity in (0.5, 0.8):
            want = [(a, b) for b in range(n) for a in range(b) if minhash_dedup.jaccard(sets[a], sets[b]) >= similarity]
            got = minhash_dedup.cell_links(sets, similarity)
            assert classes_of(n, got) == classes_of(n, want)
            assert {(min(x), max(x)) for x in got} <= set(want)


def test_a_bucket_of_many_blocks_gives_the_same_classes(spark, docs):
    frame = docs(list(enumerate(families(3, 160))))
    whole = {r["doc_id"]: r["class_id"] for r in minhash_dedup.classes(frame).collect()}
    small = minhash_dedup.NearDupParams(cell_bytes=6000)
    assert {r["doc_id"]: r["class_id"] for r in minhash_dedup.classes(frame, small).collect()} == whole
    assert len(set(whole.values())) < 140


def test_shingles_do_not_depend_on_the_block():
    texts = ["", " ", "a b", "Ünï  cödé\u2003words\x1c here and there", "x" * 700_000 + " y z w v u", None, "one two three four five six one two three four five six"]
    whole = minhash_dedup.counted(texts)
    for i, t in enumerate(texts):
        keys, counts, _ = minhash_dedup.counted([t])
        assert keys.tolist() == whole[0][whole[2][i] : whole[2][i + 1]].tolist() and counts.tolist() == whole[1][whole[2][i] : whole[2][i + 1]].tolist()
        words = (t or "").lower().split()
        grams = [tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))]
        assert len(keys) == len(set(grams)) and counts.sum() == len(grams)


def test_frequent_shingles_are_counted_exactly(spark, docs):
    texts = families(9, 120)
    p = minhash_dedup.NearDupParams()
    sets = [set(minhash_dedup.counted([t])[0].tolist()) for t in texts]
    want = {k for k in set().union(*sets) if sum(k in s for s in sets) > p.common * len(sets)}
    for parts in (1, 7):
        assert set(minhash_dedup.common_shingles(docs(list(enumerate(texts)), parts).select("text"), p)[0].tolist()) == want


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "12", "255", "300", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (234) 555-6789", " ", "-", "+", "x@y.zz", "é", "1.2.3.4", "\n"]), max_size=25).map("".join))
def test_base_spans_are_the_patterns(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    want = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    want += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    want += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    want += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    assert pii.base_spans(text) == sorted(want)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    found = pii.find_spans("my bank account DE89 3704 0044 0532 0130 00, social security 123-45-6789, code 123-45-6780")
    assert [pii.KINDS[k] for _, k, _, _ in found] == ["iban", "ssn", "ssn"] or [pii.KINDS[k] for _, k, _, _ in found] == ["iban", "ssn"]
    assert pii.find_spans("DE89 3704 0044 0532 0130 01") == []
    assert pii.redact("a@b.cc x", pii.find_spans("a@b.cc x")) == "<EMAIL> x"


def test_account_numbers_end_where_their_country_says():
    german, british = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    for account in (german, german.replace(" ", ""), british):
        for after in ("", " BIC COBADEFF", " EUR 20", " 20", ", EUR", f" {british}", " SEPA DE00 1234 5678 9012 345"):
            text = f"IBAN {account}{after}"
            found = [(a, b) for a, k, b, _ in pii.find_spans(text) if pii.KINDS[k] == "iban"]
            assert found[0] == (5, 5 + len(account)) and len(found) == (2 if british in after else 1)
            assert account not in pii.redact(text, pii.find_spans(text))
    # An unknown country: the longest stretch up to the end of a word.
    unknown = next(f"ZZ{n:02} 1234 5678 9012 345" for n in range(2, 99) if pii.mod97(f"ZZ{n:02}123456789012345"))
    assert (0, len(unknown)) in [(a, b) for a, _, b, _ in pii.find_spans(f"{unknown} bank")]
    assert pii.find_spans("DE89 3704 0044 0532 0130 01 EUR 20") == []


def test_block_max_wand_is_exhaustive():
    r = random.Random(2)
    vocabulary_ = [f"w{k}" for k in range(60)]
    listed = [(i, " ".join(r.choice(vocabulary_) for _ in range(r.randrange(5, 70)))) for i in range(150)]
    index = decontaminate.Index(listed, decontaminate.DecontaminationParams(block=4))
    for _ in range(150):
        terms = sorted(r.sample(range(len(index.term)), r.randrange(1, 40)))
        scores = {}
        for t in terms:
            for s, x in index.lists[t]:
                scores[s] = scores.get(s, 0) + x
        want = sorted((s, round(x, 9)) for s, x in scores.items() if x >= 0.5 - 1e-9)
        assert sorted((s, round(x, 9)) for s, x in index.search(terms)) == want


def test_leaks_against_brute_force():
    r = random.Random(8)
    vocabulary_ = [f"w{k}" for k in range(300)]
    listed = [(i, " ".join(r.choice(vocabulary_) for _ in range(r.randrange(4, 130))) + ".") for i in range(40)]
    p = decontaminate.DecontaminationParams()
    index = decontaminate.Index(listed, p)
    texts = [None, ""]
    for k in range(60):
        words = [r.choice(vocabulary_) for _ in range(r.randrange(0, 200))]
        if k % 2:
            at = r.randrange(len(words) + 1)
            words[at:at] = [listed[r.randrange(40)][1]]
        texts.append(" ".join(words))
    got = decontaminate.matches(index, decontaminate._Terms(index), texts)
    for text, ms in zip(texts, got, strict=True):
        have = decontaminate.grams(decontaminate.words(text or ""), 5)
        full = {i for i in range(40) if index.questions[i] | index.answers[i] and len(next(iter(index.questions[i]))) == 5 and index.questions[i] | index.answers[i] <= have}
        assert full <= {m[0] for m in ms if decontaminate.verified(m, p)}


def test_found_passages_are_those_of_all_scores():
    """Every (document, item, score) of the search, and nothing else, against scoring every passage with every segment."""
    r = random.Random(12)
    vocabulary_ = [f"w{k}" for k in range(120)]
    p = decontaminate.DecontaminationParams(block=4)
    listed = [(i, " ".join(r.choice(vocabulary_) for _ in range(r.randrange(3, 110)))) for i in range(50)]
    index = decontaminate.Index(listed, p)
    texts = ["", None, "..."]
    for k in range(40):
        made = [r.choice(vocabulary_) for _ in range(r.randrange(200))]
        if k % 2:
            item = listed[r.randrange(50)][1].split()
            made[len(made) // 2 : len(made) // 2] = [w if r.random() < 0.8 else "zz" for w in item]
        texts.append(" ".join(made))
    got = decontaminate.matches(index, decontaminate._Terms(index), texts)
    impacts = [{} for _ in index.item_of]
    for word, t in index.term.items():
        for s, x in index.lists[t]:
            impacts[s][word] = x
    for text, found in zip(texts, got, strict=True):
        own = decontaminate.words(text or "")
        best = {}
        for k in range(0, len(own), p.segment):
            passage = set(own[k : k + 2 * p.segment])
            for s, words in enumerate(impacts):
                score = sum(x for w, x in words.items() if w in passage)
                if score >= p.threshold - 1e-9:
                    best[index.item_of[s]] = max(score, best.get(index.item_of[s], 0))
        assert [(m[0], m[1]) for m in found] == [(i, pytest.approx(x, abs=2e-6)) for i, x in sorted(best.items())]


def test_many_indexes_score_as_one(spark, docs):
    r = random.Random(6)
    vocabulary_ = [f"w{k}" for k in range(200)]
    listed = [(i, " ".join(r.choice(vocabulary_) for _ in range(r.randrange(5, 80)))) for i in range(60)]
    items = spark.createDataFrame(listed, "item_id long, text string")
    frame = docs([(i, " ".join(r.choice(vocabulary_) for _ in range(60)) + " " + listed[i % 60][1]) for i in range(80)])
    one, many = (sorted(map(tuple, decontaminate.find_leaks(frame, items, decontaminate.DecontaminationParams(index_chars=n)).collect())) for n in (10**6, 2000))
    assert one == many and len(one) >= 80


def test_normaliser_round_trip():
    made = [warc.record("response", k, f"http://x/{k}\n", (b"payload %d " % k) * 50, hashlib.sha256(b"").hexdigest()) for k in range(20)]
    whole = gzip.compress(b"".join(made))
    members = b"".join(gzip.compress(m) for m in made)
    for source in (whole, members):
        archive, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise(io.BytesIO(source), archive, index)[0] == 20
        lines = [x.split("\t") for x in index.getvalue().decode().splitlines()]
        for k, (offset, length, kind, name) in enumerate(lines):
            raw = archive.getvalue()[int(offset) : int(offset) + int(length)]
            assert zlib.decompress(raw, 31) == made[k]
            head, payload = warc.read_member(archive, int(offset), int(length))
            assert (kind, name, payload) == ("response", warc.urn(k), (b"payload %d " % k) * 50) and head["warc-target-uri"] == f"http://x/{k}%0A"
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(b"".join(made)[:-30])), io.BytesIO(), io.BytesIO())


def test_cut_archives_are_refused():
    made = [warc.record("response", k, "http://x/", bytes([k]) * 300, hashlib.sha256(b"").hexdigest()) for k in range(25)]
    whole = gzip.compress(b"".join(made))
    for end in (len(whole) - 1, len(whole) - 8, len(whole) - 9, len(whole) // 2, 5):
        with pytest.raises(ValueError):
            warc.normalise(io.BytesIO(whole[:end]), io.BytesIO(), io.BytesIO())
    # Cut at a border of records: all records are there, and the stream's end is not.
    stream = zlib.compressobj(wbits=31)
    cut = stream.compress(b"".join(made)) + stream.flush(zlib.Z_FULL_FLUSH)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(cut)))
    big = [warc.record("response", 1, "u", b"a" * 30_000_000, "")] * 2
    assert warc.normalise(io.BytesIO(gzip.compress(b"".join(big), 9)), io.BytesIO(), io.BytesIO())[0] == 2


@pytest.mark.parametrize("url", [" http://x/ ", "\t\n %20%0A\r", "", " ", "a%b", "é ☃"])
def test_urls_come_back(url):
    head = warc.header(warc.record("revisit", None, url, b"", "d", 3, refers_to_url=url).split(b"\r\n\r\n")[0])
    assert warc.original(head["warc-target-uri"]) == url == warc.original(head["warc-refers-to-target-uri"])
    assert warc.page_of(head["x-page"]) is None and warc.page_of(head["x-refers-to-page"]) == 3 and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["warc-date"])


def test_archives_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k if k % 11 else None, f" http://h{k % 5}/{k}", ("<p>page %d</p>" % (k % 3)) * (k % 4 * 5)) for k in range(200)] + [(3, "again", "<p>page 0</p>" * 15)]
    out = warc.archive_table(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1, r["url"]) for r in out.collect())
    db = duckdb.connect()
    db.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = db.sql("""
        WITH p AS (SELECT *, octet_length(encode(html)) AS n, sha256(html) AS d FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
        SELECT coalesce(page_id, -1), n, d, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END,
               coalesce(CASE WHEN n >= 100 AND page_id > first THEN first END, -1), url FROM f""").fetchall()
    assert got == sorted(want) and sum(r[3] == "revisit" for r in got) > 50


def test_context_decides_for_numbers_of_common_shapes():
    kinds = lambda t: [(pii.KINDS[k], score) for _, k, _, score in pii.find_spans(t)]
    for number, kind, word in (("123-45-6789", "ssn", "SSN"), ("021000021", "routing", "routing number"), ("(555) 123-4567", "phone_national", "Tel."), ("030 1234 5678", "phone_national", "call me at")):
        assert kinds(f"{number} is a number") == []
        assert kinds(f"{word} {number}") == kinds(f"{number} ({word})") == [(kind, 0.6)]
        assert kinds(f"{word}{' and so on' * 5} {number}") == []
    assert kinds("routing 021000022") == [] and kinds("tel 021000021x 12-34") == []
    # A base kind keeps its span whatever stands beside it; context only raises the score.
    assert kinds("10.20.30.40") == [("ip", 0.6)] and kinds("server 10.20.30.40") == [("ip", 0.9)]


def test_digests_of_personal_data(spark, docs, odd_rows):
    rows = [*odd_rows, (20, "Mail a.b@c.de, host 1.2.3.4, card 4111 1111 1111 1111, +1 (234) 555-6789, SSN 123-45-6789"), (21, "x" * 200_000 + " 1.2.3.4 and 1.2.3.400")]
    want = []
    for i, t, *_ in rows:
        base = pii.base_spans(t or "")
        listed = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        every = listed([(a, k, b) for a, k, b, _ in pii.find_spans(t or "")])
        want.append((i or 0, *[sum(k == r for _, k, _ in base) for r in range(4)], hashlib.sha256(listed(base).encode()).hexdigest(), every))
    got = [(r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in pii.pii_digest(docs(rows)).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("parts", [1, 5])
def test_token_table_against_the_library(spark, docs, odd_rows, encoder, parts, monkeypatch):
    monkeypatch.setattr(token_output, "DOCUMENTS", 3)
    rows = [*odd_rows, *((100 + k, "word " * k + "x" * (k * 40)) for k in range(9))]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for i, t, *_ in ordered:
        ids = [*encoder.library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder = store.new_folder(spark, "tokens")
    manifest = token_output.write_shards(docs(rows, parts), vocabulary("byte_bpe_50k.json"), 2, folder)
    got = token_output.read_shards(spark, manifest).collect()
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want
    place = 0
    for shard in manifest:
        for k in range(shard["n_docs"]):
            ids = token_output.read_document(shard["path"], k)
            assert zlib.crc32(ids.astype("<u4").tobytes()) == want[place][3]
            place += 1
    assert place == len(want)


def test_long_stretches_and_other_tokenizers(encoder):
    r = random.Random(2)
    texts = ["".join(r.choice("abcdef") for _ in range(50_000)) + " tail", "的一是" * 3000 + " 不了", "a " + "x" * 65]
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, encoder.known)) <= encoder.LONGEST
    other = CachedEncoder(vocabulary("word_bpe_49k.json"))
    assert not other.parts or encoder.parts
    texts = ["Hello there, world.  Twice", " x\ny", "12345 67"]
    assert [np.frombuffer(b, other.dtype).tolist() for b in other.encode(texts)] == [other.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_license_wording():
    scanner = license_scan.scanner(license_scan.LicenseParams())
    found = lambda t: [f[2] for f in scanner.scan(t)]
    assert found("Words. Licensed under the Apache License, Version 2.0. More words.") == ["Apache-2.0"]
    assert found("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert found("Licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert found("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert found("He had a license to drive.") == []
    for name, text in license_scan.TEMPLATES:
        assert found(f"Intro line\n{text}\nlast line")[0] == name


def test_license_notices_without_their_first_words():
    scanner = license_scan.scanner(license_scan.LicenseParams())
    found = lambda t: [f[2] for f in scanner.scan(t)]
    for name, text in license_scan.TEMPLATES:
        words = license_scan.wording(text)
        for lost in range(1, int(scanner.p.max_missing * len(words)) + 1):
            if not license_scan.telling(words) & set(words[:lost]):
                assert scanner.compare(["x", "foobar", *words[lost:], "y"], words) == [(2, len(words) - lost + 2, lost, 0)], (name, lost)
    gpl = dict(license_scan.TEMPLATES)["GPL-3.0-or-later"]
    assert found(gpl.replace("This program", "Foobar")) == ["GPL-3.0-or-later"]
    # Neither prose around a notice nor other notices beside it hide it.
    prose = "the river was wide and nobody knew how deep it might be at the other side of town " * 9
    assert found(f"All rights reserved. {prose[:700]}") == ["Proprietary"]
    assert found(f"{prose[:690]} all rights reserved {prose[:690]}") == ["Proprietary"]
    short = [(n, t) for n, t in license_scan.TEMPLATES if len(t) < 100]
    assert sorted(found(" ".join(t for _, t in short))) == sorted(n for n, _ in short)


def test_license_notices_across_lines():
    scanner = license_scan.scanner(license_scan.LicenseParams())
    found = lambda t: [f[2] for f in scanner.scan(t)]
    for name, text in license_scan.TEMPLATES:
        for width in (24, 40, 72):
            for mark in ("", " * ", "# ", "// ", "        "):
                wrapped = "\n".join(mark + line for line in textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False))
                (got,) = scanner.scan(f"int x;\n{wrapped}\n\nint y;\n")
                assert (got[2], got[4], got[5]) == (name, 0, 0), (name, width, mark)
        paragraphs = text.replace(": ", ":\n\n").replace(". ", ".\n\n") if len(text) > 300 else text
        assert found(f"Intro line\n\n{paragraphs}\n\nlast line") == [name]
    assert found("This is free and unencumbered software released into\nthe public domain.") == ["Unlicense"]
    assert found("This is free and unencumbered software released into the public\ndomain.") == ["Unlicense"]
    mit = license_scan.TEMPLATES[2][1]
    assert found("a word\n" * 400 + mit + "\nmore words" * 400 + "\n" + mit) == ["MIT", "MIT"]


def test_licenses_against_every_template_at_every_place():
    """Found notices against a plain search: the longest common subsequence of each template with the words from each place on."""
    scanner = license_scan.scanner(license_scan.LicenseParams())
    r = random.Random(1)
    prose = "the river was wide and nobody knew how deep it might be at the other side of town".split()

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    for name, text, wanted in scanner.templates:
        room, must = int(scanner.p.max_missing * len(wanted)), license_scan.telling(wanted)
        for turn in range(6):
            words = text.split()
            free = [i for i, w in enumerate(words) if len(license_scan.wording(w)) == 1 and license_scan.wording(w)[0] not in must]
            # Two more than may be lost: nothing may be found then, unless another template fits.
            lost = min(len(free), r.randrange(room + 1) if turn < 4 else room + 2)
            for i in sorted(r.sample(free, lost), reverse=True):
                words[i : i + 1] = [] if r.random() < 0.5 else [r.choice(prose)]
            before, after = ([r.choice(prose) for _ in range(r.randrange(40))] for _ in range(2))
            made = " ".join(before + words + after)
            found = {f[2] for f in scanner.scan(made)}
            # Without any of the trigger words a notice isn't looked for.
            assert turn >= 4 or name in found or not license_scan.TRIGGER.search(" ".join(words)), (name, turn)
            whole = license_scan.wording(made)
            may = set()
            for other, _, theirs in scanner.templates:
                width = len(theirs) + max(2, len(theirs) // 10)
                needed = len(theirs) - int(scanner.p.max_missing * len(theirs))
                if len(theirs) >= 60 or any(common(theirs, whole[k : k + width]) >= needed for k in range(len(whole)) if whole[k] in theirs):
                    may.add(other)
            assert found <= may, (name, found - may)


def test_compression_decides_which_license_stays():
    """Two notices share a word: the first has nine words, the second five that its template saves more bytes of."""
    long = "the intergovernmental standardisation consortium documentation"
    many = "permission to do so as it is of the"
    scanner = license_scan.Scanner(license_scan.LicenseParams(templates=(("many", many), ("long", long))))
    assert [f[2] for f in scanner.scan(many)] == ["many"]
    (got,) = scanner.scan(f"{many} {long[4:]}")
    assert got[2] == "long" and 0 < got[3] < 1


def test_compression_proposes_license_notices(monkeypatch):
    """Wording confirms what saves bytes; what saves too few isn't compared."""
    scanner = license_scan.Scanner(license_scan.LicenseParams())
    words = license_scan.wording(license_scan.TEMPLATES[2][1])
    assert scanner.compare(words, words) == [(0, len(words), 0, 0)]
    monkeypatch.setattr(scanner, "saved", lambda *a: (0, 1))
    assert scanner.compare(words, words) == []


def test_compression_loses_no_license_notice():
    """Notices with words lost, replaced and added, between prose and parts of other notices: as if wording were compared at every place."""
    scanner = license_scan.Scanner(license_scan.LicenseParams())
    every = license_scan.Scanner(license_scan.LicenseParams(least_saved=-100.0))
    r = random.Random(3)
    prose = "the river was wide and nobody knew how deep it might be at the other side of town".split()
    pool = [w for _, text in license_scan.TEMPLATES for w in text.split()]
    for name, text in license_scan.TEMPLATES * 8:
        words = text.split()
        for _ in range(r.choice([0, 1, 2, len(words) // 10])):
            i = r.randrange(len(words))
            words[i : i + 1] = r.choice([[], [r.choice(pool)], [r.choice(prose), words[i]], [r.choice(pool), words[i]]])
        k = r.randrange(len(pool) - 30)
        made = " ".join(pool[k : k + r.randrange(30)] + words + r.choices(prose, k=r.randrange(20)) + words)
        assert scanner.scan(made) == every.scan(made), (name, made)


TABLES = {
    "quality": lambda d, items: quality_rules.keep_good(d),
    "near_duplicates": lambda d, items: minhash_dedup.keep_one(d),
    "decontamination": lambda d, items: decontaminate.remove_leaks(d, items),
    "personal_data": lambda d, items: pii.redacted(d),
}
LONG_ODD = ("nobody had come here for a long time and wrote to a.b@c.de or +1 (234) 555-6789 " * 3000) + " license warranty 4111 1111 1111 1111"


@pytest.mark.parametrize("name", TABLES)
def test_table_forms_on_odd_rows(spark, docs, odd_rows, name):
    items = spark.createDataFrame([(1, "nobody had come to the house for a long time"), (2, None)], "item_id long, text string")
    rows = [*odd_rows, (20, LONG_ODD), (20, LONG_ODD)]
    LONG, PROSE = odd_rows[3][1], odd_rows[4][1]
    frame = docs(rows)
    out = TABLES[name](frame, items)
    assert out.columns == frame.columns
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect()), key=repr)
    want = {
        # Too few words or too many repeated ones go.
        "quality": [(0, PROSE), (5, PROSE), (5, PROSE), (6, PROSE)],
        # Both rows of the least id of a class stay; null ids are classes of their own.
        "near_duplicates": [(0, PROSE), (0, None), (1, None), (4, LONG), (5, PROSE), (5, PROSE), (8, "a\n\n  b   c \n d"), (9, "short"), (20, LONG_ODD), (20, LONG_ODD)],
        "decontamination": [(i or 0, t) for i, t, *_ in rows if t != PROSE and t != LONG_ODD],
        "personal_data": [(i or 0, None if t is None else pii.redact(t, pii.find_spans(t))) for i, t, *_ in rows],
    }[name]
    if name == "decontamination":
        want += [(i or 0, t) for i, t, *_ in rows if t == LONG_ODD]
    if name == "near_duplicates":
        # The two texts of id 7 are judged by one of them.
        got = [x for x in got if x[0] != 7 and x[0] not in (2, 3)]
    assert got == sorted(want, key=repr)
    assert TABLES[name](docs([]), items).collect() == []
    assert TABLES[name](docs([]), items.limit(0)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows_and_none(spark, docs, odd_rows, stage, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "nobody had come to the house for a long time"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, step = corpus_pipeline.STAGES[stage]
    frame = docs([*odd_rows, (20, LONG_ODD)])
    out = step(spark, frame, str(tmp_path))
    ids = {r["doc_id"] for r in out.collect()}
    assert ids <= {r[0] for r in odd_rows} | {20} and (out.columns == frame.columns) == (stage < 4)
    if name in ("personal_data", "encoding"):
        assert out.count() == len(odd_rows) + 1
    assert step(spark, docs([]), str(tmp_path)).collect() == []


@pytest.mark.parametrize("copies", [10**7, 600, 1])
def test_urls_against_every_rule(spark, copies, monkeypatch):
    """However few copies of rules may be sent, each host gets the rules that a plain search finds."""
    monkeypatch.setattr(url_filter, "COPIES", copies)
    r = random.Random(9)
    labels = ["a", "b", "co", "uk", "net", "x1"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randrange(1, 5)))
    rules = [(r.choice(["allow", "block"]), f"{host()}{r.choice(['/', '/p', '/p/q', ''])}") for _ in range(60)]
    urls = [f"http://{host()}{r.choice(['/', '/p/q/r', '', '/x'])}" for _ in range(300)]
    best = []
    for k, url in enumerate(urls):
        h, slash, rest = url[7:].partition("/")
        path = slash + rest
        fits = [(len(x), len(x.partition("/")[0]), x, v) for v, x in set(rules) if (h == (n := x.partition("/")[0]) or h.endswith("." + n)) and path.startswith(x[len(n) :])]
        top = max(fits, default=(0, 0, None, "allow"), key=lambda f: f[:3])
        best.append((k, h, path, top[2]))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules), buckets=16)
    assert sorted((x["page_id"], x["host"], x["path"], x["rule"]) for x in out.collect()) == best
