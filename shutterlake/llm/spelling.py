"""Spelling variants: words one edit apart, joined by an even partition into two segments.

A word is cut into two segments whose places follow from its length.  An edit
falls into one of them, so a word of equal length, or one longer, holds the other
segment unchanged: at its own place if it is the first, shifted by the difference
of lengths if it is the second.  Segments are indexed under (length, place, text)
and probed with the substrings at these places; candidates of one segment are
verified.  A segment that more than ``most`` words share is hot: its words' other
segment is cut in two in the same way, as long as the part left open has more than
one character, so that no task meets all pairs of a frequent segment.

The part left open is the window ``[a, l - b)`` of a word of length l: what is
shared are its first a and its last b characters.  Windows of a word never
overlap, and a pair counts only in the window that holds the first difference, so
each pair comes once and needs no ``distinct``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store

LETTERS = r"A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["l", "a", "b", "shared"]


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(word.rlike(r"[À-Þ]"), F.translate(word, UPPER, UPPER.lower())).otherwise(F.lower(word))


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """``word, n``: runs of letters of all texts in lower case and how often they occur.

    One run in ``every`` loses a character: where the crc32 of ``<id>:<run>`` is
    divisible by it, the character at crc32 modulo length.  Null texts have no words,
    a null id counts as an empty one.  Words of fewer characters or occurrences are left out.
    """
    texts = store.spread(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).cast("string").alias("_text")))
    # A run can only grow shorter, so shorter ones are not even taken out of the text.
    runs = texts.select("_id", F.explode(F.regexp_extract_all("_text", F.lit(f"[{LETTERS}]{{{least_chars},}}+"), F.lit(0))).alias("_run"))
    named = runs.select("_id", lower_ascii(F.col("_run")).alias("_run"))
    hashed = named.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run")).alias("_h"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    cut = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    words = hashed.select(F.when(F.col("_h") % every == 0, cut).otherwise(F.col("_run")).alias("word")).where(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _windows(words: DataFrame, length: Column) -> DataFrame:
    """Two rows a word: the edit lies behind the first segment of a word of this length, or before the second."""
    half = F.floor(length / 2).cast("int")
    places = F.array(F.struct(half.alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), (length - half).alias("b")))
    return _keyed(words.select("word", "n", length.alias("l"), F.explode(places).alias("_p")).select("word", "n", "l", "_p.a", "_p.b"))


def _keyed(rows: DataFrame) -> DataFrame:
    shared = F.concat(F.substr("word", F.lit(1), F.col("a")), F.substr("word", F.char_length("word") - F.col("b") + 1, F.col("b")))
    return rows.withColumn("shared", shared)


def _halved(rows: DataFrame) -> DataFrame:
    """The window of each row cut in two."""
    half = F.floor((F.col("l") - F.col("a") - F.col("b")) / 2).cast("int")
    rest = F.col("l") - F.col("a") - F.col("b") - half
    places = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + rest).alias("b")))
    return _keyed(rows.select("word", "n", "l", F.explode(places).alias("_p")).select("word", "n", "l", "_p.a", "_p.b"))


def _verified(index: DataFrame, probes: DataFrame) -> DataFrame:
    """``word, n, other, other_n`` of each pair one edit apart whose first difference lies in the window of a shared segment."""
    left = index.select(*KEY, "word", "n")
    right = probes.select(*KEY, F.col("word").alias("other"), F.col("n").alias("other_n"))
    same = F.char_length("other") == F.col("l")
    size = F.col("l") - F.col("a") - F.col("b")
    middle, longer = F.substr("word", F.col("a") + 1, size), F.substr("other", F.col("a") + 1, F.char_length("other") - F.col("a") - F.col("b"))
    first_here = (F.col("b") == 0) | (middle != F.substr("other", F.col("a") + 1, size))
    return left.join(right, KEY).where((~same | (F.col("word") < F.col("other"))) & first_here & (F.levenshtein(middle, longer, 1) == 1)).select("word", "n", "other", "other_n")


def near_pairs(words: DataFrame, *, most: int = 128) -> DataFrame:
    """``word, n, other, other_n``: each pair of words that one inserted, deleted or replaced character separates, once.

    ``words`` has distinct ``word`` and ``n``; empty words have no near ones here.
    ``most``: words of one segment that a probe is compared with; a segment of more
    is cut further, so that nothing is lost.
    """
    length = F.char_length("word")
    words = words.where(length > 0)
    index = _windows(words, length)
    probes = index.unionByName(_windows(words.where(length > 1), length - 1))
    found = []
    while True:
        open_ = F.col("l") - F.col("a") - F.col("b") > 1
        hot = store.materialize(index.where(open_).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > most).drop("_k"), "hot-segments")
        if hot.isEmpty():
            found.append(_verified(index, probes))
            break
        found.append(_verified(index.join(hot, KEY, "left_anti"), probes))
        index = store.materialize(_halved(index.join(hot, KEY, "left_semi")), "segments")
        probes = store.materialize(_halved(probes.join(hot, KEY, "left_semi")), "segments")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root``: where following ``word -> form`` ends, for chains of at most ``steps`` forms. Each round doubles the reach."""
    found = store.materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        on = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        found = store.materialize(found.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return found


def variants(words: DataFrame, *, factor: int = 5, most: int = 128) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``words`` (distinct ``word``, ``n``).

    ``form`` is the near word of largest n (ties: the smallest in code-point order)
    if that n is at least ``factor`` times the word's; ``root`` follows forms to the
    last and is the word itself without one.  ``factor`` must be above 1, so that n
    grows along a chain.  No words give no rows; other columns are not looked at.
    """
    if factor <= 1:
        raise ValueError("a form must be more frequent than its variant")
    words = store.materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words, most=most)
    links = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("_minus"), F.col("other").alias("form"))).alias("_best"))
    near = near.select("word", "n_near", F.col("_best.form").alias("_form"), (-F.col("_best._minus")).alias("_form_n"))
    good = F.col("_form_n") >= factor * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("_form")).alias("form"), F.when(good, F.col("_form_n")).alias("form_n")
    )
    rows = store.materialize(rows, "forms")
    largest = rows.agg(F.max("n")).first()[0] or 1
    ends = roots(rows.where(F.col("form").isNotNull()), int(math.log(largest, factor)) + 1)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_count: int = 5, every: int = 199, factor: int = 5) -> DataFrame:
    """``variants`` of the words of whole texts (``word_counts``)."""
    return variants(word_counts(docs, id_col=id_col, text_col=text_col, least_chars=least_chars, least_count=least_count, every=every), factor=factor)
