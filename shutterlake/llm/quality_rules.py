"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's character-class histogram and its histogram of common words are
compared with references of its language by the Jensen-Shannon distance (base
2, 0 to 1).  A test is made only from a least length on, as short texts give
noisy histograms, and only where there is a reference for the language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Up to so many repeated hashes, windows are looked up in the list of them.
FEW = 40

#: Counted by pattern; white space and all else follow as two more classes.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{N}")

#: Shares in running prose: lower-case letters, upper-case letters, digits, white space, all else.
CLASS_SHARES = {
    "en": (0.780, 0.028, 0.006, 0.165, 0.021),
    "de": (0.785, 0.045, 0.006, 0.142, 0.022),
    "fr": (0.775, 0.026, 0.006, 0.170, 0.023),
    "es": (0.780, 0.026, 0.006, 0.168, 0.020),
}

#: Shares of the most frequent words in running prose, as they stand between white space; the rest is one more bin.
WORD_SHARES = {
    "en": {"the": 0.060, "of": 0.034, "and": 0.026, "to": 0.023, "a": 0.019, "in": 0.017, "is": 0.011, "that": 0.010, "it": 0.009, "for": 0.008, "was": 0.008, "on": 0.006, "with": 0.006, "as": 0.006, "be": 0.005, "by": 0.005},
    "de": {"der": 0.052, "die": 0.038, "und": 0.028, "in": 0.020, "den": 0.015, "von": 0.012, "zu": 0.011, "das": 0.011, "mit": 0.009, "sich": 0.008, "des": 0.007, "auf": 0.007, "für": 0.007, "ist": 0.007, "im": 0.006, "nicht": 0.006},
    "fr": {"de": 0.060, "la": 0.035, "le": 0.026, "et": 0.022, "les": 0.019, "des": 0.014, "en": 0.013, "un": 0.011, "du": 0.010, "une": 0.009, "que": 0.008, "pour": 0.007, "est": 0.007, "par": 0.006, "qui": 0.006, "dans": 0.006},
    "es": {"de": 0.062, "la": 0.037, "que": 0.028, "el": 0.024, "en": 0.022, "y": 0.020, "los": 0.014, "se": 0.010, "del": 0.010, "las": 0.009, "un": 0.008, "por": 0.008, "con": 0.007, "no": 0.007, "su": 0.006, "una": 0.006},
}


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Least characters for the class test, least words for the word test.
    guard_chars: int = 200
    guard_words: int = 60
    max_class_distance: float = 0.30
    max_word_distance: float = 0.32
    class_shares: dict = field(default_factory=lambda: CLASS_SHARES)
    word_shares: dict = field(default_factory=lambda: WORD_SHARES)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, also where a filter is pushed down."""
    return F.transform(F.array(value), body).getItem(0)


def _sum(values: Column, zero) -> Column:
    return F.aggregate(values, F.lit(zero), lambda a, v: a + v)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of equal length."""

    def half(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(F.lit(0.0), _sum(F.zip_with(p, q, lambda x, y: (half(x, y) + half(y, x)) / 2), 0.0)))


def _covered(words: Column) -> Column:
    """Words covered by windows that occur twice or more.

    Windows whose hashes all differ all differ.  Else the windows themselves are
    sorted, which puts equal ones side by side; where few hashes repeat, only
    the windows that have these.
    """
    n = F.size(words)

    def of_sorted(s):
        def same(x, k):
            return F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))

        marked = F.filter(F.transform(s, lambda x, k: F.when(same(x, k), x["i"]).otherwise(F.lit(-1))), lambda i: i >= 0)
        return let(F.sort_array(marked), lambda p: _sum(F.transform(p, lambda v, k: F.coalesce(F.least(F.lit(WINDOW), v - F.get(p, k - 1)), F.lit(WINDOW))), 0))

    at = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def exact(starts):
        windows = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("g"), i.alias("i")))
        return let(F.sort_array(windows), of_sorted)

    def of_hashes(h):
        def of_repeated(twice):
            return F.when(F.size(twice) == 0, F.lit(0)).when(F.size(twice) <= FEW, exact(F.filter(at, lambda i: F.array_contains(twice, F.get(h, i))))).otherwise(exact(at))

        repeated = let(F.sort_array(h), lambda s: F.filter(s, lambda x, k: x == F.get(s, k - 1)))
        return let(repeated, of_repeated)

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashes, of_hashes))


def quality_report(text: Column, lang: Column, params: QualityParams = QualityParams()) -> Column:
    """A struct of all figures and verdicts of one text."""
    languages = sorted(set(params.class_shares) & set(params.word_shares))

    def by_language(make):
        out = F.lit(None).cast("double")
        for n in languages:
            out = F.when(lang == n, make(n)).otherwise(out)
        return out

    def literal(values):
        return F.array(*[F.lit(float(v)) for v in values])

    def report(t):
        chars = F.length(t)

        def without(chars_of):
            return chars - F.length(F.regexp_replace(t, f"[{chars_of}]+", ""))

        def of_words(w):
            n = F.size(w)
            lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

            def class_gap(word_chars):
                sizes = [without(c) for c in CLASSES]
                counts = F.array(*sizes, chars - word_chars)
                return let(counts, lambda c: by_language(lambda k: js_distance(F.transform(F.concat(c, F.array(chars - _sum(c, 0))), lambda x: x / chars), literal(params.class_shares[k]))))

            def word_gap(k):
                ref = params.word_shares[k]
                longest = max(map(len, ref))
                hits = F.filter(w, lambda x: (F.octet_length(x) <= 2 * longest) & (F.length(x) <= longest) & x.isin(list(ref)))
                rest = 1.0 - sum(ref.values())
                return let(hits, lambda h: js_distance(
                    F.concat(F.transform(F.array(*[F.lit(x) for x in ref]), lambda r: F.size(F.filter(h, lambda x: x == r)) / n), F.array((n - F.size(h)) / n)),
                    literal([*ref.values(), rest]),
                ))

            def figures(word_chars):
                return F.struct(
                    n.cast("long").alias("n_words"),
                    word_chars.cast("long").alias("word_chars"),
                    without(r"#*$%&|<>").cast("long").alias("n_symbols"),
                    let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                    _covered(w).cast("long").alias("n_repeat_words"),
                    F.when(chars >= params.guard_chars, class_gap(word_chars)).alias("class_distance"),
                    F.when(n >= params.guard_words, by_language(word_gap)).alias("word_distance"),
                )

            return let(F.length(F.array_join(w, "")), figures)

        return let(F.array_remove(F.split(t, SPACE), ""), of_words)

    def judged(r):
        failed = (r["n_words"] < params.min_words) | (100 * r["n_repeat_words"] > params.max_repeat_percent * r["n_words"])
        odd = F.coalesce(r["class_distance"] > params.max_class_distance, F.lit(False)) | F.coalesce(r["word_distance"] > params.max_word_distance, F.lit(False))
        fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance")
        return F.struct(*[r[f].alias(f) for f in fields], failed.alias("base_failed"), (~failed & ~odd).alias("kept"))

    return let(let(F.coalesce(text.cast("string"), F.lit("")), report), judged)


def judge_quality(
    docs: DataFrame, params: QualityParams = QualityParams(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Figures and verdicts for every row: ``id_col``, counts, ``class_distance``, ``word_distance``, ``base_failed``, ``kept``.

    Null texts count as empty: no words, base_failed.  A distance is null below
    its length guard, or where the language is null or has no reference; such a
    test rejects nothing.  Repeated rows and null ids stay as they are; further
    columns are not looked at.  One narrow stage: no shuffle at any size.
    """
    rows = store.spread(docs.select(F.col(id_col), F.col(text_col), F.col(lang_col)))
    q = rows.select(F.col(id_col), quality_report(F.col(text_col), F.col(lang_col), params).alias("_q"))
    return q.select(F.col(id_col), *[F.col(f"_q.{f}").alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")])


def keep_good(docs: DataFrame, params: QualityParams = QualityParams(), *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the rules keep, with all their columns, whatever their names.

    Null and empty texts fail the base rules and go; very long ones are judged
    whole; repeated rows and null ids are judged each by itself.  No rows: no rows.
    """
    return store.spread(docs).where(quality_report(F.col(text_col), F.col(lang_col), params)["kept"])
