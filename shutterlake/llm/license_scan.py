"""License scans by conditional compression.

The words of a block that may hold a license notice are compressed alone and with the
wording of each template as a raw zstandard dictionary.  Stretches of a template's
length from which it saves enough bytes are candidates.  The exact differences in
wording confirm them: a template is found where all its words stand in order but for a
small share, and its numbers and names of variants never differ.  Of notices that
overlap, the one from which its template saves the most bytes stays.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store
from shutterlake.llm.license_texts import TEMPLATES

#: Several words of a trigger may stand on two lines, with a comment mark between.
TRIGGER = re.compile(r"licen[sc]e|copyright|permission|redistribut|warrant|public[\W_]+domain|all[\W_]+rights[\W_]+reserved|creative[\W_]+commons|free[\W_]+software|\bCC0\b|\bCC[\W_]+BY\b", re.I)
MARKS = re.compile(r"[\s*#/;%!|<>-]*")
WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+")


@dataclass(frozen=True)
class LicenseParams:
    templates: tuple = TEMPLATES
    #: Characters around a trigger; blocks that touch are one.
    reach: int = 700
    max_missing: float = 0.1
    level: int = 9
    #: Least bytes that a template saves from a candidate, as a share of those it saves from its own wording.
    least_saved: float = 0.2


def wording(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def telling(words: list[str]) -> set[str]:
    """Words that no difference in wording excuses: versions, and short upper-case marks of variants."""
    return {w for w in words if w[0].isdigit() or w in ("nc", "nd", "sa", "mit", "apache", "lesser", "affero", "noncommercial", "sharealike", "mozilla")}


#: Words of a notice are few bytes: frames without what they would only repeat.
FRAME = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
#: No match begins at a dictionary's first byte or in its last eight.
PAD = b"\n" * 8


def said_as(words: list[str]) -> bytes:
    """Words as they are compressed, each after a space: without case, lines, marks of comments and punctuation."""
    return "".join([" " + w for w in words]).encode()


class Notice:
    """A template as it is looked for: its wording, that wording as a dictionary, and what a place must keep of it."""

    def __init__(self, name: str, wanted: list[str], p: LicenseParams):
        import zstandard as zstd

        own = said_as(wanted)
        self.name, self.wanted, self.must, self.need = name, wanted, telling(wanted), Counter(wanted)
        self.room = int(p.max_missing * len(wanted))
        #: A notice begins with one of the first words, as many as may be missing and one more.
        self.heads = set(wanted[: self.room + 1])
        self.width = len(wanted) + max(2, len(wanted) // 10)
        said = zstd.ZstdCompressionDict(PAD + own + PAD, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        self.given = zstd.ZstdCompressor(level=p.level, dict_data=said, **FRAME)
        self.least = p.least_saved * (len(zstd.ZstdCompressor(level=p.level, **FRAME).compress(own)) - len(self.given.compress(own)))


def apart(ranked: list, ends) -> list:
    """Those that overlap none before them in the ranking; ``ends`` gives where one begins and stops."""
    out, taken = [], []
    for one in ranked:
        a, b = ends(one)
        at = bisect.bisect(taken, (a, b))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b))
            out.append(one)
    return out


class Scanner:
    #: Words of a window from which on longer stretches are compressed first.
    LONG = 32

    def __init__(self, p: LicenseParams):
        import zstandard as zstd

        self.p = p
        self.plain = zstd.ZstdCompressor(level=p.level, **FRAME)
        self.templates = [(name, text, wording(text)) for name, text in p.templates]
        self.notices = [Notice(name, wanted, p) for name, _, wanted in self.templates]

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Stretches within reach of triggers, of whole words and across lines; those that touch are one, also over white space and comment marks."""
        out: list[list[int]] = []
        for m in TRIGGER.finditer(text):
            low, stop = max(0, m.start() - self.p.reach), min(len(text), m.end() + self.p.reach)
            while 0 < low < m.start() and not text[low - 1].isspace():
                low += 1
            while m.end() < stop < len(text) and not text[stop].isspace():
                stop -= 1
            if out and (low <= out[-1][1] or MARKS.fullmatch(text, out[-1][1], low)):
                out[-1][1] = max(out[-1][1], stop)
            else:
                out.append([low, stop])
        return [(a, b) for a, b in out]

    def scan(self, text: str) -> list[tuple[int, int, str, float, int, int]]:
        """(start, end, license, reduction, words missing, words more in between) of each notice."""
        found = []
        for start, end in self.blocks(text):
            spots = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text[start:end])]
            for a, b, missing, more, name, reduction in self.ranked([w for _, _, w in spots], self.notices):
                found.append((start + spots[a][0], start + spots[b - 1][1], name, round(reduction, 6), missing, more))
        return sorted(found)

    def saved(self, words: list[str], low: int, stop: int, notice: Notice, alone: dict) -> tuple[int, int]:
        """Bytes that the template saves from these words, and their bytes without it; ``alone`` keeps the latter for other templates."""
        data = said_as(words[low:stop])
        size = alone.get((low, stop)) or alone.setdefault((low, stop), len(self.plain.compress(data)))
        return size - len(notice.given.compress(data)), size

    def windows(self, words: list[str], notice: Notice, alone: dict) -> list[tuple[int, int]]:
        """Stretches of the template's width, from one of its first words on, from which it saves enough bytes.

        A long template has many first words, so stretches of twice its width are compressed before:
        each window lies in one, and where the template saves too little from that, it says nothing
        of its windows.  Short ones save too little from longer stretches to tell.
        """
        out = []
        least, end = notice.least, len(words)
        step = notice.width if notice.width >= self.LONG else max(1, end)
        for low in range(0, end, step):
            if step == notice.width and self.saved(words, low, min(low + 2 * step, end), notice, alone)[0] < least:
                continue
            for head in range(low, min(low + step, end)):
                stop = min(head + notice.width, end)
                if words[head] in notice.heads and self.saved(words, head, stop, notice, alone)[0] >= least:
                    out.append((head, stop))
        return out

    def confirmed(self, words: list[str], head: int, stop: int, notice: Notice) -> tuple[int, int, int, int] | None:
        """(missing, more, first word, last word + 1) of the template's wording in a window, if it stands there."""
        span, wanted = words[head:stop], notice.wanted
        if not notice.must <= set(span) or (Counter(span) & notice.need).total() < len(wanted) - notice.room:
            return None
        same = [m for m in difflib.SequenceMatcher(None, wanted, span, autojunk=False).get_matching_blocks() if m.size]
        hit = sum(m.size for m in same)
        kept = {wanted[m.a + k] for m in same for k in range(m.size)}
        if not hit or len(wanted) - hit > notice.room or not notice.must <= kept:
            return None
        low, high = same[0].b, same[-1].b + same[-1].size
        return (len(wanted) - hit, high - low - hit, head + low, head + high) if telling(span[low:high]) <= notice.must else None

    def places(self, words: list[str], notice: Notice, alone: dict) -> list[tuple[int, int, int, int]]:
        """(missing, more, first word, last word + 1) of the template's places among its windows.

        Of those that overlap, the one with the least missing words stays, then with the least more, then the first.
        """
        found = {p for w in self.windows(words, notice, alone) if (p := self.confirmed(words, *w, notice))}
        return apart(sorted(found), lambda p: p[2:])

    def ranked(self, words: list[str], notices: list[Notice]) -> list[tuple[int, int, int, int, str, float]]:
        """(first word, last word + 1, missing, more, license, reduction) of the notices.

        Of those that overlap, the one from which its template saves the most bytes stays, then
        the one with the least missing words, then the least more, then the lesser name.
        """
        alone: dict = {}
        every = []
        for notice in notices:
            for missing, more, a, b in self.places(words, notice, alone):
                gain, size = self.saved(words, a, b, notice, alone)
                every.append((-gain, missing, more, notice.name, a, b, gain / size))
        return sorted((a, b, missing, more, name, reduction) for _, missing, more, name, a, b, reduction in apart(sorted(every), lambda p: p[4:6]))

    def compare(self, words: list[str], wanted: list[str]) -> list[tuple[int, int, int, int]]:
        """(first word, last word + 1, missing, more) of every place where one wording stands."""
        notice = next((n for n in self.notices if n.wanted == wanted), None) or Notice("", wanted, self.p)
        return [place[:4] for place in self.ranked(words, [notice])]


_scanners: dict = {}


def scanner(p: LicenseParams) -> Scanner:
    if p not in _scanners:
        _scanners[p] = Scanner(p)
    return _scanners[p]


def scan_licenses(docs: DataFrame, params: LicenseParams = LicenseParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each notice: ``id_col, start, end, license, reduction, n_missing, n_more``; offsets in code points.

    Null and empty texts hold none; very long ones are scanned whole.  Of notices
    that overlap, the one from which its template saves the most bytes stays, then the
    one with fewer missing words, then with fewer more, then the lesser name.  The
    reduction is the share of the notice's compressed bytes that are saved.  A notice that has lost all trigger words
    (license, copyright, permission and the like) isn't looked for.  Rows that repeat an id each give their
    rows; no rows give none; other columns are not looked at.  No shuffle.
    """
    kind = docs.select(id_col).dtypes[0][1]
    schema = f"{id_col} {kind}, start int, end int, license string, reduction double, n_missing int, n_more int"

    def scan(batches):
        one = scanner(params)
        for batch in batches:
            rows = [(k, *r) for k, t in enumerate(batch.column(1).to_pylist()) if t and TRIGGER.search(t) for r in one.scan(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True)]], names=[f.split()[0] for f in schema.split(", ")]
            )

    return store.spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))).mapInArrow(scan, schema)
