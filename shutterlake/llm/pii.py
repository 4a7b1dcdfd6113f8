"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Email, ip, card and phone spans are fixed by their patterns and checks and always
reported.  International account numbers (mod 97), social security numbers, bank
routing numbers (their check digit) and phone numbers without a country are
reported where their score, raised by context words, reaches the threshold and
no other span overlaps them.  An account number's checksum is enough by itself;
the other three are numbers of common shapes, so their context decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import store

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "routing", "phone_national")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the first digit of a run: later ones share its continuation.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an account number by country, as registered.
IBAN_LENGTH = {
    country: int(length)
    for length, countries in (
        line.split(":")
        for line in (
            "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
            "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST",
            "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV", "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
        )
    )
    for country in countries.split()
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

ROUTING = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-]|\.[0-9])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-]|\.[0-9])")

#: Words that raise a kind's score when they stand near a span.
CONTEXT = {
    "email": ("mail", "contact", "address", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "routing": ("routing", "aba", "rtn", "bank"),
    "phone_national": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"),
}
#: Score without context; a checksum is strong evidence, a bare pattern is not.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "routing": 0.3, "phone_national": 0.3}


@dataclass(frozen=True)
class PiiParams:
    window: int = 40
    bonus: float = 0.3
    threshold: float = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long words cost no more than their length."""
    found, least, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            least = m.end()
        at = text.find("@", max(at + 1, least))
    return found


def accounts(text: str) -> list[tuple[int, int]]:
    """Account numbers whose checksum holds, leftmost first, each cut out of the stretch of capitals and digits it begins.

    In order: what has the country's length, the whole stretch, and for unknown
    countries whatever else ends where a word does, the longest first.
    """
    found = []
    m = IBAN.search(text)
    while m:
        start, stretch = m.start(), m[0]
        ends = [k for k in range(15, len(stretch) + 1) if stretch[k - 1] != " " and stretch[k : k + 1] in ("", " ")]
        sizes = {k: k - stretch.count(" ", 0, k) for k in ends}
        length = IBAN_LENGTH.get(stretch[:2])
        order = [k for k in ends if sizes[k] == length]
        order += [len(stretch)] if length else [k for k in reversed(ends) if sizes[k] >= 15]
        end = next((start + k for k in order if mod97(stretch[:k].replace(" ", ""))), None)
        if end:
            found.append((start, end))
        m = IBAN.search(text, end or start + 1)
    return found


def routing_check(digits: str) -> bool:
    """Nine digits weighted 3, 7, 1 in turn add up to a multiple of ten."""
    return digits != "0" * 9 and sum(int(d) * (3, 7, 1)[k % 3] for k, d in enumerate(digits)) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end), in that order."""
    spans = [(a, 0, b) for a, b in emails(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(spans)


def _score(text: str, kind: str, start: int, end: int, p: PiiParams) -> float:
    near = text[max(0, start - p.window) : start].lower() + " " + text[end : end + p.window].lower()
    words = re.findall(r"\w+", near)
    return min(1.0, PRIOR[kind] + p.bonus * any(w.startswith(c) for c in CONTEXT[kind] for w in words))


class _Taken:
    """Stretches of a text that spans hold already, merged and in order, so that a look-up is a bisection."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, start: int, end: int) -> bool:
        # Stretches are apart, so of those that begin before ``end`` the last reaches furthest.
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def find_spans(text: str, p: PiiParams = PiiParams()) -> list[tuple[int, int, int, float]]:
    """(start, rank of kind, end, score) of all reported spans, in that order."""
    base = base_spans(text)
    more = []
    proposed = (
        (4, accounts(text)), (5, [m.span() for m in SSN.finditer(text)]), (6, [m.span() for m in ROUTING.finditer(text) if routing_check(m[0])]),
        (7, [m.span() for m in NATIONAL.finditer(text) if 9 <= len(digits_of(m[0])) <= 12]),
    )
    taken = None
    for rank, spans in proposed:
        if spans:
            # Spans of one kind never overlap each other.
            taken = taken or _Taken((a, b) for a, _, b in base + more)
            kept = [(a, rank, b) for a, b in spans if not taken.overlaps(a, b) and _score(text, KINDS[rank], a, b, p) >= p.threshold]
            if kept:
                more, taken = more + kept, None
    return [(a, k, b, round(_score(text, KINDS[k], a, b, p), 3)) for a, k, b in sorted(base + more)]


def redact(text: str, spans) -> str:
    """Spans replaced by their kind's name in angle brackets; where spans overlap, the first one names the stretch."""
    out, at = [], 0
    for start, rank, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[rank].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


REPORT = "array<struct<kind:string,start:int,end:int,score:double>>"


def pii_spans(docs: DataFrame, params: PiiParams = PiiParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` with ``spans`` an array of (kind, start, end, score); offsets in code points, end exclusive.

    Null and empty texts have no spans; rows with the same id each give a row; no
    rows give none; other columns are not looked at, whatever their names.
    One narrow stage over Arrow batches; a row's memory is its own text's.
    """

    def scan(batches):
        store.starts("pii")
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in find_spans(t or "", params)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], names=[id_col, "spans"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return store.spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))).mapInArrow(scan, f"{id_col} {kind}, spans {REPORT}")


def pii_digest(docs: DataFrame, params: PiiParams = PiiParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans: ``n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    found = pii_spans(docs, params, id_col=id_col, text_col=text_col)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, params: PiiParams = PiiParams(), *, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, every row and all other columns as they are.

    Null texts stay null and empty ones empty; rows that repeat an id are each
    treated; no rows give none.  A text of any length is treated whole.
    """

    @F.pandas_udf("string")
    def clean(texts):
        store.starts("pii")
        return texts.map(lambda t: t if t is None else redact(t, find_spans(t, params)))

    return docs.withColumn(text_col, clean(F.col(text_col)))
