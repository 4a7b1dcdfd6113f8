"""Texts with very many spans."""

import random
import time

from shutterlake.llm import pii


def plain_spans(text, p):
    """Every span against all that are kept before it."""
    kept = [(a, k, b) for a, k, b in pii.base_spans(text)]
    kinds = (
        (4, pii.accounts(text)), (5, [m.span() for m in pii.SSN.finditer(text)]), (6, [m.span() for m in pii.ROUTING.finditer(text) if pii.routing_check(m[0])]),
        (7, [m.span() for m in pii.NATIONAL.finditer(text) if 9 <= len(pii.digits_of(m[0])) <= 12]),
    )
    for k, spans in kinds:
        for a, b in spans:
            if pii._score(text, pii.KINDS[k], a, b, p) >= p.threshold and all(y <= a or b <= x for x, _, y in kept):
                kept.append((a, k, b))
    return sorted(kept)


def test_overlaps_are_those_of_comparing_all():
    r = random.Random(6)
    parts = ["DE89 3704 0044 0532 0130 00", "123-45-6789", "021000021", "call 555 123 4567", "+49 30 1234567", "4111 1111 1111 1111", "a@b.co", "10.0.0.1", "ssn", "routing", "phone", " ", "\n", ",", "12", "tel"]
    some = 0
    for _ in range(400):
        text = r.choice(["", " "]).join(r.choice(parts) for _ in range(r.randrange(1, 30)))
        got = [(a, k, b) for a, k, b, _ in pii.find_spans(text)]
        assert got == plain_spans(text, pii.PiiParams())
        some += sum(k > 3 for _, k, _ in got)
    assert some > 500


def test_a_hundred_thousand_numbers_in_one_text():
    text = " ".join(f"call 555 {k % 900 + 100} {k % 9000 + 1000}" for k in range(100_000))
    begun = time.process_time()
    assert len(pii.find_spans(text)) == 100_000 and time.process_time() - begun < 60
