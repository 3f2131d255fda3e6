"""op7: payment cards among other numbers."""

import re

import pytest

from millrace.llm import queries, surrogates

CARDS = ("4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "378282246310005")
PLACES = ("order 12 {}", "room 7 {}", "{} 12 left", "4000 {}", "12 91 {} 56 7", "1 2  3 {} {}", "call 555-123-4567 {}", "{} 10.20.30.40", "{}.50", "12 34 5678 9012 3456 7890 1234 {}")
LONG = ("no 12345678901234567890123 x", "no 1234567890123--5 x")


def _luhn(digits):
    twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(t - 9 if t > 9 else t for t in twice) % 10 == 0


@pytest.fixture(scope="module")
def swapped(spark, docs_of):
    rows = [p.replace("{}", c) for p in PLACES for c in CARDS] + ["9 8 " * 20000 + "x", "0 " * 50, "call 555-123-4567 555-123-4568", "12 34567890123 456", *LONG]
    out = surrogates.pseudonymise(docs_of(rows), queries.PII_KEY).collect()
    return [(rows[r.doc_id], r.text) for r in out]


def test_no_card_is_left_behind_another_number(swapped):
    some = [(was, now, c) for was, now in swapped for c in CARDS if any(was == p.replace("{}", c) for p in PLACES)]
    assert len(some) == len(PLACES) * len(CARDS)
    for was, now, c in some:
        assert c not in now and was != now
        shape = lambda t: re.sub(r"\d", "9", re.sub(r"(?:\d+\.){3}\d+", "ip", t))
        assert shape(was) == shape(now)
        head, tail = was.split(c)[0], was.split(c)[-1]
        if "555" not in head and len(head) < 13:  # longer ones can hold a number with a right Luhn sum
            assert now.startswith(head)
        if "." not in tail:
            assert now.endswith(tail)
            assert _luhn(re.sub(r"\D", "", now[len(head) : len(head) + len(c)]))


def test_other_numbers(swapped):
    now = dict(swapped)
    for was in ("9 8 " * 20000 + "x", "0 " * 50, "12 34567890123 456", *LONG):
        assert now[was] == was
    assert "555-123-4567" not in now["call 555-123-4567 555-123-4568"] and "555-123-4568" not in now["call 555-123-4567 555-123-4568"]
    assert all("555-123-4567" not in t and "10.20.30.40" not in t for t in now.values())
