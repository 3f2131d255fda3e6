"""op7: texts and entity sets that once overflowed the stack or used up a form's replacements."""

import re

from pyspark.sql import functions as F

from millrace.llm import queries, surrogates

N = 100_000
LONG = ("a@" + "b." * N + "c1", "a@" + "b." * N + "com", "@" * N, "." * N, "1" * N, "1 " * N, "1-" * N, "1.2." * N, "+1 " * N, "a@b" * N, "a." * N + "@b.com", "token=" * N, "Mr " * N, "Anna " * N, "(123) " * N, "A" * N, "Ab-" * N, "4111 " * N)


def test_long_runs_do_not_kill_an_executor(spark, docs_of):
    out = {r.doc_id: r.text for r in surrogates.pseudonymise(docs_of([*LONG, "plain"], 8), queries.PII_KEY).collect()}
    assert set(out) == set(range(len(LONG) + 1)) and out[len(LONG)] == "plain"
    for k in (2, 3, 4, 7, 15):  # nothing to find there
        assert out[k] == LONG[k]


def test_hosts_at_the_bound(spark, docs_of):
    good = ["x@" + "b." * n + "com" for n in (1, 50, 120)]
    out = {r.doc_id: r for r in surrogates.pseudonymise(docs_of(good), "k").collect()}
    assert all(r.pii_found == [good[i]] and good[i] not in r.text for i, r in out.items())


def test_all_numbers_of_four_digits(spark, docs_of):
    """Every short number occurs, so none is left as a replacement: they grow by a group of digits, and stay distinct."""
    numbers = [f"+1 {k // 100:02d} {k % 100:02d}" for k in range(10_000)]
    out = surrogates.pseudonymise(docs_of([" ; ".join(numbers[k : k + 100]) for k in range(0, 10_000, 100)] + ["call " + numbers[17]], 4), "k").orderBy("doc_id").collect()
    new = [x for r in out[:-1] for x in r.text.split(" ; ")]
    assert len(set(new)) == 10_000 and not set(new) & set(numbers)
    assert all(re.fullmatch(r"\+1 \d\d \d\d \d{3} \d{3}", x) for x in new)
    assert out[-1].text == "call " + new[17]


def test_what_stays_in_conflict_becomes_a_tag(spark, docs_of, monkeypatch):
    monkeypatch.setattr(surrogates, "_LONGER", 99)
    monkeypatch.setattr(surrogates, "_TRIES", 2)
    numbers = [f"+1 {k // 100:02d} {k % 100:02d}" for k in range(10_000)]
    out = surrogates.pseudonymise(docs_of([" ; ".join(numbers)], 1), "k").select(F.explode(F.split("text", " ; ")).alias("x"))
    new = {r.x for r in out.collect()}
    assert len(new) == 10_000 and all(re.fullmatch(r"\[phone-[0-9a-f]{32}\]", x) for x in new)
