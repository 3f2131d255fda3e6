"""Mixing against a plain computation and SQL, surrogates against their rules, page extraction, the pipeline."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, mixing, queries, sitetree, surrogates

# mixing


def share(budget, children):
    """{child: (weight, capacity)} -> {child: budget}: water rises until the budget is used or all are full."""
    got, open_ = {}, dict(children)
    while open_:
        level = (budget - sum(got.values())) / sum(w for w, _ in open_.values())
        full = [k for k, (w, cap) in open_.items() if cap <= level * w]
        if not full:
            return got | {k: int(level * w) for k, (w, cap) in open_.items()}
        for k in full:
            got[k] = open_.pop(k)[1]
    return got


def plain_mix(rows, weight, total, epochs, seed):
    """rows: (id, domain, lang, source, tokens) -> sorted (id, epoch)."""
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1:4], []).append(r)
    budgets = {(): total}
    for depth in range(3):
        caps = {}
        for leaf, own in leaves.items():
            caps[leaf[: depth + 1]] = caps.get(leaf[: depth + 1], 0) + epochs * sum(r[4] for r in own)
        for parent in [p for p in budgets if len(p) == depth]:
            mine = {k: (weight(k), c) for k, c in caps.items() if k[:depth] == parent and c > 0}
            budgets |= share(budgets[parent], mine) if mine else {}
    out = []
    for leaf, own in leaves.items():
        left, size = int(budgets.get(leaf, 0)), sum(r[4] for r in own)
        for epoch in range(left // size if size else 0):
            out += [(r[0], epoch) for r in own]
        epoch = left // size if size else 0
        left -= epoch * size
        place = lambda r: int(hashlib.md5(f"{seed}|{epoch}|{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        for p in sorted({place(r) for r in own}) if left > 0 else ():
            same = [r for r in own if place(r) == p]
            left -= sum(r[4] for r in same)
            if left < 0:
                break
            out += [(r[0], epoch) for r in same]
    return sorted(out, key=str)


@pytest.mark.parametrize("total, epochs", [(0, 2), (500, 2), (3000, 2), (3000, 1), (100000, 3), (1, 1)])
def test_mix(spark, total, epochs):
    import random

    rng = random.Random(total + epochs)
    rows = []
    for k in range(300):
        rows.append((k if k % 50 else None, rng.choice("ab"), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3"]), rng.randrange(30)))
    rows += rows[:5]
    df = spark.createDataFrame([(i, d, lang, s, None if t == 7 else "x" * 4 * t, 1, 2) for i, d, lang, s, t in rows], "doc_id long, d string, lang string, source string, text string, epoch int, mix_domain int")
    weights = {("a",): 3.0, ("a", "en"): 5.0, ("b", "de"): 0.5}
    given_ = F.when((F.col("level_no") == 0) & (F.col("domain") == "a"), 3.0).when((F.col("level_no") == 1) & (F.col("domain") == "a") & (F.col("lang") == "en"), 5.0).when((F.col("level_no") == 1) & (F.col("domain") == "b") & (F.col("lang") == "de"), 0.5).otherwise(1.0)
    out = mixing.mix(df, F.col("d"), given_, total=total, epochs=epochs, seed=9)
    assert out.columns == [*df.columns, "mix"]
    got = sorted(((r.doc_id, r.mix.epoch) for r in out.collect()), key=str)
    want = plain_mix([(i, d, lang or "unknown", s, 0 if t == 7 else t) for i, d, lang, s, t in rows], lambda k: weights.get(k, 1.0), total, epochs, 9)
    assert got == want


def test_mix_odd_tables(odd_docs, docs_of):
    out = mixing.mix(odd_docs, F.lit(None).cast("string"), F.lit(1.0), share=1.0, epochs=1)
    assert out.count() == odd_docs.count() and out.columns == [*odd_docs.columns, "mix"]
    assert mixing.mix(docs_of([]), F.lit("d"), F.lit(1.0)).count() == 0


def test_mix_query_equals_sql(spark, sf):
    got = queries.op9_mixing(spark, sf)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    r = duck.execute(queries.oracle_sql()["op9_mixing"])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, r.fetchall())) == sorted(str(tuple(x[n] for n in names)) for x in got.collect())


# surrogates

TEXT = """Write to Ann.Lee42@mail.shop.org or ann.lee42@mail.shop.org, call +1 (183) 555-1276 or 183-555-1276,
from 10.20.30.40. Card 4111 1111 1111 1111 and 4111111111111111, not 1234567890123456. SSN 123-45-6789.
token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" but commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff.
Mr. John Smith met Mary Smith, MRS was not there; Frau Müller and Господин Иван Петров were. Version 2.0.0."""


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.text, list(r.pii_found) if r.pii_found is not None else None) for r in surrogates.pseudonymise(df, key).collect()}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_surrogates_keep_kind_form_and_identity(spark):
    new, found = replaced(spark, [TEXT])[0]
    assert len(found) == 14
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s)))
    mails = re.findall(r"\S+@\S+\w", new)
    assert mails[0] != mails[1] and mails[0].lower() == mails[1] and mails[0].endswith(".example.org") and shape(mails[0]).startswith("Aaa.Aaa00@aaaa.")
    phones = re.search(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", new)
    assert re.sub(r"\D", "", phones[1])[1:] == re.sub(r"\D", "", phones[2]) != "1835551276"
    cards = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}), not 1234567890123456", new)
    assert cards[1].replace(" ", "") == cards[2] != "4" + "1" * 15 and luhn(cards[2]) and cards[2][0] == "4"
    ip = re.search(r"from ([\d.]+)\. Card", new)[1]
    assert ip != "10.20.30.40" and all(0 < int(x) < 255 for x in ip.split("."))
    assert re.search(r"SSN \d{3}-\d{2}-\d{4}\.", new) and "123-45-6789" not in new
    assert re.search(r'token = "[0-9a-f]{40}" but commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff\.', new)
    names = re.search(r"Mr\. (\w+) (\w+) met (\w+) (\w+), MRS was not there; Frau (\w+) and Господин (\w+) (\w+) were. Version 2.0.0", new)
    first = surrogates.FIRST_NAMES
    assert names[1] in first["m", "latin"] and names[3] in first["f", "latin"] and names[6] in first["m", "cyrillic"]
    assert names[2] == names[4] != "Smith" and names[1] != "John" and names[3] != "Mary" and re.fullmatch("[А-Я][а-я]+", names[7])
    again = replaced(spark, ["other", TEXT])
    assert again[1][0] == new and again[0] == ("other", [])
    assert replaced(spark, [TEXT], "another key")[0][0] != new


@pytest.mark.parametrize("literal", [500, 0])
def test_surrogates_stay_distinct(spark, monkeypatch, literal):
    monkeypatch.setattr(surrogates, "LITERAL", literal)
    # one letter before the sign: the first replacements must collide
    mails = [f"{c}@x.com" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"{c}{d}@y.com" for c in "abcdef" for d in "0123456789"]
    ips = [f"10.0.{a}.{b}" for a in range(10) for b in range(10)]
    out = replaced(spark, [f"mail {m} and {m.upper()} now" for m in mails] + [f"host {i} up" for i in ips] + [" ".join(mails)])
    new = {m: out[k][0].split()[1] for k, m in enumerate(mails)}
    assert len(set(new.values())) == len(mails) and not set(new.values()) & set(mails)
    assert all(out[k][0].split()[3].lower() == new[m] for k, m in enumerate(mails))
    assert out[len(mails) + len(ips)][0] == " ".join(new[m] for m in mails)
    hosts = [out[len(mails) + k][0].split()[1] for k in range(len(ips))]
    assert len(set(hosts)) == len(ips) and not set(hosts) & set(ips)


def test_surrogates_leave_other_text_alone(spark):
    texts = ["", None, "Version 2.0.1 of 2024-01-02", "ALL CAPS!! 12 | 34 | 5.6%", "x" * 100_000, "1.2.3", "3.14159265358979323", "call 12345", "a@b", "Mister Nobody", "no. 1234-5678", "ISBN 978-3-16-148410-0"]
    assert {k: v[0] for k, v in replaced(spark, texts).items()} == dict(enumerate(texts))


def test_surrogates_odd_rows(odd_docs, docs_of):
    out = surrogates.pseudonymise(odd_docs, "k", found_col="found")
    assert out.columns == [*odd_docs.columns, "found"]
    assert sorted(map(str, out.drop("found").collect())) == sorted(map(str, odd_docs.collect()))
    assert surrogates.pseudonymise(docs_of([]), "k").count() == 0


def test_pii_query_finds_what_a_plain_search_finds(spark):
    sf = "/root/testdata/sf0.01"
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    new = {r.doc_id: r for r in queries.op7_pii_surrogates(spark, sf).collect()}
    assert set(old) == set(new)
    pairs = {}
    for i, text in old.items():
        mails, ips, phones = re.findall(r"[\w.]+@[\w.]+\.\w+", text), re.findall(r"(?<![\w.])\d+\.\d+\.\d+\.\d+", text), re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", text)
        cards = [c for c in re.findall(r"(?<!\w)\d{16}(?!\w)", text) if luhn(c) and c[0] in "3456"]
        r = new[i]
        assert (r.n_email, r.n_ip, r.n_phone, r.n_card) == (len(mails), len(ips), len(phones), len(cards))
        assert not any(x in r.text for x in mails + ips + phones + cards)
        if not (r.n_email + r.n_ip + r.n_phone + r.n_card + r.n_secret + r.n_name + r.n_ssn):
            assert r.text == text
        for x, y in zip(mails, re.findall(r"[\w.]+@[\w.]+\.\w+", r.text), strict=True):
            pairs.setdefault(x, set()).add(y)
    assert all(len(v) == 1 for v in pairs.values())


# pages


def text(source, url="http://a.b/c"):
    return sitetree.text_of(url, source.encode(), frozenset())


def test_blocks_and_noise():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div class="ad">buy</div><!-- <p>no</p> -->
    <article><header><h1>Head&amp;line &lt;1&gt;</h1></header><p><b>Bold<br><p>one <i>t</i>wo&nbsp;&#233;
    three<br/>four<ul><li>a<li>b</ul><aside>side</aside><div id="comments"><p>nice</div><form>f<input value="x"></form><p>a < b</p></article>
    <div class='cookie-notice'>cookies</div><p>outside</p><footer>&copy; x</footer></body></html>"""
    assert text(page) == "Head&line <1>\nBold\none two é three four\na\nb\na < b"


def test_pages_without_article():
    assert text("<body><div id=content><h2>T</h2>plain<p>x<table><tr><td>1<td>2<tr><td>3</table></div><div class='sidebar'>s</div>") == "T\nplain\nx\n1\n2\n3"
    assert text("") == "" == text("<script>x") and text("no markup &amp; all") == "no markup & all"
    assert text("<p>a</b></i></p></div>b<") == "a\nb<"


@given(st.text("<>/ap\"'=!- \n&;x", max_size=80))
@settings(max_examples=500, deadline=None)
def test_any_markup_parses(source):
    assert isinstance(text(source), str)


@pytest.mark.parametrize("label", ["class='top-menu'", "id=sideBar class=x", "class=adBox", "class='ad-12'", "role=navigation", "hidden", "style='color:red; display: none'", "class='post-comments'", "id='cookieNotice'", "class='newsletter signup'"])
def test_labels_that_rule_out(label):
    assert text(f"<body><article><p>a</p><div {label}><p>gone</p></div><section {label}>gone</section><p class=lead>b</p></article>") == "a\nb"


def test_host():
    assert [sitetree.host_of(u) for u in ("http://User@A.example.org:80/x", "//b.c?q", "nothing", None, "https://x#y")] == ["a.example.org", "b.c", "", "", "x"]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_style_tree_removes_what_a_site_repeats(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sitetree, "BROADCAST_ROWS", broadcast)
    page = "<html><body><div class=top>Welcome to the site</div><div class=text><p>Story {0} is {0}</p><p>The same end</p></div><div class=text2>All rights reserved</div></body></html>"
    rows = [(k, "http://s.org/%d" % k, page.format(k)) for k in range(20)] + [(100, "http://s.org/5", page.format(5)), (101, "http://t.org", page.format(7)), (102, None, None), (None, "http://s.org", page.format(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("h", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)
    got = {r.id: (r.text, r.n_chars) for r in sitetree.main_text(df).collect()}
    want = "Story 5 is 5"
    assert got[5] == got[100] == (want, len(want)) and got[102] == ("", 0) and got[None][0].startswith("Story 3")
    assert got[101][0].startswith("Welcome")  # a site of one page: undecided, so kept
    assert sitetree.main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_count_once(spark):
    page = "<body><div class=text><p>only one story</p></div></body>"
    df = spark.createDataFrame([(k, "http://s.org", page) for k in range(50)], "page_id long, url string, html string")
    assert {r.text for r in sitetree.main_text(df).collect()} == {"only one story"}


def test_page_query(spark):
    import html

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in queries.op5_site_style_tree(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n".join(p for p in parts if p)


# the pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries_stored(stage(spark, docs, sf))
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] == seen[3] > 0 and seen[4] > 0
    path, pattern = queries.byte_bpe()
    last = {(r.doc_id, r.decoded_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert last == {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect()}
    table = bpe._bytes_of(path)
    ids = {r.doc_id: b"".join(table[i] for i in r.ids).decode() for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert ids == {r.doc_id: r.text for r in docs.collect()}
    ran = corpus_pipeline.run(spark, sf)
    assert {(r.doc_id, r.decoded_sha256) for r in ran.collect()} == last and bpe.ranks(path) and pattern


def queries_stored(df):
    from millrace.llm.common import stored

    return stored(df, "test-stage")


def test_pipeline_odd_rows(spark, odd_docs, docs_of, sf):
    for df in (odd_docs, docs_of([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = queries_stored(stage(spark, df, sf))
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == df.count()
