"""op5: what the trees decide, as against tags and words."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import sitetree

PAGES = "page_id long, url string, html string"


def table(spark, pages, host="s.org"):
    return spark.createDataFrame([(k, f"http://{host}/{k}", h) for k, h in enumerate(pages)], PAGES).repartition(3)


def texts(df):
    return {r.id: r.text for r in sitetree.main_text(df).collect()}


def plain(df):
    """The same pages by priors alone."""
    return {r.page_id: sitetree.text_of(r.url, r.html.encode(), frozenset()) for r in df.collect()}


SITE = """<body><div class=xa><div>Home</div><div>About the site</div></div><div class=xb><h1>Title {0}</h1><p>First text {0} of some length, and more of it.</p><p>Second {0}</p></div>
<div class=xc>All rights are ours</div></body>"""


def test_without_article_and_words_the_tree_alone_removes_what_a_site_repeats(spark):
    df = table(spark, [SITE.format(k) for k in range(30)])
    want = {k: f"Title {k}\nFirst text {k} of some length, and more of it.\nSecond {k}" for k in range(30)}
    assert texts(df) == want
    without = plain(df)
    assert all(without[k] != want[k] and "About the site" in without[k] and "All rights" in without[k] for k in want)


def test_near_copies_of_an_article_lose_nothing(spark):
    """900 pages share a body under different headings, 100 have their own."""
    body = "".join(f"<p>Paragraph {j} of the shared story, which goes on for a while {'word ' * j}</p>" for j in range(6))
    own = lambda k: "".join(f"<p>Own paragraph {j} of page {k} {'text ' * j}</p>" for j in range(6))
    pages = [f"<body><h1>Heading {k}</h1><div class=body>{body if k < 900 else own(k)}</div><div class=b>Boilerplate here</div></body>" for k in range(1000)]
    got, without = texts(table(spark, pages)), plain(table(spark, pages))
    for k in range(1000):
        assert got[k] in (without[k], without[k].removesuffix("\nBoilerplate here"))
    exact = ["<body><article><h1>A</h1><p>One story</p></article><div class=b>Boilerplate</div></body>"] * 50
    assert set(texts(table(spark, exact)).values()) == {"A\nOne story"}


def test_paragraphs_of_the_article_stay_however_often_they_come(spark):
    pages = [f"<body><article><h1>T{k}</h1><p>Text {k} {'w ' * 20}</p><p>Released under a license.</p><div>Share this</div></article></body>" for k in range(40)]
    assert texts(table(spark, pages)) == {k: f"T{k}\nText {k} {'w ' * 19}w\nReleased under a license." for k in range(40)}


def test_the_article_is_chosen_by_its_share_of_the_text():
    page = b"<body><article class=card><p>A card</p></article><div id=content><h1>T</h1><p>" + b"Long text. " * 30 + b"</p></div></body>"
    assert "Long text." in sitetree.text_of("http://a.b", page, frozenset())
    wrapped = b"<body><form class=page><h1>T</h1><p>" + b"Long text. " * 30 + b"</p></form></body>"
    assert "Long text." in sitetree.text_of("http://a.b", wrapped, frozenset())


def test_lists_of_links(spark):
    """A list of links that differs on every page is important, one on few pages is not known to be."""
    page = "<body><p>" + "Text {0}. " * 20 + "</p><ul><li><a href=x>Link {0} a</a></li><li><a href=y>Link {0} b</a></li></ul></body>"
    assert all("Link" in t for t in texts(table(spark, [page.format(k) for k in range(20)])).values())
    assert "Link" not in texts(table(spark, [page.format(1)]))[0]


@pytest.mark.parametrize("deep", [5000])
def test_deep_pages(spark, deep):
    pages = [SITE.format(k) for k in range(20)] + ["<div>" * deep + "deep text", "<div>x" * deep, "<div>" * deep + "All rights are ours"]
    got = texts(table(spark, pages))
    assert got[20] == "deep text" and got[21].count("x") == deep and got[0].startswith("Title 0\n")


def test_tables_have_trees_and_entropies(spark, sf):
    tree = sitetree.style_tree(spark.read.parquet(f"{sf}/pages.parquet"))
    assert tree.count() > 100
    df = table(spark, [SITE.format(k) for k in range(30)])
    r = sitetree.importance(sitetree.style_tree(df)).agg(F.min("importance").alias("least"), F.max("importance").alias("most"), F.max("pages").alias("pages")).first()
    assert (r.least, r.pages) == (0.0, 60) and r.most == pytest.approx(1.0)  # two paragraphs stand at one node
    assert sitetree.verdicts(sitetree.style_tree(df)).count() >= 3


def test_both_ways_to_the_verdicts_agree(spark, monkeypatch):
    df = table(spark, [SITE.format(k) for k in range(30)]).unionByName(table(spark, [SITE.format(k) for k in range(3)], "t.org"))
    one = sorted((r.url, r.text) for r in sitetree.main_text(df).collect())
    monkeypatch.setattr(sitetree, "BROADCAST_ROWS", 0)
    assert sorted((r.url, r.text) for r in sitetree.main_text(df).collect()) == one
