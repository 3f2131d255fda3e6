"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of elements with their classes, hashed from
the root, and knows on how many different pages it stands, with which contents and with which sequences of
children. All branches are in it: menus, adverts, footers and paragraphs alike.

- Content: a branch whose very content stands at the same node of many pages while the rest of the page
  changes is of low importance. The rest is known by its longest blocks, so near copies of an article, which
  share these too, don't make their paragraphs look like boilerplate.
- Presentation: the entropy of a node's sequences of children over its pages, and of its contents, is its
  importance where nothing else speaks: it keeps lists of links that differ from page to page.
- Priors: an element's tag, role and classes (navigation, adverts, forms, comments, ...) and an article that
  holds most of a page's text count for or against a branch before any statistics.

A branch's importance is the sum of its prior and what the tree says; branches below zero are removed. The
tree never removes what holds half of a page's text, nor paragraphs and headings of the article, where only
whole sections can be unimportant. Exact copies of a page count once, and what
stands on few pages is undecided, which leaves the prior.

Trees are kept as sums: a row for each node, content and page, hashed, is pre-aggregated by node and
content, so a host with a third of the pages is no hot key. Pages meet only the verdicts on their own nodes.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, prepare, stored

#: What stands on fewer different pages than this is undecided.
MIN_PAGES = 8
#: Contents are boilerplate if the entropy of the rest of their pages, of 1 at most, is this at least; the rest is known by so
#: many blocks, the longest outside that aren't headings and aren't shorter than this part of the first.
SPREAD, CORES, CORE_PART = 0.8, 3, 0.25
#: A text outside articles of this length competes with them even if it is no paragraph or heading.
LONG = 200
#: Lists of links are kept from this importance on.
LEAST = 0.5
#: Verdicts of up to this many rows are broadcast to the pages.
BROADCAST_ROWS = 200_000
#: What the tree adds for boilerplate, and priors: of texts and sections, in the article and outside, of noise by label and by tag, and of hidden elements.
REPEATED, TEXT_INSIDE, TEXT, SECTION, BY_LABEL, BY_TAG, HIDDEN = -4.0, 5.0, 1.5, 1.0, -3.0, -4.0, -9.0
#: Links make up this share of a list of links; it has a prior of its own.
LINKED, LINKS = 0.7, -1.0

# Elements and words of class, id and role that tell what a branch is.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math canvas object audio video title select".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog button".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget widgets complementary contentinfo dialog alert".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_token = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|$)", re.S)
_attribute = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_hidden = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none", re.I)
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_host = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _host.match(url or "")
    return m[1].lower() if m else ""


_MASK = (1 << 64) - 1
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WRAPPERS = BLOCKS - {"nav", "footer", "aside", "menu", "dialog"}


def _hash(x: str, seed: int = 9) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), seed)


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def _mix(x: int, y: int) -> int:
    """A hash of two numbers, in order."""
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 + y) & _MASK
    x = ((x ^ (x >> 32)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


@lru_cache(1 << 14)
def _element(tag: str, attrs: str) -> tuple[str, float, str]:
    """(label, prior, kind) of an element by itself; kind: root, main, header (noise outside an article), text or other."""
    label, words, role = tag, set(), ""
    if attrs:
        for m in _attribute.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            words.update(w.lower() for w in _word.findall(value))
            words.update(re.sub(r"[\W_]", "", w).lower() for w in value.split())
            label += "." + re.sub(r"\d+", "#", value)
            role = value.strip().lower() if m[1].lower() == "role" else role
    if tag in ("html", "body"):
        return label, 99.0, "root"
    if tag in ("main", "article") and not words & {"comment", "comments", "teaser", "related"}:
        return label, SECTION, "main"
    if _hidden.search(attrs):
        return label, HIDDEN, "other"
    if tag in NOISE_TAGS:
        return label, BY_TAG, "other"
    if words & NOISE_WORDS or role in ("banner", "search", "form"):
        return label, BY_LABEL, "other"
    if tag == "header" or "header" in words and tag == "div":
        return label, SECTION, "header"
    return label, TEXT if tag in _TEXTS else SECTION, "text" if tag in _TEXTS else "other"


class Page:
    """A page's tree of block elements, in page order, and its blocks of text.

    Nodes are lists by their number: parent, key (the hash of host and path), tag, prior, kind; number 0 is the
    page itself. blocks: (node, text, characters of links). Inline elements are no nodes: what their own
    attributes rule out is left out at once.
    """

    def __init__(self, source: str, host: str = ""):
        self.parent, self.key, self.tag, self.prior, self.kind, self.label = [0], [_hash(host)], [""], [99.0], ["root"], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.order: list[int] = []  # nodes, and blocks as -1 - their number, in page order
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, node, left out, block
        self.open: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.linked = 0
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                break
            if lt > at:
                self._text(source[at:lt])
            m = _token.match(source, lt)
            if not m:
                self._text("<")
                at = lt + 1
                continue
            at = m.end()
            if m[1] is not None:
                self._text(m[1])
            elif m[3]:
                tag = m[3].lower()
                if m[2]:
                    self._close(tag)
                else:
                    attrs = m[4] or ""
                    if tag in RAW and not attrs.endswith("/"):
                        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                        end = end.start() if end else n
                        at = source.find(">", end) + 1 or n
                    elif tag not in RAW:
                        self._open(tag, attrs)
        self._flush()

    def _open(self, tag: str, attrs: str) -> None:
        block = tag in BLOCKS
        if tag == "br" or tag == "hr":
            self.pieces.append(" ")
        if block:
            self._flush()
            while self.open["p"] and self._inner("p"):
                self._pop_to("p")
            for other in CLOSES.get(tag, ()):
                if self.open[other]:
                    self._implied(other, SCOPES.get(tag, ()))
        if tag in VOID or attrs.endswith("/") and not block:
            return
        up, out = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (0, False)
        if block:
            label, prior, kind = _element(tag, attrs)
            up, out = len(self.parent), False  # what the element is in counts through its parent
            self.order.append(up)
            self.parent.append(self.stack[-1][1] if self.stack else 0)
            self.label.append(_hash(label))
            self.key.append(_mix(self.key[self.parent[-1]], self.label[-1]))
            self.tag.append(tag)
            self.prior.append(HIDDEN if self.stack and self.stack[-1][2] else prior)
            self.kind.append(kind)
        elif attrs:
            out = out or _element(tag, attrs)[1] < 0
        self.open[tag] += 1
        self.stack.append((tag, up, out, block))

    def _inner(self, tag: str) -> bool:
        """Whether an open element of that tag has only inline elements inside."""
        for t in reversed(self.stack):
            if t[0] == tag:
                return True
            if t[3]:
                return False
        return False

    def _implied(self, tag: str, scope: tuple[str, ...]) -> None:
        for t in reversed(self.stack):
            if t[0] == tag:
                self._pop_to(tag)
                return
            if t[0] in scope:
                return

    def _pop_to(self, tag: str) -> None:
        while self.stack:
            t = self.stack.pop()[0]
            self.open[t] -= 1
            if t == tag:
                return

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        if tag in BLOCKS:
            self._flush()
            self._pop_to(tag)
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][3]:
                return  # an inline element that began outside this block
            if self.stack[k][0] == tag:
                for t in self.stack[k:]:
                    self.open[t[0]] -= 1
                del self.stack[k:]
                return

    def _text(self, s: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            self.pieces.append(s)
            if self.open["a"]:
                self.linked += len(s.strip())

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join(_html.unescape("".join(self.pieces)).split())
            self.pieces = []
            if text:
                self.order.append(-1 - len(self.blocks))
                self.blocks.append((self.stack[-1][1] if self.stack else 0, text, min(self.linked, len(text))))
        self.linked = 0

    def measure(self) -> None:
        """Sums over branches, from the last element to the first: characters, those of links, the content's and the children's hashes."""
        n = len(self.parent)
        self.size, self.links, self.content, self.shape, last = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        self.block_hash = [_hash(t) for _, t, _ in self.blocks]
        for x in reversed(self.order):
            if x < 0:
                node, text, linked = self.blocks[-1 - x]
                self.size[node] += len(text)
                self.links[node] += linked
                self.content[node] = _mix(self.content[node], self.block_hash[-1 - x])
                continue
            up = self.parent[x]
            self.size[up] += self.size[x]
            self.links[up] += self.links[x]
            if self.size[x]:
                self.content[up] = _mix(self.content[up], self.content[x])
            if last[up] != self.label[x]:  # repeated children count once
                self.shape[up], last[up] = _mix(self.shape[up], self.label[x]), self.label[x]
        tall = [k for k, (x, _, _) in enumerate(self.blocks) if self.tag[x] not in _HEADINGS]
        self.longest = sorted(tall, key=lambda k: -len(self.blocks[k][1]))[: 4 * CORES]
        self.last = list(range(n))  # the nodes of a branch are x to last[x]
        for x in range(n - 1, 0, -1):
            self.last[self.parent[x]] = max(self.last[self.parent[x]], self.last[x])

    def dense(self, x: int) -> bool:
        """Whether a branch is a list of links."""
        return self.kind[x] != "root" and self.size[x] > 0 and self.links[x] >= LINKED * self.size[x]

    def may_repeat(self, x: int) -> bool:
        """Whether the tree may find a branch's content to be boilerplate."""
        return 2 * self.size[x] < self.size[0]

    def cores(self, x: int) -> list[int]:
        """Hashes of the longest blocks outside a branch."""
        out, least = [], 0.0
        for k in self.longest:
            node, size = self.blocks[k][0], len(self.blocks[k][1])
            if not x <= node <= self.last[x]:
                least = least or CORE_PART * size
                if len(out) == CORES or size < least:
                    break
                out.append(self.block_hash[k])
        return out

    def rows(self) -> Iterator[tuple[int, int, int, tuple[int, ...], bool]]:
        """(node, content, children, cores, is a list of links) of the elements with text. cores: the longest blocks outside, or the content itself if it can't be boilerplate."""
        for x in range(1, len(self.parent)):
            if self.size[x] and self.kind[x] != "root":
                yield self.key[x], self.content[x], self.shape[x], tuple(self.cores(x)) if self.may_repeat(x) else (self.content[x],), self.dense(x)

    def main(self, known: frozenset[int]) -> list[str]:
        """The blocks of the important branches. known: the verdicts on this page's nodes, see verdicts()."""
        n = len(self.parent)
        inside, around, bad = [False] * n, [False] * n, [False] * n
        mains = False
        for x in range(1, n):
            up = self.parent[x]
            bad[x] = bad[up] or self.prior[x] < 0
            inside[x] = inside[up] or self.kind[x] == "main" and not bad[x]
            mains = mains or inside[x]
        for x in range(1, n):  # headers of the page, not of an article
            if self.kind[x] == "header" and not inside[x]:
                self.prior[x] = BY_LABEL
            bad[x] = bad[self.parent[x]] or self.prior[x] < 0
        good = [(inside[k], len(t)) for k, t, _ in self.blocks if not bad[k] and (inside[k] or self.kind[k] == "text" or len(t) >= LONG)]
        article = mains and 2 * sum(m for i, m in good if i) >= sum(m for _, m in good)
        for x in range(n - 1, 0, -1):
            around[self.parent[x]] |= around[x] or self.kind[x] in ("main", "text")
        gone = [False] * n
        for x in range(1, n):
            score = self.prior[x]
            if article and inside[x] and score > 0 and self.kind[x] in ("text", "main"):
                score = TEXT_INSIDE
            if not mains and HIDDEN < score < 0 and self.tag[x] in _WRAPPERS and around[x] and 5 * self.size[x] >= 4 * self.size[0]:
                score = SECTION  # wraps the page
            if known and score < 99 and self.size[x]:
                if self.may_repeat(x) and _repeated(self.key[x], self.content[x]) in known:
                    score += REPEATED
            if self.kind[x] == "other" and score > 0 and self.dense(x) and not (article and inside[x]) and self.may_repeat(x):
                score += LINKS + (0 if not known or _varied(self.key[x]) not in known else -LINKS) - (SECTION if self.tag[x] in ("ul", "ol", "dl") else 0)
            gone[x] = gone[self.parent[x]] or score < 0
        return [t for k, t, _ in self.blocks if not gone[k] and (inside[k] or not article)]


def _repeated(node: int, content: int) -> int:
    """The name of the verdict that a content at a node is boilerplate."""
    return _signed(_mix(node, content))


def _varied(node: int) -> int:
    """The name of the verdict that a list of links is important."""
    return _signed(_mix(node, 1))


def _page(url: str | None, source: bytes | None) -> Page:
    return Page((source or b"").decode("utf-8", "replace"), host_of(url))


def _pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    c = lambda x: F.col(f"`{x}`")
    return df.select(c(id_col).alias("id"), c(url_col).cast("string").alias("url"), c(html_col).cast("binary").alias("h"))


def style_tree(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(node, repeated, varied, content, shape, cores, page, dense): the elements with text of each different page of a host.

    repeated and varied name the verdicts that there can be on the element; page is the hash of host and text."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(8)]
        for u, h in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            page = _page(u, h.as_py())
            page.measure()
            own = _signed(_mix(page.key[0], page.content[0]))
            for row in set(page.rows()):
                for c, x in zip(cols, (_signed(row[0]), _repeated(*row[:2]), _varied(row[0]), *map(_signed, row[1:3]), list(map(_signed, row[3])), own, row[4]), strict=True):
                    c.append(x)
        kinds = [*[pa.int64()] * 5, pa.list_(pa.int64()), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["node", "repeated", "varied", "content", "shape", "cores", "page", "dense"])

    names = "node long, repeated long, varied long, content long, shape long, cores array<long>, page long, dense boolean"
    return in_arrow(_pages(df, id_col, url_col, html_col), run, names).dropDuplicates(["repeated", "shape", "page"])


def _entropy(df: DataFrame, by: list[str], of: str) -> DataFrame:
    """by, n (rows), kinds (different values of `of`) and their entropy, to the base of the number of rows: 1 if no two agree, 0 if all do."""
    c = df.groupBy(*by, of).agg(F.count("*").alias("c"))
    sums = c.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return sums.withColumn("entropy", F.when(F.col("n") > 1, 1 - F.col("s") / F.col("n") / F.log("n")).otherwise(1.0)).drop("s")


def importance(tree: DataFrame) -> DataFrame:
    """(node, pages, content, presentation, importance): entropies of a node's contents and of its children over its pages; the importance is the greater."""
    a, b = _entropy(tree, ["node"], "content"), _entropy(tree, ["node"], "shape")
    both = a.select("node", F.col("n").alias("pages"), F.col("entropy").alias("content")).join(b.select("node", F.col("entropy").alias("presentation")), "node")
    return both.withColumn("importance", F.greatest("content", "presentation"))


def verdicts(tree: DataFrame) -> DataFrame:
    """(verdict): the names of what the tree says against contents that are boilerplate, and for lists of links that are important."""
    around = _entropy(tree.select("repeated", F.posexplode("cores").alias("place", "core")), ["repeated", "place"], "core")
    often = around.where((F.col("kinds") >= MIN_PAGES) & (F.col("entropy") >= SPREAD)).select(F.col("repeated").alias("verdict")).distinct()
    lists = tree.where("dense").withColumn("node", F.col("varied"))  # a name for each node
    return often.union(importance(lists).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") >= LEAST)).select("node"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of df: the blocks of the page's important branches, joined by line breaks.

    Character references are decoded and white space within a block (<br> too) becomes one space. A null
    or empty html has the empty text; pages without a host are one site. Very long and very deep pages are
    taken whole, in time in proportion to their length. Ties: of equally long blocks the first is the page's
    longest. Rows with null or repeated ids come back as they are; an empty table gives no rows; other
    columns are ignored, so their names don't matter.
    """
    spark = prepare(df.sparkSession)
    pages = _pages(df, id_col, url_col, html_col)
    tree = stored(style_tree(df, id_col, url_col, html_col), "site-tree")
    said = stored(verdicts(tree), "site-verdicts")
    n = said.count()
    kind = pages.schema[0].dataType.simpleString()
    names = ["id", "url", "text", "n_chars"]

    def give(ids, urls, text: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=names)

    if n <= BROADCAST_ROWS:
        known = spark.sparkContext.broadcast(frozenset(r["verdict"] for r in said.collect()))

        def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = [text_of(u, h.as_py(), known.value) for u, h in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
            yield give(b.column(0), b.column(1), out)

        return in_arrow(pages, run, f"id {kind}, url string, text string, n_chars long")

    # more than is broadcast: each page meets the verdicts on its own nodes, by its content
    of = tree.select("page", F.explode(F.array("repeated", "varied")).alias("verdict")).join(said, "verdict").groupBy("page").agg(F.collect_set("verdict").alias("said"))

    def with_content(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = []
        for u, h in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            page = _page(u, h.as_py())
            page.measure()
            own.append(_signed(_mix(page.key[0], page.content[0])))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=["id", "url", "h", "page"])

    def run_joined(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [text_of(u, h.as_py(), frozenset(x or ())) for u, h, x in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True)]
        yield give(b.column(0), b.column(1), out)

    joined = in_arrow(pages, with_content, f"id {kind}, url string, h binary, page long").join(of, "page", "left").select("id", "url", "h", "said")
    return in_arrow(joined, run_joined, f"id {kind}, url string, text string, n_chars long")


def text_of(url: str | None, source: bytes | None, known: frozenset[int]) -> str:
    """A page's main text by the verdicts on its nodes."""
    page = _page(url, source)
    page.measure()
    return "\n".join(page.main(known))
