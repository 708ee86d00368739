"""Main text of web pages: flat text blocks, described by words and link density of the block and its neighbours and by the elements around
them, and classified by a decision tree trained on a small labelled table.

Elements and class names around a block are features like the others. What is said by an ancestor of an ``<article>`` or ``<main>`` counts
only where the page has another one that it isn't said of (comments and related stories are often articles of their own).

Nulls: null HTML is empty and gives the empty text; a null page_id or url stays. Malformed markup never fails: stray ``<`` is text, end tags
without a start are passed over, unclosed elements end with their parent, unclosed comments and scripts end with the page. Repeated rows
each give a row; a tie in a leaf of the tree goes to the article. Very long pages are read whole, work is in proportion to a page's length.
Empty tables give empty results; columns other than page_id, url and html are left aside, whatever they are called.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnlake.llm import common as C

#: Elements by what they do to text.
RAW = frozenset("script style noscript template iframe noembed noframes xmp".split())
SKIPPED = frozenset("head title textarea select option button svg math canvas object audio video map dialog datalist".split())
BOILER = frozenset("nav footer aside form menu search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
MAIN = frozenset(("article", "main"))
#: An open one of these ends where the next begins.
SIBLINGS = frozenset("li dt dd tr td th".split())
#: Words in a class, id or role that speak for a container that isn't part of the article; words that, in the same name, speak of
#: a page that has such a container; and words that mean the site's parts outside a main element only.
HINTS = frozenset(
    "ad ads adbox advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr "
    "header login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications pagination pager popup privacy promo promotion recommended related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
LAYOUT = frozenset("content has hide is layout no show with without wrap".split())
OUTSIDE_ONLY = frozenset("header masthead".split())
#: Quoted values have any length. Nothing is tried twice, and quotes permute the three states (outside, in either quote), so at most three tags of
#: a page can be read to its end in vain: work stays in proportion to its length.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
HINT_ATTRIBUTES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_main", "in_boiler")
#: The labelled table: blocks of pages by hand, all features, then 1 for text of the article. in_main is 0.5 on pages without a main element.
LABELLED = (
    # Titles, paragraphs and one-word lines of articles, with and without links.
    (84, 0.0, 61, 0.0, 73, 0.0, 1, 0, 1), (12, 0.0, 90, 0.0, 55, 0.0, 1, 0, 1), (1, 0.0, 40, 0.0, 38, 0.0, 1, 0, 1), (7, 0.0, 9, 0.0, 120, 0.0, 1, 0, 1), (140, 0.08, 66, 0.0, 52, 0.0, 1, 0, 1),
    (33, 0.5, 41, 0.0, 60, 0.0, 1, 0, 1), (4, 1.0, 58, 0.0, 70, 0.0, 1, 0, 1), (18, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (260, 0.0, 5, 1.0, 0, 0.0, 1, 0, 1), (9, 0.2, 3, 0.0, 4, 0.0, 1, 0, 1),
    (2, 0.0, 5, 0.0, 3, 0.0, 1, 0, 1), (1, 0.0, 2, 1.0, 1, 0.0, 1, 0, 1), (6, 0.0, 0, 0.0, 2, 1.0, 1, 0, 1), (3, 0.0, 4, 1.0, 6, 1.0, 1, 0, 1), (40, 0.9, 4, 1.0, 50, 0.0, 1, 0, 1), (12, 1.0, 30, 0.0, 7, 0.0, 1, 0, 1),
    (9, 0.8, 30, 0.4, 42, 0.1, 1, 0, 1), (1, 1.0, 30, 0.0, 42, 0.1, 1, 0, 1), (64, 0.3, 3, 1.0, 2, 1.0, 1, 0, 1), (2, 0.0, 2, 1.0, 80, 0.0, 1, 0, 1), (25, 0.6, 3, 1.0, 30, 0.2, 1, 0, 1), (3, 1.0, 80, 0.0, 0, 0.0, 1, 0, 1),
    # Linked titles, sentences and paragraphs of articles.
    (1, 1.0, 0, 0.0, 30, 0.0, 1, 0, 1), (3, 0.7, 0, 0.0, 18, 0.0, 1, 0, 1), (6, 1.0, 60, 0.0, 0, 0.0, 1, 0, 1), (9, 0.8, 18, 0.0, 25, 0.0, 1, 0, 1), (2, 1.0, 0, 0.0, 0, 0.0, 1, 0, 1), (14, 1.0, 5, 0.0, 30, 0.0, 1, 0, 1),
    (25, 0.7, 40, 0.0, 60, 0.0, 1, 0, 1), (40, 0.8, 40, 0.0, 5, 0.0, 1, 0, 1), (100, 0.6, 50, 0.0, 60, 0.0, 1, 0, 1), (20, 0.7, 3, 1.0, 4, 1.0, 1, 0, 1), (40, 0.6, 4, 1.0, 5, 1.0, 1, 0, 1), (15, 1.0, 3, 1.0, 4, 0.0, 1, 0, 1),
    (16, 1.0, 2, 0.0, 4, 1.0, 1, 0, 1), (5, 0.6, 3, 1.0, 4, 1.0, 1, 0, 1), (10, 0.6, 40, 0.0, 4, 1.0, 1, 0, 1), (7, 0.6, 2, 1.0, 20, 0.0, 1, 0, 1), (11, 1.0, 5, 0.0, 3, 0.0, 1, 0, 1), (4, 1.0, 6, 0.0, 9, 0.2, 1, 0, 1),
    (40, 1.0, 40, 0.2, 3, 1.0, 1, 0, 1),
    # Lists of links inside articles: one link after the other.
    (3, 1.0, 2, 1.0, 0, 0.0, 1, 0, 0), (11, 1.0, 3, 1.0, 5, 0.0, 1, 0, 0), (8, 1.0, 40, 0.0, 6, 1.0, 1, 0, 0), (5, 1.0, 60, 0.0, 4, 1.0, 1, 0, 0), (9, 1.0, 4, 1.0, 30, 0.0, 1, 0, 0), (1, 1.0, 18, 0.0, 2, 1.0, 1, 0, 0),
    (4, 1.0, 3, 1.0, 8, 1.0, 1, 0, 0), (2, 1.0, 5, 1.0, 2, 1.0, 1, 0, 0), (7, 1.0, 6, 1.0, 7, 0.9, 1, 0, 0), (9, 1.0, 12, 0.9, 8, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (11, 0.9, 7, 1.0, 9, 1.0, 1, 0, 0),
    (3, 1.0, 44, 0.0, 4, 1.0, 1, 0, 0), (5, 1.0, 4, 1.0, 0, 0.0, 1, 0, 0), (3, 1.0, 2, 1.0, 60, 0.0, 1, 0, 0), (6, 1.0, 12, 0.0, 5, 1.0, 1, 0, 0),
    # Adverts, notices, forms, asides, shares and comments inside an article.
    (10, 0.0, 9, 0.0, 84, 0.0, 1, 1, 0), (35, 0.0, 61, 0.0, 73, 0.0, 1, 1, 0), (120, 0.1, 60, 0.0, 90, 0.0, 1, 1, 0), (1, 0.0, 50, 0.0, 4, 0.0, 1, 1, 0), (3, 1.0, 70, 0.0, 2, 1.0, 1, 1, 0), (60, 0.0, 0, 0.0, 40, 0.0, 1, 1, 0),
    # The site's parts and stray text around a main element.
    (3, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0), (2, 1.0, 3, 1.0, 4, 1.0, 0, 1, 0), (11, 0.0, 2, 1.0, 9, 0.0, 0, 1, 0), (14, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0), (90, 0.0, 30, 0.0, 40, 0.1, 0, 1, 0),
    (3, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0), (2, 1.0, 3, 1.0, 4, 1.0, 0, 0, 0), (9, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0), (45, 0.0, 80, 0.0, 20, 0.0, 0, 0, 0), (150, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0), (1, 0.0, 90, 0.0, 70, 0.0, 0, 0, 0),
    # Pages without a main element. Named containers first.
    (11, 0.0, 2, 1.0, 9, 0.0, 0.5, 1, 0), (3, 1.0, 0, 0.0, 2, 1.0, 0.5, 1, 0), (48, 0.0, 70, 0.0, 30, 0.0, 0.5, 1, 0), (140, 0.1, 60, 0.0, 90, 0.0, 0.5, 1, 0), (7, 0.0, 90, 0.0, 0, 0.0, 0.5, 1, 0),
    # Paragraphs, among text, beside lists of links, and alone.
    (75, 0.0, 48, 0.0, 92, 0.0, 0.5, 0, 1), (38, 0.05, 5, 0.0, 57, 0.0, 0.5, 0, 1), (110, 0.1, 3, 1.0, 60, 0.0, 0.5, 0, 1), (21, 0.0, 40, 0.0, 4, 0.0, 0.5, 0, 1), (60, 0.0, 45, 0.0, 3, 1.0, 0.5, 0, 1),
    (30, 0.0, 45, 0.0, 2, 1.0, 0.5, 0, 1), (30, 0.0, 3, 1.0, 2, 1.0, 0.5, 0, 1), (16, 0.0, 2, 1.0, 3, 1.0, 0.5, 0, 1), (13, 0.0, 0, 0.0, 0, 0.0, 0.5, 0, 1), (27, 0.0, 70, 0.0, 0, 0.0, 0.5, 0, 1), (150, 0.02, 0, 0.0, 0, 0.0, 0.5, 0, 1),
    (48, 0.2, 20, 1.0, 9, 1.0, 0.5, 0, 1), (19, 0.3, 28, 0.0, 31, 0.0, 0.5, 0, 1), (14, 0.2, 3, 1.0, 40, 0.0, 0.5, 0, 1), (90, 0.4, 40, 0.3, 50, 0.1, 0.5, 0, 1),
    # Titles and short paragraphs beside paragraphs.
    (6, 0.0, 2, 1.0, 66, 0.0, 0.5, 0, 1), (5, 0.0, 47, 0.0, 81, 0.0, 0.5, 0, 1), (8, 0.0, 70, 0.0, 35, 0.0, 0.5, 0, 1), (1, 0.0, 30, 0.0, 28, 0.1, 0.5, 0, 1), (3, 0.0, 0, 0.0, 40, 0.0, 0.5, 0, 1), (4, 0.0, 16, 0.0, 2, 1.0, 0.5, 0, 1),
    (9, 0.2, 60, 0.0, 17, 0.0, 0.5, 0, 1), (2, 0.0, 4, 1.0, 18, 0.0, 0.5, 0, 1), (10, 0.0, 33, 0.0, 0, 0.0, 0.5, 0, 1), (7, 0.1, 25, 0.0, 5, 0.0, 0.5, 0, 1),
    # Menus, link lists, site names, dates and lines among them.
    (3, 1.0, 2, 1.0, 4, 1.0, 0.5, 0, 0), (7, 1.0, 60, 0.0, 5, 1.0, 0.5, 0, 0), (30, 0.9, 2, 1.0, 6, 1.0, 0.5, 0, 0), (16, 0.7, 50, 0.0, 8, 1.0, 0.5, 0, 0), (3, 1.0, 0, 0.0, 75, 0.0, 0.5, 0, 0), (3, 1.0, 80, 0.0, 0, 0.0, 0.5, 0, 0), (2, 1.0, 40, 0.0, 50, 0.0, 0.5, 0, 0),
    (4, 0.0, 3, 1.0, 3, 1.0, 0.5, 0, 0), (6, 0.1, 4, 1.0, 0, 0.0, 0.5, 0, 0), (2, 0.0, 0, 0.0, 3, 1.0, 0.5, 0, 0), (5, 0.4, 9, 0.6, 2, 1.0, 0.5, 0, 0), (4, 0.0, 7, 0.0, 2, 1.0, 0.5, 0, 0), (8, 0.0, 5, 1.0, 6, 0.0, 0.5, 0, 0), (45, 0.8, 30, 0.0, 4, 1.0, 0.5, 0, 0),
    (9, 0.6, 40, 0.0, 60, 0.0, 0.5, 0, 0), (60, 0.7, 5, 1.0, 70, 0.0, 0.5, 0, 0), (10, 0.0, 3, 1.0, 4, 1.0, 0.5, 0, 0), (3, 0.0, 0, 0.0, 0, 0.0, 0.5, 0, 0), (12, 0.6, 3, 1.0, 2, 1.0, 0.5, 0, 0), (18, 1.0, 40, 0.2, 3, 1.0, 0.5, 0, 0),
)


def train(table=LABELLED, depth: int = 9):
    """A classification tree by Gini impurity: a label, or (feature, threshold, tree where the value is at most that, tree beyond)."""
    data = np.array(table, float)
    x, y = data[:, :-1], data[:, -1]
    label = int(y.mean() >= 0.5)
    if depth == 0 or y.min() == y.max():
        return label
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, t
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-12:
        return label
    _, f, t = best
    low = x[:, f] <= t
    return f, float(t), train(data[low], depth - 1), train(data[~low], depth - 1)


def classify(tree, row) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _hinted(attributes: str, inside_main: bool) -> bool:
    for m in HINT_ATTRIBUTES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = {p.lower() for p in WORDS.findall(name)}
            if not HINTS.isdisjoint(parts - OUTSIDE_ONLY if inside_main else parts) and LAYOUT.isdisjoint(parts):
                return True
    return False


def blocks(page: str) -> list[list]:
    """The page's text blocks in order: text, words, words in links, whether in a main element, whether in boilerplate (inside the innermost
    main element, or anywhere where there is none), and whether that element itself is inside boilerplate."""
    found: list[list] = []
    text: list[str] = []
    linked: list[str] = []
    #: Open elements that aren't inline: name, boilerplate, main, skipped, and what stood in boiler and outer before; the sums are of the whole stack.
    stack: list[tuple[str, bool, bool, bool, int, int]] = []
    boiler = outer = main = skipped = 0
    #: How many elements of a name are open, so that stray end tags cost nothing.
    opened: dict[str, int] = {}
    #: The length of the stack when the open link began, if one is open.
    link = -1
    lower = None
    ends: dict[str, int] = {}

    def flush() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            links = len(html.unescape(" ".join(linked)).split())
            words = joined.count(" ") + 1
            found.append([joined, words, min(links, words), main > 0, boiler > 0, main > 0 and outer > 0])
        text.clear()
        linked.clear()

    def pop() -> None:
        nonlocal boiler, outer, main, skipped, link
        own, _, m, s, boiler, outer = stack.pop()
        opened[own] -= 1
        main, skipped = main - m, skipped - s
        if link > len(stack):
            link = -1

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not skipped:
            text.append(page[at:lt])
            if link >= 0:
                linked.append(page[at:lt])
        if lt >= n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            if re.match(r"</?[A-Za-z]", page[lt : lt + 3]):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                if not skipped:
                    text.append("<")
                at = lt + 1
            continue
        at, closing, name = m.end(), m[1], m[2].lower()
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                lower = lower or page.lower()
                if len(lower) != n:
                    lower = "".join(c.lower() if c.isascii() else c for c in page)
                if ends.get(name, 0) >= 0 and ends.get(name, 0) < at:
                    ends[name] = lower.find(f"</{name}", at)
                at = n if ends[name] < 0 else ends[name]
            continue
        if name == "a":
            if closing:
                link = -1
            elif HREF.search(m[3]):
                link = len(stack)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            continue
        flush()
        if name in VOID or name == "p":
            continue
        if closing:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if m[3].endswith("/") and name not in MAIN:
            continue
        if name in SIBLINGS and stack and stack[-1][0] == name:
            pop()
        frame = name in ("html", "body")
        b = not frame and (name in BOILER or (name == "header" and not main) or _hinted(m[3], main > 0))
        stack.append((name, b, name in MAIN, name in SKIPPED, boiler, outer))
        opened[name] = opened.get(name, 0) + 1
        if name in MAIN:
            #: What was said of ancestors is told apart from what is said of this element and inside it.
            outer, boiler = outer + boiler, int(b)
            main += 1
        else:
            boiler += b
        skipped += name in SKIPPED
    flush()
    return found


def features(own: list[list]) -> list[tuple]:
    """FEATURES of a page's blocks. Boilerplate around main elements tells nothing where it is around all of them."""
    has_main = any(b[3] for b in own)
    told = any(b[3] and not b[4] and not b[5] for b in own)
    density = [b[2] / b[1] for b in own]
    rows = []
    for i, b in enumerate(own):
        before = (own[i - 1][1], density[i - 1]) if i else (0, 0.0)
        after = (own[i + 1][1], density[i + 1]) if i + 1 < len(own) else (0, 0.0)
        inside = 0.5 if not has_main else float(b[3])
        rows.append((b[1], density[i], *before, *after, inside, float(b[4] or (b[5] and told))))
    return rows


def main_text(page: str, tree) -> str:
    """Blocks that the tree takes for the article's, joined by blanks."""
    own = blocks(page)
    return " ".join(b[0] for b, row in zip(own, features(own)) if classify(tree, row))


def extract(pages: DataFrame, table=LABELLED) -> DataFrame:
    """page_id, url, text, n_chars; the labelled table (few rows, by hand) is the only thing that the tree is trained on."""
    tree = train(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p or "", tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(C.table(spark, sf_dir, "pages"))
