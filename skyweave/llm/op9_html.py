"""HTML extraction: flat text blocks, neighbour features and a decision tree.

A page is cut into flat text blocks at block-level tags. Each block has its word count and link
density, those of its neighbours before and after, and where it stands: inside an article or
main element, inside elements that are boilerplate by their tag, inside elements whose class, id
or role names boilerplate (a strong or a weak name), in a heading, in a header that is no article's own. Names are compared as whole
tokens: of ``share-price`` neither half counts. A binary decision tree (Gini splits), trained
once per process on the small labelled table of ``labelled_pages``, keeps or drops each block;
half of those pages are held out and only test it. Kept blocks are joined by line ends in page
order, white space inside a block becoming one space. Scripts, styles, templates, comments and
hidden elements never become blocks.

Defined results: a null or empty page, and one without kept blocks, has the empty text; omitted
tags are implied as HTML has it; broken markup is read as far as it goes (an unclosed tag at the
end is dropped); repeated rows repeat.
``extract_pages`` keeps all columns and adds one, with underscores where its name is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import fresh, table

# Fixed values of HTML: elements that start a new block, hold no text, or never close.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
SILENT_TAGS = frozenset("head script style template noscript iframe object svg math canvas audio video select textarea button title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Fixed values of HTML parsing: what may stand in a head, which start tags end an open paragraph,
# beyond which elements an end tag or an implied end doesn't reach, inline elements whose end tags
# leave blocks inside them open, and HTML elements that end an open drawing or formula.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SCOPE = frozenset("caption html marquee object table td template th".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: For a start tag the open elements that it ends, and those that the search for them doesn't pass.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "select": (("select",), ("table",)), "input": (("select",), ("table",)), "textarea": (("select",), ("table",)), "button": (("button",), ("table",)),
}
#: Elements whose class, id or role can name boilerplate.
MARKED_TAGS = frozenset("article aside body blockquote dialog div dl fieldset figure footer form header main menu nav ol section table td tr ul".split()) | SILENT_TAGS
BOILER_TAGS = frozenset("nav footer aside menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of class and id that mark boilerplate wherever they stand, and roles that do.
STRONG = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr nav navbar navigation newsletter pagination pager recommended related replies respond sidebar signup sponsored subscribe".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar".split())
#: Names that do so only if the block looks like it.
WEAK = frozenset("adv alert author banner byline discussion header legal login masthead menu meta modal notice notices popup promo promoted promotion reply search share sharing skip social sponsor tags toolbar topbar widget widgets".split())
#: A compound name counts as its last part (``site-footer``), or as its first if the last is one of
#: these (``comment-list``). A header counts as one of the site only under these first parts.
BOXES = frozenset("area articles bar block bottom box container content inner item items left links list notice posts right section slot stories text top unit wrap wrapper".split())
SITE_PARTS = frozenset("global page site top".split())
_PARTS = re.compile(r"[-_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_boiler", "in_header", "heading", "strong", "weak")


def _marks(tag: str, own: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element's class, id or role is a strong or a weak name of boilerplate."""
    if tag in ("body", "html"):
        return False, False
    strong, weak = own.get("role", "").lower() in ROLES, tag == "form"
    for token in f"{own.get('class', '')} {own.get('id', '')}".lower().split():
        first, *rest = (x for x in _PARTS.split(token) if x) if token.strip("-_") else ("",)
        if not rest:
            strong, weak = strong or first in STRONG, weak or first in WEAK
        elif rest[-1] == "header":
            strong = strong or first in SITE_PARTS
        else:
            strong = strong or rest[-1] in STRONG or (first in STRONG and rest[-1] in BOXES)
            weak = weak or rest[-1] in WEAK or (first in WEAK and rest[-1] in BOXES)
    return strong, weak


class _Blocks(HTMLParser):
    """Flat blocks of a page: [text, words, words in links, in_main, in_boiler, in_header, heading,
    strong, weak].

    Every open element is kept, so that end tags pair up; those that HTML lets a page omit are
    implied: a head ends at the first thing that can't stand in it, a paragraph at the next block,
    items, cells and rows at their like."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []  # tag, the state outside, what the element adds to it
        self.state = (0, 0, 0, 0, 0, 0)  # silent, main, boiler, header, strong, weak
        self.blocks: list[list] = []
        self.text: list[str] = []
        self.linked = 0
        self.in_link = self.heading = False

    def flush(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                _, main, boiler, header, strong, weak = self.state
                self.blocks.append([" ".join(words), len(words), min(self.linked, len(words)), main > 0, boiler > 0, header > 0, self.heading, strong > 0, weak > 0])
            self.text = []
        self.linked = 0

    @staticmethod
    def within(outside: tuple, own: tuple) -> tuple:
        """The state inside an element that adds ``own`` to the state outside."""
        silent, main, boiler, header, strong, weak = outside
        adds, is_main, is_boiler, is_header, is_strong, is_weak = own
        if is_main:
            # the page's own text inside an unclosed menu or a page-wide form; but an article
            # inside the comments is no main text
            return (silent + adds, main + 1, 0, header, strong, 0)
        return (silent + adds, main, boiler + is_boiler, header + (is_header and not main), strong + is_strong, weak + is_weak)

    def to(self, k: int) -> None:
        """Close the open elements from place ``k`` on."""
        if self.open[k][1] != self.state:
            self.flush()
            self.state = self.open[k][1]
        del self.open[k:]

    def find(self, tags, stops) -> int | None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                return k
            if self.open[k][0] in stops:
                return None
        return None

    def imply(self, tag: str) -> None:
        """Close what a start tag ends."""
        top = self.open[-1][0] if self.open else ""
        if tag == "body" and (k := self.find(("head",), ())) is not None or top == "head" and tag not in HEAD_TAGS and (k := len(self.open) - 1) is not None:
            self.to(k)
        if tag in BREAKOUT and (k := self.find(("svg", "math"), ("foreignobject", "desc", "title", "annotation-xml"))) is not None:
            self.to(k)
        if tag in ENDS_P and (k := self.find(("p",), SCOPE | SILENT_TAGS)) is not None:
            self.to(k)
        if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.to(len(self.open) - 1)
        if tag in IMPLIED:
            tags, stops = IMPLIED[tag]
            if (k := self.find(tags, (*stops, "template"))) is not None:
                self.to(k)

    def handle_starttag(self, tag, attrs):
        self.imply(tag)
        if tag in BLOCK_TAGS:
            self.flush()
            self.heading = tag in HEADINGS
            self.in_link = False
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.in_link = True
        if tag in VOID_TAGS or tag in ("html", "body", "form") and self.find((tag,), ("template",)) is not None:
            return
        own = {k: v or "" for k, v in attrs}
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or bool(_HIDDEN.search(own.get("style", "")))
        is_main = tag in MAIN_TAGS or own.get("role") == "main"
        marks = _marks(tag, own) if tag in MARKED_TAGS and not is_main else (False, False)
        adds = (int(tag in SILENT_TAGS or hidden), is_main, tag in BOILER_TAGS, tag == "header", *marks)
        inside = self.within(self.state, adds)
        if inside != self.state:
            self.flush()
        self.open.append((tag, self.state, adds))
        self.state = inside

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
            self.heading = False
        elif tag == "a":
            self.in_link = False
        if tag in ("html", "body"):
            return  # what follows still belongs to the body
        if tag in FORMATTING:
            k = self.find((tag,), SCOPE)
            if k is not None and any(e[0] in BLOCK_TAGS for e in self.open[k + 1 :]):
                # blocks inside stay open, without it
                self.flush()
                outside, later = self.open[k][1], self.open[k + 1 :]
                del self.open[k:]
                for name, _, own in later:
                    self.open.append((name, outside, own))
                    outside = self.within(outside, own)
                self.state = outside
                return
        elif tag in BLOCK_TAGS or tag in SILENT_TAGS:
            table = tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption")
            k = self.find((tag,), ("table", "template") if table else ("ul", "ol", *SCOPE) if tag == "li" else SCOPE)
        else:
            k = self.find((tag,), BLOCK_TAGS)
        if k is not None:
            self.to(k)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.to(len(self.open) - 1)
        if self.state[0]:
            return
        self.text.append(data)
        if self.in_link:
            self.linked += len(data.split())


def blocks(html: str | None) -> tuple[list[str], np.ndarray]:
    """Texts of the flat blocks and their feature rows (in the order of FEATURES)."""
    parser = _Blocks()
    text = html or ""
    if text:
        parser.feed(text)
        parser.close()
        parser.flush()
    found = parser.blocks
    if not found:
        return [], np.zeros((0, len(FEATURES)))
    words = np.array([b[1] for b in found], dtype=float)
    links = np.array([b[2] for b in found], dtype=float) / words
    flags = np.array([b[3:] for b in found], dtype=float)
    before = lambda x: np.concatenate(([0.0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0.0]))
    return [b[0] for b in found], np.column_stack((words, links, before(words), before(links), after(words), after(links), flags))


class Tree:
    """A binary classification tree with Gini splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2):
        self.nodes: list[tuple] = []  # feature, cut, below, above | None, label
        self.least = least
        self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append((None, bool(2 * y.sum() > len(y))))
        best, impurity = None, len(y) * y.mean() * (1 - y.mean()) - 1e-12
        if depth and impurity > 0:
            for f in reversed(range(x.shape[1])):  # flags first, so they win ties
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, f] <= cut
                    if min(low.sum(), (~low).sum()) < self.least:
                        continue
                    cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                    if cost < impurity:
                        best, impurity = (f, float(cut), low), cost
        if best:
            f, cut, low = best
            self.nodes[me] = (f, cut, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)

        def walk(node: int, rows: np.ndarray) -> None:
            what = self.nodes[node]
            if what[0] is None:
                out[rows] = what[1]
                return
            low = x[rows, what[0]] <= what[1]
            if low.any():
                walk(what[2], rows[low])
            if not low.all():
                walk(what[3], rows[~low])

        walk(0, np.arange(len(x)))
        return out


def _words(n: int) -> str:
    return ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * (n // 20 + 1)).rsplit(" ", 20 - n % 20 + 1)[0] if n else ""


def labelled_pages() -> list[str]:
    """The labelled table: small pages whose main-text blocks begin with "+".

    Each page is a top, a body in a frame, and a bottom; the first half trains the tree, the other
    half is held out."""
    w = _words
    tops = (
        "", f"<nav><ul><li><a href=x>Home</a></li><li><a href=x>{w(3)}</a></li></ul></nav>", "<div class=menu><a href=x>One</a> <a href=x>Two</a></div><div class=ad>Buy this thing now.</div>",
        "<header><p>Site name</p><p>The slogan of the site</p></header>", "<div class=site-header><h1>Site name</h1></div>", "<div><a href=x>Home</a> | <a href=x>About us</a></div><div>Log in</div>",
        f"<ul><li><a href=x>Politics</a></li><li><a href=x>{w(2)}</a></li></ul>", f"<div class=cookie-notice><p>{w(30)}</p></div>", f"<div id=sidebar><h3>News</h3><p>{w(45)}</p></div>",
        f"<header><h1>Site name</h1><div>{w(9)}</div></header><nav><a href=x>Start</a></nav>", f"<div class='ad'>{w(12)}</div>", f"<form><p>{w(5)}</p></form><a href=x>Skip to content</a>",
    )
    bottoms = (
        "", f"<footer><p>&copy; {w(25)}</p></footer>", f"<div class=comments><h3>Comments</h3><p>{w(40)}</p><p>Nice one.</p></div><div id=footer>(c) Site</div>", "<div><a href=x>Contact</a> <a href=x>Privacy</a></div><div>Contact us</div>",
        f"<div class=related-posts><h3>More stories</h3><ul><li><a href=x>{w(6)}</a></li></ul></div>", "<div><a href=x>Next page</a></div>", f"<div class=newsletter><p>Sign up for {w(14)}</p></div><footer>(c)</footer>",
        f"<section class=comments><article><p>{w(70)}</p></article><article><p>{w(4)}</p></article></section>", f"<aside><p>{w(33)}</p></aside><div class='widget'><a href=x>{w(4)}</a></div>",
    )
    bodies = (
        f"<h1>+Title of it</h1><p>+{w(22)}</p><p>+Short.</p><p>+{w(64)}</p>", f"<header><h1>+{w(8)}</h1></header><p>+{w(50)}</p><blockquote>+{w(21)}</blockquote><p>+Be.</p><p>+{w(150)}</p>",
        f"<p>+{w(44)}</p><ul><li>+{w(3)}</li><li>+second <a href=x>point</a></li></ul><p>+{w(31)}</p>", f"<h1>+{w(4)}</h1><p>+{w(20)} <a href=x>{w(9)}</a></p><p>+{w(36)}</p>",
        f"<p>+{w(60)}</p><aside><p>{w(28)}</p></aside><p>+{w(52)}</p>", f"<p>+{w(33)}</p><div class=ad>{w(16)}</div><p>+{w(35)}</p>", f"<h2>+{w(5)}</h2><p>+{w(41)}</p><div class=share><a href=x>Tweet</a> <a href=x>Mail</a></div>",
        f"<p>+{w(38)}</p><div class='social-policy tags'><p>+{w(42)}</p></div><p>+{w(29)}</p>", f"<div class=story-header><h1>+{w(7)}</h1></div><div class=share-price><p>+{w(40)}</p></div><p>+{w(26)}</p>", f"<p>+{w(300)}</p><p>+{w(12)}</p><p>+{w(700)}</p>",
        f"<table><tr><td>+cell one of many</td><td>+{w(24)}</td></tr></table><p>+{w(47)}</p>", f"<h1>+{w(6)}</h1><p>+{w(90)}</p><form><p>Give us your address please</p></form><p>+{w(30)}</p>", f"<p>+{w(26)}</p><div class=related><h3>Related</h3><p>{w(34)}</p></div><p>+{w(48)}</p>",
        f"<h1>+Only</h1><p>+{w(57)}</p><div class=tags><a href=x>{w(1)}</a> <a href=x>{w(2)}</a></div><footer><p>{w(10)}</p></footer>", f"<header class=article-header><h1>+{w(9)}</h1></header><p>+{w(80)}</p>",
    )
    small = ("<p>+Hm.</p>", f"<h1>+{w(5)}</h1><p>+{w(6)}</p>", f"<p>+word</p><p>+<a href=x>{w(5)}</a></p><p>+word word</p>", f"<h2>+<a href=x>{w(4)}</a></h2><p>+{w(3)}</p><p>+{w(11)}</p>", f"<h1>+{w(10)}</h1>")
    frames = ("<article>%s</article>", "<main>%s</main>", "<div id=content>%s</div>", "<div class=post-body>%s</div>", "%s", "<div role=main>%s</div>", "<form id=page><div>%s</div></form>")
    pages = []
    around = len(tops) * len(bottoms)  # each top meets each bottom once in every turn
    for k in range(8 * around):
        frame = frames[(5 * k + k // 9) % len(frames)]
        own = small if k % 5 == 4 and any(x in frame for x in ("article", "main")) else bodies
        body = own[(7 * k + k // 11) % len(own)]
        if "article" in frame or "main" in frame:  # there short paragraphs are text wherever they stand
            short = f"<p>+{w(1 + k % 5)}</p>"
            body = (body + short, short + body, body.replace("</p><p>", f"</p>{short}{short}<p>", 1), body)[k // 13 % 4]
        pages.append(f"<body>{tops[k % len(tops)]}{frame % body}{bottoms[k // len(tops) % len(bottoms)]}</body>")
    return [page for first in range(0, 2 * around, around) for turn in range(first, len(pages), 2 * around) for page in pages[turn : turn + around]]


def labelled_table(held_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the blocks of the training pages, or of those held out."""
    rows, labels = [], []
    pages = labelled_pages()
    for page in pages[len(pages) // 2 :] if held_out else pages[: len(pages) // 2]:
        texts, x = blocks(page)
        rows.append(x)
        labels.append(np.array([t.startswith("+") for t in texts], dtype=float))
    return np.concatenate(rows), np.concatenate(labels)


_TREE: list[Tree] = []


def tree() -> Tree:
    if not _TREE:
        _TREE.append(Tree(*labelled_table()))
    return _TREE[0]


def extract(html: str | None) -> str:
    texts, x = blocks(html)
    if not texts:
        return ""
    return "\n".join(t for t, keep in zip(texts, tree().predict(x)) if keep)


def extract_udf():
    @F.pandas_udf("string")
    def main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for page in pages:
            yield page.map(extract, na_action=None)

    return main_text


def extract_pages(pages: DataFrame, column: str = "_text") -> DataFrame:
    """``pages`` with all their columns and the main text of ``html`` as the last one."""
    return pages.withColumn(fresh(pages, column), extract_udf()(F.col("html")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("_text").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
