"""HTML extraction: paragraphs give points to their ancestors; the best container and its like siblings are the main text."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloft.llm.common import small_batches

# Fixed values of HTML: elements that begin a block, have no content, hold no text for readers, or end an open paragraph or item.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset(
    "script style noscript template textarea title svg math iframe object noembed noframes xmp canvas audio video select datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th figcaption caption h1 h2 h3 h4 h5 h6".split())
IMPLIED_END = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)),
    "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",))
}
# Elements, roles and class words of what is not the article.
ASIDE_TAGS = frozenset("nav aside footer form button dialog menu search fieldset label header".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert disclaimer newsletter subscribe subscription signup login sidebar aside comment comments commentlist disqus respond reply replies discussion menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations popular trending footer header masthead toolbar widget popup modal overlay paywall outbrain taboola skip tags byline".split()
)
# Of these, the words of what is never the article, however much text it has: reader comments, notices and adverts.
NEVER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices disclaimer newsletter comment comments commentlist disqus respond reply replies outbrain taboola".split())
LEAST_APART = 80  # characters of the page that must be elsewhere for an element of NEVER_WORDS to go
MENU_LINK = 25  # characters of a link, on average, below which a list of links is a menu
SAYS_WHETHER = frozenset("has no not with without is show hide".split())  # class has-sidebar tells of a sidebar elsewhere
LOWERED = 0.25  # what the points of text count under an element whose class or id has one of ASIDE_WORDS
KEEP_TAGS = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "out", "doubt", "never", "named", "links", "size", "whole", "runs", "points", "inside")

    def __init__(self, tag: str, parent: Node | None, out: bool, said: frozenset[str] | set[str] = frozenset()):
        self.tag, self.parent, self.out = tag, parent, out
        self.named = named = bool(said)  # class or id has some of ASIDE_WORDS
        self.never = tag not in KEEP_TAGS and not NEVER_WORDS.isdisjoint(said)  # its text is not the article's at any length
        self.doubt = named and tag not in KEEP_TAGS  # its text counts less, and it stays only with many points
        self.children: list[Node | Run] = []
        self.points = 0.0
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.links = self.size = self.whole = self.runs = 0
        if parent is not None:
            parent.children.append(self)


class Run:
    """A run of inline text inside a block."""

    __slots__ = ("raw", "linked", "text", "size")

    def __init__(self):
        self.raw: list[str] = []
        self.linked = 0
        self.text = ""
        self.size = 0


_NOTHING: frozenset[str] = frozenset()


def _aside(tag: str, attributes: str, article: bool) -> tuple[bool, frozenset[str] | set[str]]:
    """Whether an element is a menu, header, footer, sidebar, form or the like by tag or role, or invisible; and the words of its class or id that say so."""
    if tag in ASIDE_TAGS and not (article and tag == "header"):
        return True, _NOTHING
    if not attributes:
        return False, _NOTHING
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in ASIDE_ROLES or name == "hidden" and tag not in ("html", "body") or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _INVISIBLE.search(value):
            return True, _NOTHING
        if name in ("class", "id"):
            for label in value.split():
                found = [w.lower() for w in _WORDS.findall(label)]
                if found and found[0] not in SAYS_WHETHER:
                    words.update(found)
    return False, words & ASIDE_WORDS


def parse(page: str) -> Node:
    """The tree of block elements with their runs of text."""
    root = Node("#root", None, False)
    here, run, link, articles = root, None, 0, 0
    stack: list[tuple[str, Node]] = []  # open elements, and the block that was current before each
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in it each tag is; "" for blocks, so that no end tag looks through it
    at, end = 0, len(page)
    token = _TOKEN.match

    def close(k: int) -> None:
        nonlocal here, run, link, articles
        for tag, before in reversed(stack[k:]):
            places[tag].pop()
            if tag in BLOCKS:
                here, run = before, None
                places[""].pop()
            link -= tag == "a"
            articles -= tag in ("article", "main")
        del stack[k:]

    def push(tag: str) -> None:
        places[tag].append(len(stack))
        if tag in BLOCKS:
            places[""].append(len(stack))
        stack.append((tag, here))

    def last(*tags: str) -> int:
        """The innermost open element of these tags, -1 if there is none."""
        return max(places[t][-1] if places[t] else -1 for t in tags)

    while at < end:
        m = token(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            if run is None:
                if piece.isspace():
                    continue
                run = Run()
                here.children.append(run)
            run.raw.append(piece)
            if link:
                run.linked += len(piece.strip())
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "br" and run is not None:
                run.raw.append(" ")
            k = last(tag)
            if k >= 0 and (tag in BLOCKS or k > last("table", "article", "main", "body")):
                close(k)
            elif k < 0 and tag in BLOCKS:
                run = None
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "title"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in BLOCKS:
            if (k := last("p")) >= 0 and k == last(""):  # a block ends an open paragraph and what is open in it
                close(k)
            if tag in IMPLIED_END:
                ended, scope = IMPLIED_END[tag]
                if (k := last(*ended.split())) > last(*scope):
                    close(k)
            run = None
            if tag in VOID:
                continue
            push(tag)
            articles += tag in ("article", "main")
            out, named = _aside(tag, attributes, articles > 0)
            here = Node(tag, here, here.out or out, named)
        elif tag in VOID:
            if tag == "br" and run is not None:
                run.raw.append(" ")
        elif not attributes.endswith("/"):
            out, named = _aside(tag, attributes, articles > 0)
            if out or named and here.tag not in PARAGRAPHS:  # an inline element that may be no part of the article
                push("div")
                here, run = Node(tag, here, here.out or out, named), None
            else:
                push(tag)
                link += tag == "a"
    return root


def _measure(node: Node) -> None:
    """Text and link sizes of every element, bottom up; the explicit stack takes trees of any depth.

    An element that holds an article, or most of the page's text and is not beside an article, is not in doubt. The sizes of one that is are no part of its parent's.
    """
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if isinstance(c, Node) and not c.out]
    for x in reversed(order):
        for c in x.children:
            if isinstance(c, Run):
                raw = "".join(c.raw)
                c.text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
                c.size = len(c.text)
                x.whole += c.size
                x.runs += c.size > 0
            elif not c.out:
                x.whole += c.whole
                x.runs += c.runs
    articles = [x for x in order if x.tag in ("article", "main") and x.whole and not x.named]
    holding: set[int] = set()
    for x in articles:
        up = x.parent
        while up is not None and id(up) not in holding:
            holding.add(id(up))
            up.doubt = up.never = False
            up = up.parent
    for x in order:
        x.never = x.never and node.whole - x.whole >= LEAST_APART
        if x.doubt and not x.never and x.whole * 2 > node.whole:
            x.doubt = bool(articles) and not x.inside  # the article is elsewhere
    for x in reversed(order):
        for c in x.children:
            if isinstance(c, Run):
                x.size += c.size
                x.links += min(c.linked, c.size)
            elif not c.out and not c.doubt:
                x.size += c.size
                x.links += c.links


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _score(node: Node) -> list[Node]:
    """Gives each paragraph's points to its ancestors: all to the container, half to the next, then a third and so on."""
    order, todo = [], [(node, 1.0)]
    while todo:
        x, weight = todo.pop()
        weight = 0.0 if x.never or not weight else LOWERED if x.doubt else weight
        order.append((x, weight))
        todo += [(c, weight) for c in reversed(x.children) if isinstance(c, Node) and not c.out]
    for x, weight in order:
        for c in x.children:
            if not isinstance(c, Run) or not c.size:
                continue
            text, size = c.text, c.size
            points = (1 + text.count(",") + text.count("、") + text.count("，") + min(size / 100, 3)) * (1 - min(c.linked, size) / size) * weight
            to = x.parent if x.tag in PARAGRAPHS and x.parent is not None else x
            share = 1
            while to is not None and share <= 6:
                to.points += points / share
                to, share = to.parent, share + 1
    return [x for x, _ in order]


def _menu(node: Node) -> bool:
    """Whether an element is a list of links: in the article only if they are short, as its references are not."""
    if node.tag not in ("ul", "ol", "div", "table", "section", "dl") or _density(node) <= 0.6:
        return False
    return not node.inside or node.links < MENU_LINK * node.runs


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, white space made single, joined by one space. Empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    _measure(root)
    order = _score(root)
    best = max(order, key=lambda x: (x.points * (1 - _density(x)), x.size), default=None)
    if best is None or not root.whole:
        return ""
    up = best
    while up is not None:
        up.doubt = up.never = False
        up = up.parent
    article = best
    while article is not None and article.tag not in ("article", "main"):
        article = article.parent
    top = best.points * (1 - _density(best))

    def like(x: Node) -> bool:
        return x.points * (1 - _density(x)) >= max(3.0, 0.2 * top) and _density(x) < 0.5

    if article is not None:
        beside = article.parent.children if article.parent is not None else [article]
        kept = [c for c in beside if c is article or isinstance(c, Node) and not c.out and like(c)]
    elif best.parent is None:
        kept = [best]
    else:
        kept = []
        for c in best.parent.children:
            if isinstance(c, Run):
                if c.size >= 80 and c.linked < 0.25 * c.size:
                    kept.append(c)
            elif c is best or not c.out and (like(c) or c.tag in HEADINGS or c.tag in PARAGRAPHS and c.size and _density(c) < 0.25):
                kept.append(c)
    out: list[str] = []
    todo: list[Node | Run] = kept[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, Run):
            if x.size:
                out.append(x.text)
        elif not x.out and not x.never and (like(x) or not x.doubt) and not _menu(x):
            todo += x.children[::-1]
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html, ...).

    Works on whole pages, one row in and one row out. A null, empty or textless html gives an empty text; repeated rows give
    repeated rows; broken markup is read as far as it goes.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"]
            )

    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
