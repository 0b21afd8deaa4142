"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once, tag by tag, into flat blocks: the text between two block-level tags. A block has the words and link
density of itself and of its neighbours, whether it lies in an article and is a heading, and what its elements are called:
the share of boilerplate words (menu, footer, advert, ...) among the words of a class, id or role, where that share is highest,
and whether that element is the block's own. For boilerplate elements and names alike it has the share of the page's words
that the element holds (none if an article stands outside it), as one that holds most of a page is a frame and not boilerplate. A decision tree, grown by Gini impurity on
the blocks of the labelled pages below, keeps or drops each block; tests hold other labelled pages out.

A page is read in a time that grows with its length: a tag is looked for once, whatever quotes or tags never close.

Defined results: a null or empty page, and a page of boilerplate only, give the empty text; scripts, styles, comments and
other unseen elements are no text; an element that is never closed ends with its parent; a tag that no ">" follows is
text; repeated rows are extracted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "heading", "boiler", "boiler_share", "name", "name_share", "name_own")

#: The labelled pages: +n stands for n words of main text, -n for n words that are none.
LABELLED = (
    # articles in an article element, with menus, adverts, footers
    "<title>-6</title><nav><ul><li><a>-1</a></li><li><a>-2</a></li><li><a>-1</a></li></ul></nav><div class=ad>-9</div><article><h1>+8</h1><p>+60</p><p>+2</p><p>+130</p><p>+1</p></article><footer>-12</footer>",
    "<nav><a>-1</a><a>-1</a></nav><article><h1>+1</h1><p>+3</p></article><footer>-8</footer>",
    "<article><p>+4</p></article><footer>-40</footer>",
    "<div class='advert'>-35</div><article><p>+400</p></article>",
    "<header><a>-2</a><p>-7</p></header><article><h1>+9</h1><div class='share-bar'><a>-1</a><a>-1</a></div><p>+45</p><div class='ad-slot'><p>-14</p></div><p>+38</p><ul><li>+5</li><li>+3</li><li>+12</li></ul><p>+25</p><aside><p>-40</p></aside></article><section id=comments><p>-30</p><p>-85</p><p>-4</p></section>",
    "<main><h1>+6</h1><p>+80 <a>+6</a></p><h2>+3</h2><p>+55</p><section class='comments'><h3>-2</h3><div><p>-60</p></div><div><p>-15</p></div></section></main><footer><ul><li><a>-2</a></li><li><a>-1</a></li></ul><p>-10</p></footer>",
    "<article><h2>+5</h2><p>+20</p><p><a>+4</a></p><p>+33</p><p><a>+9</a></p><p>+41</p><form><label>-2</label><p>-16</p></form></article>",
    "<article><p>+50</p><p><a>-30</a></p><p>+44</p><p><a>-24</a></p><p>+28</p><p><a>-45</a></p><p>+35</p></article>",
    "<article><p>+70</p><p>+52</p><h3>-2</h3><ul><li><a>-7</a></li><li><a>-9</a></li><li><a>-6</a></li><li><a>-11</a></li></ul></article>",
    "<article><p>+31</p><h4>-3</h4><ul><li><a>-10</a></li><li><a>-8</a></li><li><a>-12</a></li></ul></article><footer>-6</footer>",
    "<article><h1>+7</h1><p class='social-policy'>+48</p><p id='comment-on-kant'>+62</p><p class='notice-period'>+30</p><p class='advert'>-20</p><p>+37</p><p class='ad'>-11</p><p>+26</p></article>",
    "<article class='post with-comments'><p>+30</p><p>+14 <a>+2</a></p><blockquote><p>+18</p></blockquote><p>+6</p><footer><p>-9</p></footer></article>",
    "<article><h2>+4</h2><table><tr><td>+1</td><td>+2</td></tr><tr><td>+3</td><td>+1</td></tr></table><p>+12</p><div class='newsletter signup'><p>-22</p></div><p>+17</p></article><div class='cookie-notice'><p>-28</p><a>-1</a></div>",
    "<div class='cookie-consent'><p>-90</p></div><article><p>+3</p><p>+2</p></article><div class='related-posts'><a>-8</a><p>-30</p></div>",
    "<article><header><h1>-6</h1><p>-12</p></header><p>+66</p><nav><a>-1</a><a>-1</a></nav><p>+9</p><menu><li>-3</li></menu><p>+11</p></article>",
    "<article><p>+3 <a>+2</a> +1</p><p><a>+3</a> +4</p><p>+5</p><p><a>+2</a></p><p>+40</p></article>",
    # no article element
    "<div id=menu><a>-1</a></div><div><h2>+1</h2><p>+25</p><p>+40</p><p>+26</p></div><div class=footer><p>-25</p></div>",
    "<ul><li><a>-1</a></li><li><a>-2</a></li><li><a>-2</a></li></ul><h1>+6</h1><p>+75</p><p>+42</p><h3>+4</h3><p>+18</p><p>+90</p><p>-6</p>",
    "<div class='product-header-wrap'><h1>+5</h1><p>+85</p><p>+60</p><p>+33</p></div><div class='site-footer'><p>-20</p></div>",
    "<body class='no-sidebar'><div class=content><h1>+5</h1><p>+33</p><p>+48</p><p>+6</p><p>+52</p></div><div class=sidebar><h3>-2</h3><p>-24</p><ul><li><a>-3</a></li><li><a>-2</a></li></ul></div>",
    "<form id=aspnetForm><ul><li><a>-1</a></li><li><a>-2</a></li></ul><h1>+6</h1><p>+95</p><p>+70</p><p>+58</p><div><a>-1</a><a>-2</a></div></form>",
    "<form><p>-14</p><p>-6</p></form><p>+65</p><p>+38</p><div class='header banner'><p>-30</p></div>",
    "<div class='content with-comments'><p>+80</p><p>+64</p><p>+22</p></div><div class='comment-list'><p>-55</p><p>-18</p><p>-70</p></div><p>-4</p>",
    "<table><tr><td><a>-1</a></td><td><a>-2</a></td><td><a>-1</a></td></tr></table><table><tr><td>+120</td></tr><tr><td>+66</td></tr></table><center>-5</center>",
    "<div id=content><h1>+2</h1><p>+40 <a>+5</a> +20 <a>+3</a></p><div class=toc><ul><li><a>-2</a></li><li><a>-3</a></li></ul></div><h2>+2</h2><p>+50 <a>+10</a></p><p>+22 <a>+8</a></p><ul><li><a>-2</a></li><li><a>-3</a></li><li><a>-2</a></li></ul></div><div id=footer><p>-35</p></div>",
    "<div><h1>+4</h1><p>+28</p><h2>+1</h2><ul><li>+6</li><li>+7</li><li>+6</li><li>+8</li></ul><h2>+1</h2><p>+60</p><p>+44</p></div><div><a>-2</a><a>-1</a><a>-2</a></div><p>-8</p>",
    "<ul><li><a>-2</a></li><li><a>-3</a></li><li><a>-8</a></li></ul><p><a>-12</a></p><p>-3</p><p><a>-30</a></p><div><a>-4</a></div><p>-9</p>",
    "<div class='modal overlay'><p>-80</p><p>-30</p></div><div><p>+58</p><p>+34</p></div><div class='social share'><a>-1</a><a>-1</a></div>",
    "<div class=masthead><p>-12</p></div><p>+90</p><div class='sponsored'><p>-50</p></div><p>+45</p><p><a>-6</a></p><p><a>-9</a></p>",
    "<div class='main-header'><p>-4</p></div><div class=text><p>+19</p><p>+30</p><p>+16</p><p>+24</p></div><div class='page-footer'><p>-16</p><p>-22</p></div>",
    "<p>-2</p><p>-3</p><h2>-2</h2><p>-4</p><p><a>-2</a></p>",
    "<div><p class='comment'>-44</p><p class='reply'>-20</p></div><p>+72</p><p class='copyright'>-9</p><p class='tag-search-theory'>+39</p>",
    # short blocks at the beginning, the end and beside links of an article
    "<nav><a>-1</a></nav><article><p>+40</p><p>+1</p></article>",
    "<article><h1>+3</h1><p>+2</p></article>",
    "<article><p>+1</p></article>",
    "<article><p>+8</p><p>+2</p><p>+3</p></article><div class='links'><a>-3</a></div>",
    "<article><h2>+2</h2><p>+1</p><p>+5</p><p>+9</p></article><ul><li><a>-2</a></li><li><a>-4</a></li></ul>",
    "<ul><li><a>-3</a></li></ul><article><p>+6</p><p>+2</p><p>+7</p><h3>+1</h3><p>+4</p></article>",
    "<main><p>+4</p><ul><li>+1</li><li>+2</li><li>+1</li></ul><p>+3</p></main><p><a>-5</a></p>",
    "<article><p>+3</p><p>+4 <a>+1</a></p><p>+2 <a>+2</a></p><p>+6</p></article><a>-2</a>",
    "<article><p>+90</p><p>+3</p><div class='promo'><p>-8</p></div><p>+2</p></article>",
    "<article><h1>+5</h1><p>+12</p><section class='reader-comments'><p>-3</p><p>-40</p><p>-9</p></section></article>",
    "<article><p>+30</p><p>+8</p><p><a>+3</a></p><p>+4</p><p><a>+5</a></p><p>+50</p></article>",
    "<article><p>+20</p><p><a>+2</a></p><p>+25</p><p><a>+1</a></p><p>+31</p><p><a>+4</a></p><p>+18</p></article>",
    # elements that frame a whole page, and the same elements as boilerplate
    "<form><div><a>-1</a><a>-1</a></div><h1>+4</h1><p>+70</p><p>+85</p><p>+12</p></form>",
    "<form id=main method=post><p>+55</p><p>+61</p><p>+47</p></form><p>-3</p>",
    "<form action=x><h2>+3</h2><p>+90</p><p>+33</p></form><div>-4</div>",
    "<header><p>+60</p><p>+75</p><p>+82</p></header><footer><p>-14</p></footer>",
    "<form><p>-12</p><label>-3</label></form><p>+80</p><p>+44</p><header><p>-22</p></header>",
    "<aside><p>-62</p></aside><p>+70</p><p>+65</p><p>+29</p><footer><p>-48</p><p>-20</p></footer>",
    "<div class='wide banner box'><p>+44</p><p>+90</p><p>+75</p><p>+20</p></div><p>-5</p>",
    "<div class='text after teaser'><p>+150</p><p>+64</p><p>+71</p></div><div class='sidebar'><p>-40</p></div>",
    "<div class='page-with-long-search'><h2>+2</h2><p>+66</p><p>+58</p></div><div class='menu'><p>-6</p></div>",
    "<div class='no-header'><h1>+5</h1><p>+77</p><p>+61</p><p>+83</p></div><div class='header'><p>-7</p></div>",
    "<div class='widget'><p>-30</p><p>-52</p></div><p>+64</p><p>+77</p><div class='toolbar'>-4</div><p>+40</p>",
    "<div class='comments'><p>-48</p><p>-61</p><p>-22</p></div><div><p>+52</p><p>+71</p><p>+40</p></div>",
    "<div class='page-header-outer'><h1>+3</h1><p>+58</p><p>+90</p><p>+7</p></div><p>-4</p>",
    # comments that outgrow what they are about
    "<div><p>+40</p></div><div class='comments'><p>-90</p><p>-120</p><p>-64</p><p>-88</p></div>",
    "<div><p>+32</p></div><div id='comments'><p>-70</p><p>-84</p><p>-150</p><p>-9</p></div>",
    "<article><p>+6</p><p>+14</p></article><div class='reader-comment-list-box'><p>-60</p><p>-71</p><p>-45</p></div>",
    "<article><h1>+2</h1><p>+9</p></article><div class='blog-comment-area'><p>-90</p><p>-51</p><p>-75</p></div><footer>-4</footer>",
    "<article><p>+5</p></article><form><p>-80</p><p>-66</p></form>",
    "<article><p>+8</p></article><footer><p>-90</p><p>-45</p></footer>",
    "<p>+35</p><p>+28</p><div class='comment-list'><p>-95</p><p>-80</p><p>-140</p><p>-110</p></div>",
    "<article><p>+44</p><p>+3</p></article><div class='see-also-related'><p>-12</p><p>-30</p></div><div class='our-weekly-newsletter'><p>-18</p></div>",
    "<article><p>+28</p><div class='box-for-sponsor'><p>-25</p><p>-6</p></div><p>+31</p></article>",
    "<p>+62</p><p>+40</p><div class='lower-page-footer'><p>-33</p><p>-12</p></div><div class='box-share-buttons'><p>-5</p></div>",
    # pages of boilerplate only
    "<nav><a>-2</a><a>-1</a></nav><footer><p>-20</p></footer>",
    "<div class='login'><p>-12</p><p>-4</p></div><div class='footer'>-16</div>",
    "<div class='cookie'><p>-30</p></div><ul><li><a>-3</a></li><li><a>-2</a></li></ul>",
    "<header><h1>-3</h1><p>-25</p></header><div><p>+110</p><p>+30 <a>+3</a></p></div><aside><p>-45</p><p>-33</p></aside><footer><p>-50</p></footer>",
)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("aside button dialog fieldset footer form header label legend menu nav optgroup option search select".split())
#: Elements whose text is never shown, or only by scripts.
UNSEEN = frozenset("applet audio canvas embed head iframe math noembed noframes noscript object script style svg template textarea title video".split())
#: Of these, those in which no other tag is a tag.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Of these, those that a slash before the end of their tag closes.
SELF_CLOSING = frozenset("math svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that name boilerplate.
BOILER_NAMES = frozenset(
    "ad ads advert advertisement advertising advertorial banner breadcrumb breadcrumbs comment commentary comments complementary consent contentinfo cookie cookies "
    "copyright disclaimer disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation navigationbar newsletter notice notices outbrain overlay paging pagination "
    "popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription taboola tagcloud teaser toc toolbar tooltip topbar widget".split()
)

#: Attributes: a quote opens a value only behind "=". No ">" at the end: none follows outside quotes.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?P<mark>>?)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>?)", re.S)
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?P<mark>>?)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(>?)", re.S)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*")
#: Words that take back the name behind them (no-sidebar, with-comments).
_TAKES_BACK = frozenset("has no non sans with without".split())
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass(frozen=True)
class Node:
    """An inner node (feature < limit goes left) or a leaf."""

    keep: bool
    feature: int = -1
    limit: float = 0.0
    left: Node | None = None
    right: Node | None = None


def grow(rows: tuple[tuple[float, ...], ...], depth: int = 10, least: int = 2) -> Node:
    """A decision tree by Gini impurity; the last value of a row is its label. Ties go to the earlier feature and lower limit.

    A side of a split has `least` rows at least.
    """
    ones = sum(r[-1] for r in rows)
    leaf = Node(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return leaf
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            limit = (low + high) / 2
            left, right = [r[-1] for r in rows if r[f] < limit], [r[-1] for r in rows if r[f] >= limit]
            if min(len(left), len(right)) < least:
                continue
            cost = sum(2 * sum(s) * (len(s) - sum(s)) / len(s) for s in (left, right))
            if best is None or (cost, f, limit) < best:
                best = (cost, f, limit)
    if best is None:
        return leaf
    _, f, limit = best
    return Node(leaf.keep, f, limit, grow(tuple(r for r in rows if r[f] < limit), depth - 1, least), grow(tuple(r for r in rows if r[f] >= limit), depth - 1, least))


def labelled_rows(pages: tuple[str, ...] = LABELLED) -> list[tuple[float, ...]]:
    """The features and label of each block of labelled pages."""
    rows = []
    for page in pages:
        said = re.sub(r"([+-])(\d+)", lambda m: " ".join(["yes" if m[1] == "+" else "no"] * int(m[2])), page)
        found = blocks(said)
        rows += [(*own, int("yes" in block[0].split())) for own, block in zip(features(found), found, strict=True)]
    return rows


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(tuple(labelled_rows()))


def classify(node: Node, features: tuple[float, ...]) -> bool:
    while node.feature >= 0:
        node = node.left if features[node.feature] < node.limit else node.right
    return node.keep


def boiler_name(attributes: str) -> float:
    """The share of boilerplate words among the words of class, id and role; 1 for what is hidden."""
    if _HIDDEN.search(attributes):
        return 1.0
    hits = words = 0
    for found in _NAME.finditer(attributes):
        before = ""
        for word in _WORD.findall(found[1] or found[2] or found[3] or ""):
            word = word.lower()
            hits += word in BOILER_NAMES and before not in _TAKES_BACK
            words += 1
            before = word
    return hits / words if hits else 0.0


class _Tags:
    """The tags of a page, one after another."""

    def __init__(self, page: str):
        self.page, self.pattern = page, _TAG

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name (empty: a comment or a declaration) and attributes of the next tag from a place on."""
        found = self.pattern.search(self.page, at)
        if found is not None and not (found[5] or found["mark"] or found[0].startswith("<!--")):
            if self.page.find(">", found.start()) < 0:
                return None
            self.pattern = _PLAIN  # a quote is never closed: from here on the next ">" ends a tag
            found = _PLAIN.search(self.page, found.start())
        if found is None:
            return None
        return found.start(), found.end(), bool(found[2]), (found[3] or "").lower(), found[4] or ""


@dataclass
class Frame:
    """An element that is boilerplate by its tag or name, and the words in it."""

    above: Frame | None
    #: 1 for a boilerplate element, the share of boilerplate words for a name.
    weight: float
    words: int = 0
    #: Of these, those in an article.
    article: int = 0


@dataclass(frozen=True)
class Block:
    text: str
    words: int
    linked: int
    article: bool
    heading: bool
    tag: Frame | None
    name: Frame | None
    #: Whether the name is that of the block's own element.
    own: bool

    def __getitem__(self, k: int):
        return (self.text, self.words, self.linked)[k]


@dataclass(frozen=True)
class Element:
    element: str = ""
    article: bool = False
    heading: bool = False
    tag: Frame | None = None
    name: Frame | None = None
    own: bool = False


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    opened: list[Element] = []
    open_tags: Counter[str] = Counter()
    state = Element()
    in_link = False
    at, end = 0, len(page)
    tags = _Tags(page)

    def flush() -> None:
        if parts:
            text = "".join(parts)
            words = (entities.unescape(text) if "&" in text else text).split()
            if words:
                links = "".join(linked)
                out.append(Block(" ".join(words), len(words), len((entities.unescape(links) if "&" in links else links).split()), state.article, state.heading, state.tag, state.name, state.own))
                for frame in (state.tag, state.name):
                    while frame is not None:  # as many as there are weights, at most
                        frame.words += len(words)
                        frame.article += len(words) if state.article else 0
                        frame = frame.above
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text)

    def close(down_to: int) -> None:
        for element in opened[down_to:]:
            open_tags[element.element] -= 1
        del opened[down_to:]

    while at < end:
        found = tags.next(at)
        if found is None:
            add(page[at:])
            break
        start, behind, closing, tag, attributes = found
        if start > at:
            add(page[at:start])
        at = behind
        if not tag:
            continue
        if tag in UNSEEN and not closing and tag not in VOID:
            if tag in BLOCK_TAGS:
                flush()
            if tag not in SELF_CLOSING or not attributes.endswith("/"):
                at = _after(tags, at, tag, open_tags)
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            add(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if closing and tag in ("li", "p", "div", "td"):
                in_link = False
            if closing:
                if open_tags[tag]:
                    close(max(k for k in range(len(opened) - 1, -1, -1) if opened[k].element == tag) if opened[-1].element != tag else len(opened) - 1)
            elif tag not in VOID:
                if tag == "p" or tag in HEADINGS:  # neither holds another of its kind
                    while opened and (opened[-1].element == "p" or opened[-1].element in HEADINGS):
                        close(len(opened) - 1)
                elif tag == "li" and opened and opened[-1].element == "li":
                    close(len(opened) - 1)
                above = opened[-1] if opened else Element()
                if tag in ARTICLE_TAGS and not above.article and above.tag is None:  # what an article's frame is called says nothing about it
                    own = Element(tag, article=True)
                else:
                    name, weight = above.name, boiler_name(attributes) if attributes and tag not in ("html", "body") else 0.0
                    named = weight > (name.weight if name else 0.0)
                    frame = Frame(above.tag, 1.0) if tag in BOILER_TAGS and above.tag is None else above.tag
                    own = Element(tag, above.article, tag in HEADINGS, frame, Frame(name, weight) if named else name, named and (tag == "p" or tag in HEADINGS))
                opened.append(own)
                open_tags[tag] += 1
            state = opened[-1] if opened else Element()
    flush()
    return out


_RAW_END = {tag: re.compile(rf"</{tag}(?![a-z0-9:-])", re.I) for tag in RAW}


def _after(tags: _Tags, at: int, tag: str, above: Mapping[str, int]) -> int:
    """The place behind the element `tag` that was opened before `at`; if it is never closed, where an element of `above` ends."""
    page = tags.page
    if tag in RAW:
        found = _RAW_END[tag].search(page, at)
        end = page.find(">", found.end()) if found else -1
        return len(page) if end < 0 else end + 1
    depth = 1
    inner: Counter[str] = Counter()  # what was opened inside
    while found := tags.next(at):
        start, at, closing, name, attributes = found
        if name == tag:
            depth += -1 if closing else 0 if attributes.endswith("/") else 1
            if not depth:
                return at
        elif name in RAW and not closing:
            at = _after(tags, at, name, {})
        elif tag == "head" and name == "body" and not closing:
            return start
        elif above.get(name):
            inner[name] += -1 if closing else 1
            if inner[name] < 0:  # the parent ends, so its child does
                return start
    return len(page)


def features(found: list[Block]) -> Iterator[tuple[float, ...]]:
    """The FEATURES of each block of a page."""
    total, article = max(1, sum(b.words for b in found)), sum(b.words for b in found if b.article)
    share = lambda frame: frame.words / total if frame.article == article else 0.0
    own = [(b.words, b.linked / b.words) for b in found]
    for k, b in enumerate(found):
        before, after = own[k - 1] if k else (0, 0.0), own[k + 1] if k + 1 < len(own) else (0, 0.0)
        tag = (1.0, share(b.tag)) if b.tag else (0.0, 0.0)
        name = (b.name.weight, share(b.name)) if b.name else (0.0, 0.0)
        yield *own[k], *before, *after, float(b.article), float(b.heading), *tag, *name, float(b.own)


def extract(page: str | None, node: Node | None = None) -> str:
    """The main text of a page, its blocks joined by line breaks."""
    node = node or tree()
    found = blocks(page or "")
    return "\n".join(b.text for b, own in zip(found, features(found), strict=True) if classify(node, own))


def _extract_batches(batches: Iterator[pa.RecordBatch], node: Node) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page.as_py(), node) for page in batch.column(2)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, node: Node | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    return pages.select("page_id", "url", "html").mapInArrow(partial(_extract_batches, node=node or tree()), "page_id long, url string, text string, n_chars long")


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
