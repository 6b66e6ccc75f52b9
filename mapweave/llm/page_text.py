"""Main text of web pages by composite text density.

Each page becomes a tree of elements (tags that HTML leaves out are closed as browsers close them). Marked boilerplate
goes first: scripts, styles, forms, menus, sidebars, page headers and footers, hidden elements, and elements whose
class, id or role names an advert, a notice, a menu or reader comments; a mark is void on an element that holds all the
page's articles, so an unclosed menu cannot swallow the page. Of what is left, each element has a density: its
characters for each of its tags, adjusted by the share of links in its text and tags; and a density sum: that of its
children and of its own runs of text. The element with the largest sum is the main text, or the outermost article (or
main part) that holds it. The least density on the way from it up to the body is the threshold for the other elements
beside this way: headings, paragraphs and lists that reach it belong to the text too, and containers that reach it
and hold paragraphs. Within the chosen elements nothing is dropped but lists that are nearly all links.

A block ends where an element that is no inline one begins or ends (cells of a table row stay in one block). Character
references are decoded, white space in a block (Unicode's) becomes one space, blocks without text are left out, the
others come in page order, joined by a line feed. Null and empty pages, and pages without text, give the empty text.
Work and memory grow in proportion to the page; a page of any length is handled whole, as one row of one task. Repeated
rows get equal texts, an empty table gives an empty result, other columns pass through, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh, sliced, table, with_made

_NAME = r"[a-zA-Z][^\s/>]*"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^>\s"'][^>\s]*)"""
#: A comment, a declaration, or a start or end tag; unclosed comments and tags go to the end of the page.
_MARKUP = re.compile(rf"""<!--(?:>|->|.*?(?:-->|$))|<[!?][^>]*(?:>|$)|<(/?)({_NAME})((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)|<(/?)({_NAME})([^>]*)(?:>|$)|</[^>]*(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(rf"""([^\s=/>"']+)(?:\s*=\s*({_VALUE}))?""")
#: The content of these is text up to their own end tag.
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_VOID = set("area base br col embed hr img input link meta param source track wbr frame keygen basefont bgsound".split())
_INLINE = set(
    "a abbr acronym b basefont bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rb rp rt rtc ruby s samp small source span strike strong sub sup td th time tt u var wbr".split()
)
_CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: What an opening tag closes, if it is the innermost open element of those that shape lists and tables.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "tfoot": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "thead": {"td", "th", "tr", "tbody", "thead", "tfoot"}}
_SHAPES = set("ul ol menu dl li dt dd table thead tbody tfoot tr td th".split())
_NEVER = set("head script style noscript template iframe object embed svg math canvas audio video map select option datalist textarea button input noembed noframes title dialog xmp".split())
_FRAME = {"nav", "aside", "footer", "form", "menu"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXTUAL = _HEADINGS | set("p ul ol dl table blockquote pre figure".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or an id that mark boilerplate.
_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox banner sponsor sponsored sponsors promo promotion "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toc toolbar topbar skip "
    "sidebar sidebars aside widget widgets related recommended recommendations trending popular footer masthead "
    "notice notices cookie cookies consent gdpr privacy alert popup modal overlay newsletter subscribe subscription signup login paywall disclaimer "
    "comment comments commentlist respond reply replies disqus discussion share sharing social form search hidden".split()
)
_HEADS = {"header", "head", "masthead"}
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


class Page:
    """The page's elements in page order; children have larger numbers than their parents. Number 0 is the page itself."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["#page"], [-1], [""]
        self.parts: list[tuple[int, str | None]] = []  # element and text of it, or None where an element starts; -1 - element where it ends
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, shapes, opened, at, end = [0], [], {"#page": 1}, 0, len(source)

        def close(to: int) -> None:
            while len(stack) > to:
                e = stack.pop()
                opened[self.tags[e]] -= 1
                if shapes and shapes[-1] == e:
                    shapes.pop()
                self.parts.append((-1 - e, None))

        def close_tag(tag: str) -> None:
            i = len(stack) - 1
            while self.tags[stack[i]] != tag:
                i -= 1
            close(i)

        while at < end:
            m = _MARKUP.search(source, at)
            text = source[at : m.start() if m else end]
            if text:
                self.parts.append((stack[-1], html.unescape(text)))
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if opened.get(tag) and tag not in ("html", "body"):
                    close_tag(tag)
                continue
            if tag in _CLOSES_P and opened.get("p"):
                close_tag("p")
            if tag in ("a", "button", "option") and opened.get(tag):
                close_tag(tag)
            while shapes and self.tags[shapes[-1]] in _SIBLINGS.get(tag, ()):
                close_tag(self.tags[shapes[-1]])
            e = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.attributes.append(m[3] or m[6] or "")
            self.parts.append((e, None))
            if tag in _RAW:
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", re.I).search(source, at)
                if tag not in _NEVER:
                    self.parts.append((e, source[at : closing.start() if closing else end]))
                at = closing.end() if closing else end
            if tag in _VOID or tag in _RAW:
                self.parts.append((-1 - e, None))
                continue
            stack.append(e)
            opened[tag] = opened.get(tag, 0) + 1
            if tag in _SHAPES:
                shapes.append(e)
        close(1)

    def marked(self, e: int) -> bool:
        """Whether an element's tag, role, class or id says that it is no main text."""
        tag, said = self.tags[e], self.attributes[e]
        if tag in _NEVER or tag in _FRAME:
            return True
        if not said or tag in ("html", "body"):
            return False
        of = {k.lower(): html.unescape(v.strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(said))}
        if "hidden" in of or of.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", of.get("style", "")):
            return True
        if of.get("role", "").lower() in _ROLES:
            return True
        words = {w.lower() for w in _WORD.findall(f"{of.get('class', '')} {of.get('id', '')}")}
        return bool(words & _WORDS) or bool(words & _HEADS and tag in ("div", "section"))


def _kept(page: Page) -> list[bool]:
    """Of each element, whether neither it nor an element around it is marked as boilerplate."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    marked = [page.marked(e) for e in range(n)]
    main = [tags[e] in ("article", "main") and not marked[e] for e in range(n)]
    heads = [tags[e] in _HEADINGS for e in range(n)]
    mains, under = [int(x) for x in main], [int(x) for x in heads]
    for e in range(n - 1, 0, -1):
        mains[parents[e]] += mains[e]
        under[parents[e]] += under[e]
    all_mains, kept, inside = mains[0], [True] * n, [False] * n
    for e in range(1, n):
        up = parents[e]
        inside[e] = inside[up] or main[e]
        out = marked[e] or tags[e] == "header" and not (inside[e] and under[e])
        if out and all_mains and mains[e] == all_mains and tags[e] not in _NEVER:
            out = False
        kept[e] = kept[up] and not out
    return kept


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    n, tags, parents, kept = len(page.tags), page.tags, page.parents, _kept(page)
    chars, marks, link_chars, link_marks, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    own = [0.0] * n  # sums of the densities of an element's own runs of text
    for e in range(1, n):
        linked[e] = linked[parents[e]] or tags[e] == "a"
        if kept[e] and tags[e] != "br":
            marks[e] = 1
            link_marks[e] = int(linked[e])
    for e, text in page.parts:
        if text is not None and kept[e] and (size := len(text) - text.count(" ")) and not text.isspace():
            chars[e] += size
            if linked[e]:
                link_chars[e] += size
            else:
                own[e] += size
    for e in range(n - 1, 0, -1):
        for sums in (chars, marks, link_chars, link_marks):
            sums[parents[e]] += sums[e]
    if not chars[0]:
        return ""
    share = link_chars[0] / chars[0]

    def density(e: int) -> float:
        c, t, lc, lt = chars[e], max(marks[e], 1), link_chars[e], max(link_marks[e], 1)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * math.log(c / max(lc, 1) * t / lt) / math.log(base) if base > 1 + 1e-9 else c / t * math.log(c / max(lc, 1) * t / lt + 1)

    dense = [density(e) if kept[e] else 0.0 for e in range(n)]
    total = own[:]
    for e in range(n - 1, 0, -1):
        total[parents[e]] += dense[e]
    block = [e for e in range(n) if kept[e] and (tags[e] not in _INLINE or e == 0)]
    best = max(block, key=lambda e: (total[e], -e))
    way = [best]
    while parents[way[-1]] >= 0:
        way.append(parents[way[-1]])
    for e in way:  # ends with the outermost
        if tags[e] in ("article", "main"):
            best = e
    way = way[way.index(best) :]
    threshold, on_way = min(dense[e] for e in way), set(way)
    holds = [tags[e] in ("p", "blockquote", "pre") for e in range(n)]
    for e in range(n - 1, 0, -1):
        holds[parents[e]] |= holds[e] and kept[e]
    # chosen: all of an element's text is taken; elements on the way are not, but for their own children that reach the threshold
    chosen = [False] * n
    for e in range(n):
        up = parents[e]
        if not kept[e]:
            continue
        if e == best or up >= 0 and chosen[up]:
            chosen[e] = not (e != best and tags[e] in ("ul", "ol", "div") and link_marks[e] >= 3 and 5 * link_chars[e] >= 4 * chars[e])
        elif up in on_way and e not in on_way and dense[e] >= threshold and 2 * link_chars[e] < chars[e]:
            chosen[e] = tags[e] in _TEXTUAL or tags[e] not in _INLINE and holds[e]
    blocks: list[str] = []
    run: list[str] = []

    def end_block() -> None:
        if run and (words := "".join(run).split()):
            blocks.append(" ".join(words))
        run.clear()

    for e, text in page.parts:
        at = e if e >= 0 else -1 - e
        if text is not None:
            if chosen[e]:
                run.append(text)
        elif tags[at] not in _INLINE:
            end_block()
        elif tags[at] in ("br", "td", "th"):
            run.append(" ")
    end_block()
    return "\n".join(blocks)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages' columns, text and n_chars (see fresh() for clashing names): the main text and its length in code points."""

    def made(batch: pa.RecordBatch, at: int) -> list[pa.Array]:
        texts = [main_text(x) for x in batch.column(at).to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]

    names = [fresh(pages, "text"), fresh(pages, "n_chars")]
    return with_made(pages, source, made, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
