"""Main text of pages: made pages with all kinds of boilerplate, broken markup, and the given pages by a plain reading of their articles."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from mapweave.llm import page_text
from mapweave.llm.page_text import main_text

SF = "/root/testdata/sf0.001"
PROSE = [f"Sentence number {i} of the story goes on for quite a while, with commas, and says what happened next in plain words." for i in range(8)]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)
JUNK = [
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>", '<div class="sidebar"><p>Most read stories of this week, chosen by our editors for you.</p></div>',
    "<aside><p>About the author, who has written for this page for many years.</p></aside>", '<div id="cookie-notice">We use cookies to make this page work better for you. <button>Accept</button></div>',
    '<div class="top-ad">Buy one and get another one for free, today only, in all shops.</div>', "<form action=/s><label>Search</label><input name=q><p>Type a word and press the key to find pages.</p></form>",
    "<script>document.write('<p>written</p>')</script>", "<style>p{color:red}</style>", "<!-- <p>remark</p> -->", "<noscript><p>Please turn scripts on.</p></noscript>", '<p style="display:none">hidden words</p>', "<p hidden>more hidden words</p>",
    '<section id="comments"><h2>Comments</h2><article class="comment"><p>First! I have read the whole story and like it very much indeed, thanks for it.</p></article></section>',
    '<footer><p>Copyright of this page by its owners. All rights reserved, in all places.</p></footer>', '<div role="banner">The name of the site, and its motto for the day</div>', "<header><div>Site of news and stories</div></header>",
    '<div class="relatedPosts"><a href=/1>One</a> <a href=/2>Two</a></div>', '<div class="newsletter">Subscribe to our letter, which comes once a week to your box.</div>',
]


@pytest.mark.parametrize("frame", ["<article><h1>A title</h1>{}</article>", "<main><h1>A title</h1>{}</main>", "<div><h1>A title</h1>{}</div>", '<div class="post-content"><h1>A title</h1>{}</div>', "<h1>A title</h1>{}"])
def test_boilerplate_goes(frame):
    middle = frame.format(BODY)
    want = "\n".join(["A title", *PROSE])
    for junk in JUNK:
        assert main_text(f"<html><body>{junk}{middle}{junk}</body></html>") == want, junk
    assert main_text(f"<html><head><title>No</title></head><body>{''.join(JUNK)}{middle}{''.join(JUNK)}</body></html>") == want


def test_blocks_and_references():
    page = "<article><h1>A &amp; B&nbsp;&lt;c&gt;</h1>\n<p>one\n two<br>three <b>fo</b>ur &#233;&#x1F642; &amp &am x</p><ul><li>a<li>b</ul><blockquote>q</blockquote><table><tr><td>1<td>2<tr><td>3</table>loose<div>end</div>&copy;</article>"
    assert main_text(page).split("\n") == ["A & B <c>", "one two three four é🙂 & &am x", "a", "b", "q", "1 2", "3", "loose", "end", "©"]


def test_broken_markup():
    assert main_text("<article><p><b>bold <p>next</b> <i>it<p>last") == "bold\nnext it\nlast"
    assert main_text("<body><nav><ul><li><a href=x>menu</a><article><p>The text of the page</p></article>").endswith("The text of the page")
    assert main_text("a < b and b > c, 1<2 <3") == "a < b and b > c, 1<2 <3"
    assert main_text("plain words only") == "plain words only"
    assert main_text('<article><p title="a>b">x</p><p title="y>z</p></article>').startswith("x")
    assert main_text("<article><p>x<!-- never closed <p>y</p>") == "x" and main_text("<article><p>x<script>never closed") == "x"
    assert main_text("") == main_text(None) == main_text("<html><body></body></html>") == main_text("<nav><a href=x>only menu</a></nav>") == ""


def test_parts_of_an_article_without_its_element():
    parts = "".join(f"<section><h2>Part {i}</h2>{BODY}</section>" for i in range(3))
    page = f'<html><body><div class="menu"><a href=/>x</a></div><div id="page">{parts}</div><div>Short words</div></body></html>'
    assert main_text(page) == "\n".join(x for i in range(3) for x in [f"Part {i}", *PROSE])


def test_lists_of_links_inside():
    page = f"<article><h1>T</h1>{BODY}<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p>See <a href=x>this</a> too, it is a good page.</p></article>"
    assert main_text(page) == "\n".join(["T", *PROSE, "See this too, it is a good page."])


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x", "<p><b>" * 100_000 + "x", "</x>" * 200_000 + "x", "<a " * 200_000, '<a b="' * 100_000 + "x", "<li>x" * 100_000, "<!-- " * 100_000, "&" * 500_000, "<" * 500_000, "<table><tr><td>" * 50_000 + "x", "<script>" * 100_000])
def test_long_pages_take_linear_time(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 20


def test_query(spark):
    def article(source):
        inner = source[source.index("<article>") : source.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner))
        return "\n".join(x for x in blocks if x)

    got = {r.page_id: r for r in page_text.op12_page_text(spark, SF).collect()}
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    assert got.keys() == {r["page_id"] for r in pages}
    for r in pages:
        want = article(r["html"])
        assert (got[r["page_id"]].url, got[r["page_id"]].text, got[r["page_id"]].n_chars) == (r["url"], want, len(want))


def test_other_columns_pass(spark):
    rows = spark.createDataFrame([(1, None, "t", "x"), (2, "", "t", "y"), (3, f"<article>{BODY}</article>", "t", None)], "`a.b` int, html string, text string, `q``d` string")
    got = page_text.extract(rows)
    assert got.columns == ["a.b", "html", "text", "q`d", "text_", "n_chars"]
    assert [tuple(r)[4:] for r in sorted(got.collect(), key=lambda r: r[0])] == [("", 0), ("", 0), ("\n".join(PROSE), len("\n".join(PROSE)))]
    assert page_text.extract(rows.limit(0)).count() == 0
