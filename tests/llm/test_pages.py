"""Main text of pages: hand-made layouts, markup that is not closed, and an independent reader."""

import re
from html.parser import HTMLParser

import duckdb
import pytest

from winnowry.llm import html_crf

T = "The quick brown fox jumps over the lazy dog, and then it sleeps all the afternoon in the warm sun."

# page, expected blocks; written by hand, not by the generator that the chain is trained with
LAYOUTS = {
    "open head": (f"<html><head><title>x</title><style>p{{}}</style><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Fish</h1><p>{T}<p>{T}</article><footer>&copy; me</footer>", ["Fish", T, T]),
    "custom element in a line": (f"<body><article><h1>Fish</h1><p>{T} <svg-icon name=x></svg-icon> more.</p><p>{T}</p></article>", ["Fish", T + " more.", T]),
    "custom element around": (f"<body><template-card><article><h1>Fish</h1><p>{T}</p></article></template-card>", ["Fish", T]),
    "open select": (f"<body><article><h1>Fish</h1><select><option>a<option>b<p>{T}</p></article>", ["Fish", T]),
    "apostrophe in a bare value": (f"<body><article><h1>Fish</h1><p title=it's>{T}</p><p>{T} It's so.</p></article>", ["Fish", T, T + " It's so."]),
    "comments inside": (f"<body><article><h1>Fish</h1><p>{T}</p><p>{T}</p><div class='comments'><h3>Comments</h3><p>Nice one!</p><p>I do not agree with this at all, sorry.</p></div></article>", ["Fish", T, T]),
    "pictures": (f"<body><article><h1>Fish</h1><svg><title>t</title><text>no</text></svg><p>{T}</p><video src=a><p>fallback</p></video><object data=x>old</object></article>", ["Fish", T]),
    "characters": (f"<body><article><h1>a &lt; b</h1><p>{T} 1 < 2 &amp; 3 > 2 &lt;b&gt; &#x41;&#66;&nbsp;c</p></article>", ["a < b", T + " 1 < 2 & 3 > 2 <b> AB c"]),
    "div soup": (f'<div id="wrapper"><div class="top-nav"><a href=/a>News</a> <a href=/b>Sport</a></div><div class="main-content"><h1>Weather</h1><div class="text"><p>{T}</p><p>{T}</p></div></div><div class="sidebar"><p>Most read</p><ul><li><a href=/c>One</a></ul></div><div class="footer">Terms</div></div>', ["Weather", T, T]),
    "scripts": (f"<body><script>var a='<p>no</p>';</script><article><p>{T}</p><SCRIPT>if (a<b) x('</p>')</SCRIPT ><p>{T}</p><noscript>no</noscript><textarea>no</textarea></article><script>open", [T, T]),
    "capitals": (f"<BODY><NAV><UL><LI><A HREF=/>Home</A></UL></NAV><ARTICLE><H1>Fish</H1><P>{T}</P></ARTICLE></BODY>", ["Fish", T]),
    "white space": ("<body><article><h1> Fish \n and\tchips </h1><p>  " + T.replace(" ", " \n ") + " </p></article>", ["Fish and chips", T]),
    "list and quote": (f"<body><article><h1>Fish</h1><p>{T}</p><ul><li>First catch a fish in the river.</li><li>Then fry it in a pan.</li></ul><blockquote>{T}</blockquote></article><form><label>Mail</label><button>Send</button></form>", ["Fish", T, "First catch a fish in the river.", "Then fry it in a pan.", T]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html_crf.main_text(page, html_crf.default_chain()) == "\n\n".join(want)


#: Parts of a page that are no main text, wherever they stand.
PARTS = [
    *(f'<div class="{c}"><p>%s</p></div>' for c in (
        "ad", "ads", "advert", "advertisement", "sponsored", "sidebar", "comments", "reader-comments", "comment-thread", "responses", "widget", "popup", "modal", "breadcrumb", "pagination",
        "social", "login", "ad-container", "newsletter-signup", "related-articles", "cookie-notice", "inline-promo",
    )),
    '<section id="comments"><p>%s</p></section>', '<aside><p>%s</p></aside>', '<form><p>%s</p></form>', '<nav><p>%s</p></nav>', '<div class="ad">%s</div>', '<article class="comment"><p>%s</p></article>',
    "<div hidden><p>%s</p></div>", '<div style="display:none"><p>%s</p></div>', "<p style='color:red; display: none'>%s</p>", "<dialog><p>%s</p></dialog>", '<div role="dialog"><p>%s</p></div>', '<div role="alertdialog"><p>%s</p></div>',
    '<span hidden>%s</span>', "<DIV HIDDEN>%s</DIV>",
]
SHORT, LONG = "Some more words stand here now.", "I have read this twice and I must say that I can not follow the writer at all here, for the dog was never lazy."


@pytest.mark.parametrize("part", PARTS)
def test_parts_inside_and_after_the_article(part):
    """One paragraph or several, short or long, between the article's paragraphs, at its end, or behind it."""
    for text in (SHORT, LONG):
        for many in (1, 3):
            made = (part % text) if many == 1 or "<p>" not in part else part.replace("<p>%s</p>", f"<p>{text}</p>" * many)
            for page in (f"<p>{T}</p>{made}<p>{T}</p></article>", f"<p>{T}</p><p>{T}</p>{made}</article>", f"<p>{T}</p><p>{T}</p></article>{made}"):
                page = f"<body class='has-sidebar comments-open'><article class='post'><h1>Fish</h1>{page}<footer>Me</footer>"
                assert html_crf.main_text(page, html_crf.default_chain()) == "\n\n".join(["Fish", T, T]), page


def test_text_stays_in_neutral_containers_and_open_elements():
    for c in ("text", "body-copy", "lead", "chapter", "section-2", "figure-text"):
        page = f'<body><article><h1>Fish</h1><div class="{c}"><p>{T}</p></div><p>{T}</p></article>'
        assert html_crf.main_text(page, html_crf.default_chain()) == "\n\n".join(["Fish", T, T]), c
    # an open dialog is shown, a hidden element without an end hides nothing, and pages themselves are never hidden
    page = f"<body style='display:none'><article hidden><h1>Fish</h1><section hidden><p>{T}</p><p>{T}</p></article>"
    assert html_crf.main_text(page, html_crf.default_chain()) == "\n\n".join(["Fish", T, T])
    assert [b.text for b in html_crf.leaf_blocks("<dialog open><p>a</p></dialog><p hidden>b<p>c<dialog>d</dialog>e")] == ["a", "c", "e"]


class Reader(HTMLParser):
    """The article's blocks of the generated pages, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.skip, self.blocks = 0, 0, [[]]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in ("script", "style"):
            self.skip += 1
        if tag in ("p", "h1", "article"):
            self.blocks.append([])
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside -= 1
        if tag in ("script", "style"):
            self.skip -= 1
        if tag in ("p", "h1", "article"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1].append(data)


def test_pages_against_another_reader(spark):
    """Pages with one article, no matter which other parts they have; comments inside an article are not in these tables."""
    path = "/root/testdata/sf0.01/pages.parquet"
    got = {r["page_id"]: r for r in html_crf.extract(spark.read.parquet(path)).collect()}
    seen = 0
    for page_id, page in duckdb.sql(f"SELECT page_id, html FROM '{path}'").fetchall():
        if page.count("<article") == 1 and "comment" not in page.split("<article")[1].split("</article")[0]:
            r = Reader()
            r.feed(page)
            want = "\n\n".join(t for t in (" ".join("".join(b).split()) for b in r.blocks) if t)
            assert got[page_id]["text"] == want and got[page_id]["n_chars"] == len(want)
            seen += 1
    assert seen > 0.7 * len(got)


def test_odd_rows(spark):
    long = "<article><h1>Long</h1>" + f"<p>{T}</p>" * 20_000 + "</article>"
    rows = [(1, None, "u"), (2, "", None), (3, "<p", "x"), (3, "<p", "x"), (4, long, "y"), (None, f"<article><p>{T}</p></article>", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, `row` string").selectExpr("*", "1 AS _html", "'k' AS text", "2 AS `a.b`")
    out = html_crf.extract(df)
    assert out.columns == ["page_id", "html", "row", "_html", "a.b", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0), r["row"] or "", r["n_chars"], r["text"][:5]) for r in out.collect())
    n = 4 + 20_000 * (len(T) + 2)
    assert got == [(0, "z", len(T), "The q"), (1, "u", 0, ""), (2, "", 0, ""), (3, "x", 0, ""), (3, "x", 0, ""), (4, "y", n, "Long\n")]
    assert html_crf.extract(df.where("false")).collect() == []
    assert not re.search("<", "".join(t for *_, t in got))
