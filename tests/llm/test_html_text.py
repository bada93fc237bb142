"""Main text of hand-made pages, the tree, and edge cases."""

from casegrid.llm import html_text as H

TREE = H.labelled_tree()

ARTICLE = """<!DOCTYPE html><html class="no-js"><head><title>T</title><style>p{}</style><body class="has-sidebar">
<header class="site"><h1>Site name</h1><nav><ul><li><a href=x>Home</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies on this long site to do many things you may not like at all, really.</div>
<main><div class="layout-sidebar"><article><header><h1>My &eacute;t&eacute; &amp; title</h1></header>
<p>First   paragraph with <a href=q>a link</a> and
more<br>text.</p><p>Short.</p><div class="advert">Buy this thing now, it is the best thing ever made for you</div>
<aside>Did you know that aside text is here</aside><ul><li>Item one</li><li>Item two</li></ul>
<script>if (a<b) {document.write("<p>x</p>")}</script><form><label>Name</label><input> Subscribe to our list</form>
<!-- hidden <p>comment</p> --><p>Last para&nbsp;graph &lt;b&gt; h<b>er</b>e</p>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Great article, thank you very much for that, I liked it</p></div></section>
</article></div></main><footer>&copy; 2020 all rights reserved by the company and so on</footer></body></html>"""

RUNNING = "This is a long paragraph of the running text that has more than fifteen words in it for sure, yes."


def test_marked_page():
    assert H.main_text(ARTICLE, TREE).split("\n") == [
        "My été & title", "First paragraph with a link and more text.", "Short.", "Item one", "Item two", "Last para graph <b> here"]


def test_unmarked_page():
    page = (f'<div id="header">My site</div><div id="nav"><a href=1>One</a> <a href=2>Two</a></div><div id="content"><h2>A headline here</h2>'
            f'<div>{RUNNING}</div><div>{RUNNING}</div></div><div id="sidebar">{RUNNING}</div><div id="footer">Copyright me</div>')
    assert H.main_text(page, TREE).split("\n") == ["A headline here", RUNNING, RUNNING]


def test_broken_markup():
    page = f"<nav><a href=1>x</a></nav><article><h1>Title</h1><p><b>Bold start.<br><p>{RUNNING}<p>End"
    assert H.main_text(page, TREE).split("\n") == ["Title", "Bold start.", RUNNING, "End"]
    assert H.main_text(f"<article><p>{RUNNING}</p><script>never closed <p>x", TREE) == RUNNING
    assert H.main_text(f"<article><p>{RUNNING}</p><!-- never closed <p>x", TREE) == RUNNING
    assert H.main_text("<p>only this", TREE) == "only this"


def test_comment_articles_and_teasers_go():
    page = f'<article><p>{RUNNING}</p></article><div class="comments"><article class="comment"><p>{RUNNING}</p></article></div>'
    assert H.main_text(page, TREE) == RUNNING


def test_named_content_and_linked_blocks():
    page = (f'<div class="entry-content"><p>{RUNNING}</p><p>Yes.</p></div><a href=x><h3>Other story</h3><p>{RUNNING}</p></a>')
    assert H.main_text(page, TREE).split("\n") == [RUNNING, "Yes."]
    page = f'<main><p>{RUNNING}</p><article><h3>Teaser</h3></article><p>Last.</p></main>'
    assert H.main_text(page, TREE).split("\n") == [RUNNING, "Teaser", "Last."]
    page = f'<main><p>Some words on the site</p><article><p>{RUNNING}</p><p>No.</p></article></main>'
    assert H.main_text(page, TREE).split("\n") == [RUNNING, "No."]


def test_tree_fits_its_table():
    x, y = H.labelled_blocks()
    assert ((TREE.predict(x) >= 0.5) == y).all()


def test_test_pages(spark):
    """On the given pages: the article's blocks, cut by a plain pattern."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", inner))
        text = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (r.url, text, len(text))


def test_rows(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (3, "u", "<nav>x</nav>", 0), (None, "u", f"<article>{RUNNING * 4000}</article>", 0), (3, "u", "<nav>x</nav>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = sorted(((r.page_id or 0, r.text, r.n_chars) for r in H.extract(pages).collect()))
    long = RUNNING * 4000
    assert out == [(0, long, len(long)), (1, "", 0), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert H.extract(pages.limit(0)).count() == 0


def test_parts_of_a_text_with_everyday_names():
    """Sections and anchors whose names hold words such as discussion or social stay whole."""
    for open_, close in (('<section id="discussion">', "</section>"), ('<section id="social-impact">', "</section>"), ('<div class="search-results-table">', "</div>"),
                         ('<div class="notice-period">', "</div>"), ('<section id="cookies">', "</section>"), ('<section id="menu">', "</section>"),
                         ('<div class="related">', "</div>"), ('<section id="http-header">', "</section>"), ('<div class="has-sidebar">', "</div>")):
        page = f'<article><h1>Title</h1><p>{RUNNING}</p>{open_}<h2>Part</h2><p>{RUNNING}</p><p>Short.</p>{close}<p>End.</p></article>'
        assert H.main_text(page, TREE).split("\n") == ["Title", RUNNING, "Part", RUNNING, "Short.", "End."], open_
    page = f'<article><h2 id="related-work">Related work</h2><p class="notice-period">Three months.</p><h2 id="comments">Comments</h2><p>{RUNNING}</p></article>'
    assert H.main_text(page, TREE).split("\n") == ["Related work", "Three months.", "Comments", RUNNING]


def test_named_parts_go():
    link = "<a href=x>Another story of this site</a>"
    for part in (f'<section id="comments"><p>{RUNNING}</p></section>', f'<div id="respond"><p>{RUNNING}</p></div>', f'<div class="x sidebar-right"><p>{RUNNING}</p></div>',
                 f'<div class="cookieBanner"><p>{RUNNING}</p></div>', f'<div id="ad-300x250">{RUNNING}</div>', f'<div class="related-posts"><h3>Related</h3><ul><li>{link}</li><li>{link}</li></ul></div>',
                 f'<section id="related"><p>{link}</p></section>', '<div class="social-share">Share this</div>', f'<div role="search">{RUNNING}</div>', f'<div class="post-comments">{RUNNING}</div>'):
        page = f'<article><p>{RUNNING}</p>{part}<p>End.</p></article>'
        assert H.main_text(page, TREE).split("\n") == [RUNNING, "End."], part
