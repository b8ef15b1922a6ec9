"""Hand-made pages, and the style tree's importances."""

import math

from cohortspark.llm import html_extract
from cohortspark.llm.html_extract import extract, main_texts, style_tree, with_host

NONE = frozenset()


def test_page():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li>'
        '<a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">Buy.</div><article><h1>Head &amp; tail&am</h1><p><b>One\n two.<br>'
        "<p>Th<i>re</i>e&nbsp;four</p><div class='comments'><p>Nice!</p></div><form><p>mail</p></form></article><footer>&copy; x</footer></body></html>"
    )
    assert extract(page, NONE) == "Head & tail&am\nOne two.\nThree four"
    assert extract(page.replace("</div><article>", "<article>"), NONE) == "Head & tail&am\nOne two.\nThree four"
    assert extract(page.split("<div class='comments'>")[0], NONE) == "Head & tail&am\nOne two.\nThree four"


def test_odd():
    assert extract("", NONE) == ""
    assert extract("plain  text", NONE) == "plain text"
    assert extract("a < b <p>c<p>d", NONE) == "a < b\nc\nd"
    assert extract('<p class="x>y', NONE) == "y"
    assert extract("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", NONE) == "a\nb\nc\nd"
    assert extract("<article><header><h1>T</h1></header><p>x</article>", NONE) == "T\nx"
    assert extract("<script>" + "x" * 100_000, NONE) == ""
    assert len(extract("<article><p>" + "w <b>" * 20_000, NONE)) == 39_999


def test_site(spark):
    site = [(i, f"https://a.org/{i}", f"<body><div class=top><p>Welcome to us</p></div><div class=body><p>Story {i} goes on</p></div>", 0) for i in range(9)]
    others = [(20, None, None, 0), (21, "http://b.org", "<div><p>Welcome to us</p></div>", 0), (21, "http://b.org", "<div><p>Welcome to us</p></div>", 0)]
    pages = spark.createDataFrame(site + others, "page_id long, url string, html string, n_chars int")
    want = sorted([(i, f"Story {i} goes on") for i in range(9)] + [(20, ""), (21, "Welcome to us"), (21, "Welcome to us")])
    got = main_texts(pages).collect()
    assert sorted((r.page_id, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
    tree = style_tree(with_host(pages)).where("host = 'a.org' and features > 0").collect()
    assert sorted((r.pages, round(r.content, 6)) for r in tree) == [(9, 0.0), (9, 1.0)]
    assert main_texts(pages.limit(0)).count() == 0


def test_join_path(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", 0)
    test_site(spark)


def test_entropy(spark):
    rows = [(i, "http://h/", f"<div>{'same' if i < 4 else i}</div>") for i in range(8)]
    node = style_tree(with_host(spark.createDataFrame(rows, "page_id long, url string, html string"))).where("features > 0").first()
    assert math.isclose(node.content, 1 - 4 * math.log(4) / 8 / math.log(8)) and node.presentation == 0


def site_texts(spark, page):
    rows = [(i, f"https://a.org/{i}", f"<body>{page.format(i=i)}</body>") for i in range(9)]
    return {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_body_beside_article(spark):
    got = site_texts(spark, "<article><p>Teaser {i}</p></article><div class=body><p>Story {i}</p></div><div class=top><p>Welcome</p></div>")
    assert got == {i: f"Teaser {i}\nStory {i}" for i in range(9)}


def test_importance_inside_article(spark):
    got = site_texts(spark, "<article><h1>Head {i}</h1><p class=fixed>All rights</p><div>Posted<p>Story {i}</p></div></article>")
    assert got == {i: f"Head {i}\nStory {i}" for i in range(9)}


def test_article_is_a_prior(spark):
    # Six of nine pages share a text: an importance of 1 - 6 log 6 / 9 log 9 = 0.46 is noise outside an article only.
    rows = [(i, "http://h/", f"<article><p>{'same' if i < 6 else i}</p></article><div class=body><p>Story {i}</p></div>") for i in range(9)]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"{'same' if i < 6 else i}\nStory {i}" for i in range(9)}
    rows = [(i, u, h.replace("article", "section")) for i, u, h in rows]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i}" for i in range(9)}


def test_names_of_content():
    page = "<article><div class='share-price'><p>Up 3 %</p></div><div class='share-buttons'><p>Tweet</p></div><p>x &am<b>p;</b> y &amp; z</p><div class='ad-slot-3'>Buy</div></article>"
    assert extract(page, NONE) == "Up 3 %\nx &amp; y & z"
    assert extract("<div class='header-image-credits'><p>By Ann</p></div><div id=site-footer>c</div><div class='comment list'>n</div>", NONE) == "By Ann"
