import numpy as np
import pytest

from edgetide.llm import htmltext

SCHEMA = "page_id long, url string, html string, text string, main_text string"


def text_of(page):
    tree = htmltext.grow(htmltext.labelled_table())
    blocks = htmltext.blocks_of(page)
    return "\n\n".join(b.text for b, row in zip(blocks, htmltext.described(blocks)) if htmltext.decide(tree, row))


ARTICLE = "<article><h1>Title</h1><p>First <b>bold</b> &amp; <a href='x'>link</a>.<p>Second\n  line<br>break&nbsp;end</article>"


@pytest.mark.parametrize("page, expected", [
    (ARTICLE, "Title\n\nFirst bold & link.\n\nSecond line break end"),
    ("<nav><a href=/>Home</a></nav><header>Site</header>" + ARTICLE + "<footer>&copy; me</footer>", "Title\n\nFirst bold & link.\n\nSecond line break end"),
    ("<div class='page with-sidebar'><div id=sidebar><p>Side</p></div><div class='cookie-notice'>We use</div>" + ARTICLE + "</div>", "Title\n\nFirst bold & link.\n\nSecond line break end"),
    ("<main><p>One</p><div class='ad'>Buy</div><aside>See</aside><form>Mail <input><button>Go</button></form><section class='comments'><p>A reader wrote a long comment about it all.</p></section><p>Two</p></main>", "One\n\nTwo"),
    ("<article><p>x</p><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>a&lt;b &#x41;&eacute;</p>", "x\n\na<b Aé"),
    ("<article><header><h1>Head</h1></header><ul><li>one<li>two</ul><p>1 < 2 and 3 > 2</p></article>", "Head\n\none\n\ntwo\n\n1 < 2 and 3 > 2"),
    ("<article><p title=\"a > b\">quoted</p><p>cut off <a hre", "quoted\n\ncut off"),
    ("<article><p>tail</p><!-- never closed <p>x</p>", "tail"),
    ("<html><head><title>T</title></head><body class='has-nav no-sidebar'><article><p>Body</p></article>", "Body"),
    ("<article><p>Kept</p><div id='sideBar'>a</div><div class='MainMenu'>b</div><p class='siteFooter'>c</p><div class='postbody'><p>Too</p></div></article>", "Kept\n\nToo"),
    ("<div class='post'><div class='post-header'><h2>Head</h2></div><p>Short.</p></div><div class='user-comments'><p>Some words of a reader.</p></div>", "Head\n\nShort."),
    ("", ""), ("   ", ""), ("<nav>only</nav>", ""),
])
def test_pages(page, expected):
    assert text_of(page) == expected


def test_plain_page_without_containers():
    long = "Many words make up this paragraph, which is long enough to be the text of a page without any container at all."
    page = f"<a href=1>Home</a><div><a href=2>News</a></div><h1>Heading here</h1><p>{long}</p><p>{long}</p><div><a href=3>Next</a></div>"
    assert text_of(page).endswith(long) and "News" not in text_of(page)


LONG = "Many words make up this paragraph, which is long enough to be the text of a page without any container at all."
LINKS = "<ul><li><a href=1>Other news of today</a><li><a href=2>More to read here</a><li><a href=3>Old things</a></ul>"


@pytest.mark.parametrize("page, expected", [
    # a part named like an article that holds little beside the story
    (f"<nav><a href=/>Home</a></nav><div class='post'>Short teaser</div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>", ["Title", LONG, LONG]),
    # links among the text, told by densities; a linked title before text stays
    (f"<article><h1>T</h1><p>{LONG}</p>{LINKS}<p>{LONG}</p></article>", ["T", LONG, LONG]),
    (f"<article><h1>T</h1><p>{LONG}</p>{LINKS}</article>", ["T", LONG]),
    (f"<nav><a href=/>Home</a></nav><article><h1><a href=x>A linked title</a></h1><p>{LONG}</p></article>", ["A linked title", LONG]),
    ("<article><p>See <a href=1>this page</a> for it.</p><p>x</p></article>", ["See this page for it.", "x"]),
    # the last word that is not generic names a part
    (f"<main><p>{LONG}</p><div class='comments-container'><p>A {LONG}</p></div><div class='sidebar-wrapper'>B {LONG}</div><div class='page-footer'>C {LONG}</div></main>", [LONG]),
    (f"<main><p>{LONG}</p><div class='related-posts'><p>A {LONG}</p></div><div class='ad-slot'>B {LONG}</div></main>", [LONG]),
    (f"<article class='form-of-state'><h1>H</h1><p>{LONG}</p></article>", ["H", LONG]),
    (f"<nav><a>x</a></nav><div class='social-commentary'><h2>Two words</h2><p>{LONG}</p></div><div class=ad>B {LONG}</div>", ["Two words", LONG]),
    (f"<div class='content-sidebar-wrap'><div class=content><p>{LONG}</p></div><div class=sidebar><p>B {LONG}</p></div></div>", [LONG]),
    (f"<div id='search-page'><article><p>{LONG}</p></article></div>", [LONG]),
    ("<article><h1>T</h1><p>One.</p><p>Two.</p></article><footer>f</footer>", ["T", "One.", "Two."]),
])
def test_pages_of_other_kinds(page, expected):
    assert text_of(page).split("\n\n") == expected


def test_tree_learns_its_table():
    table = htmltext.labelled_table()
    tree = htmltext.grow(table)
    right = np.mean([htmltext.decide(tree, tuple(row[:-1])) == row[-1] for row in table])
    assert right >= 0.97
    used, nodes = set(), [tree]
    while nodes:
        node = nodes.pop()
        if node.feature >= 0:
            used.add(node.feature)
            nodes += [node.low, node.high]
    assert {0, 1, 3, 5} <= used  # words, and link densities of the block, of the one before and of the one after


def test_very_long_and_deep():
    assert text_of("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(text_of("<article><p>" + "word " * 200_000)) == 999_999
    assert text_of("<article><p>" + "<a '" * 2000) == ""


def test_table(spark):
    rows = [(1, "u", ARTICLE, "t", "m"), (2, None, None, None, None), (None, "v", "", None, None), (1, "u", ARTICLE, "t", "m"), (3, "w", "<article><p>\U0001F600é</p></article>", "t", "m")]
    frame = htmltext.page_texts(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert frame.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((tuple(r) for r in frame.collect()), key=repr)
    main = "Title\n\nFirst bold & link.\n\nSecond line break end"
    assert got == sorted([(1, "u", main, len(main)), (1, "u", main, len(main)), (2, None, "", 0), (None, "v", "", 0), (3, "w", "\U0001F600é", 2)], key=repr)
    assert htmltext.page_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_test_pages_keep_their_article(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.page_texts(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?p>|</?h1>", inner)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


def test_end_tags_without_a_start_cost_little():
    import time

    begin = time.time()
    page = "<article>" + "<b>" * 20_000 + "</i></section>" * 20_000 + "<p>words</article>"
    assert [b.text for b in htmltext.blocks_of(page)] == ["words"]
    assert time.time() - begin < 5
