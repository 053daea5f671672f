import html
import re
import time

from fitlens.llm import pages

from tests.llm.conftest import DATA


def article(page):
    """What the test pages' markup says, by plain cutting."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(p for p in parts if p)


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/pages.parquet")
    got = pages.extract_main_text(table).collect()
    want = {r.page_id: article(r.html) for r in table.collect()}
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_markup():
    page = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">ok?</div><nav>menu</nav>
      <main><h1>T &amp;\n x</h1><p>One<b>bold</b> two<br>three<p>Next &#233;<aside>side</aside><ul><li>a<li>b</ul>
      <form>f<input></form><div id="comments"><p>reader</p></div><script>"</p>"</script></main><footer>f</footer></body>"""
    assert pages.main_text(page) == "T & x\n\nOnebold two three\n\nNext é\n\na\n\nb"
    assert pages.main_text("a < b &lt; c") == "a < b < c"
    assert pages.main_text("<p>open <!-- never closed <p>x") == "open"
    assert pages.main_text("<p>one</p><p title=it's>two</p><p title = 'a>b'>three</p><p x=\"y>z\" checked>four</p>") == "one\n\ntwo\n\nthree\n\nfour"
    assert pages.main_text("<p>kept</p><a href=x") == "kept" and pages.main_text("<p>kept<script>x") == "kept"
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<style>p{}</style>") == ""
    assert pages.main_text("<p>" + "word " * 100_000).count("word") == 100_000


def test_low_entropy_branches_go(spark):
    rows = [(i, f"http://h.com/{i}", f"<div class=q9>Same words always</div><div class=z1><p>Text {i}</p></div>") for i in range(20)]
    rows += [(50, None, None), (51, "no host", ""), (52, "http://h.com/z", "<div class=q9>Same words always</div>"), (52, "http://h.com/z", "<div class=q9>Same words always</div>")]
    df = spark.createDataFrame([(*r, "extra", "x") for r in rows], "page_id long, url string, html string, noise string, host string")
    got = sorted((r.page_id, r.text) for r in pages.extract_main_text(df).collect())
    assert got[:20] == [(i, f"Text {i}") for i in range(20)]
    # A page is never emptied by entropy.
    assert got[20:] == [(50, ""), (51, ""), (52, "Same words always"), (52, "Same words always")]
    noise = pages.noise_paths(df).collect()
    assert [(r["host"], r["noise"]) for r in noise] == [("h.com", ["/div.q9"])]


def test_copies_are_no_noise(spark):
    """A site of nothing but copies keeps its text: importance is relative to the site's best."""
    df = spark.createDataFrame([(i, "http://c.org/", "<div class=a><p>Copy</p></div>") for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in pages.extract_main_text(df).collect()} == {"Copy"}


def test_list_of_copies_stays(spark):
    """Copies of one page on a mixed host keep what only they have, with a marked article or without."""
    page = "<{0}><h1>Copied</h1><p>Its text</p><ul><li>one</li><li>two</li></ul><blockquote>said</blockquote></{0}>"
    for tag in ("article", "div"):
        rows = [(i, f"http://m.org/{i}", f"<{tag}><h1>Title {i}</h1><p>Text {i}</p></{tag}>") for i in range(20)]
        rows += [(100 + i, f"http://m.org/c{i}", page.format(tag)) for i in range(8)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = {r.page_id: r.text for r in pages.extract_main_text(df).collect()}
        assert {got[100 + i] for i in range(8)} == {"Copied\n\nIts text\n\none\n\ntwo\n\nsaid"}
        assert got[3] == "Title 3\n\nText 3"


def test_entropy_takes_nothing_of_an_article():
    assert pages.main_text("<article><h2>Same</h2><p>Text</p></article>", frozenset(["/article/h2"])) == "Same\n\nText"


def test_marks_do_not_empty_a_page():
    text = "<h1>Title</h1><p>Main text of the page</p>"
    for wrapper in ('class="content no-sidebar"', "class=has-sidebar", 'class="layout-with-menu"', 'id="skip-target"', "class=widget"):
        assert pages.main_text(f"<div {wrapper}><article>{text}</article></div>") == "Title\n\nMain text of the page"
        assert pages.main_text(f"<div {wrapper}>{text}</div>") == "Title\n\nMain text of the page"
    assert pages.main_text(f"<form><main>{text}</main></form>") == "Title\n\nMain text of the page"
    inside = '<article><p>Text</p><section id="related-work"><p>Others</p></section><p class="notice">Mind this</p></article>'
    assert pages.main_text(inside) == "Text\n\nOthers\n\nMind this"
    assert pages.main_text("<nav>menu</nav><div class=sidebar>side</div><p>Text</p>") == "Text"


def test_only_navigation_is_empty():
    assert pages.main_text("<nav>menu</nav><footer>imprint</footer>") == ""
    assert pages.main_text("<nav><p>menu</p></nav><aside>side</aside><script>x</script>") == ""


def test_compound_class_names():
    """The last part names the thing, a first part what a holder holds; outside and inside of an article."""
    text = "<h1>Title</h1><p>Text of the page</p>"
    want = "Title\n\nText of the page"
    for name in ("site-footer", "post-comments", "cookie-banner", "ad-slot", "ads_wrapper", "main-nav", "comment-list", "newsletter-signup",
                 "sidebar-left", "ad-unit-2", "site-header", "related-posts", "share-buttons"):
        noise = f'<div class="x {name}"><p>noise of some words</p></div>'
        assert pages.main_text(f"<body><div>{text}</div>{noise}</body>") == want, name
        assert pages.main_text(f"<article>{text}{noise}</article>") == want, name
    for name in ("no-sidebar", "has-ads", "layout-with-menu", "skip-target", "related-work", "notice-of-meeting", "navigation-theory"):
        kept = f'<div class="{name}"><p>kept</p></div>'
        assert pages.main_text(f"<article>{text}{kept}</article>") == f"{want}\n\nkept", name


def test_hostile_markup_is_linear():
    """Unclosed tags, quotes, comments and deep nesting of a megabyte each."""
    for piece in ("<a ", "<", "<!--", "<p ", "<div>", "<font>x", "</p", "<script></script ", "<a b='", '<a b="', "<li>", "<p>x<b>", "&lt;", "<td>", "</div>", "<a ='\"", "<!"):
        page = "<p>Start</p>" + piece * (1_000_000 // len(piece))
        begin = time.perf_counter()
        blocks, children = pages.parse(page)
        assert time.perf_counter() - begin < 20 and blocks[0].text == "Start", piece
        assert max(map(len, children), default=0) < 2000


def test_a_teaser_is_not_the_page():
    teaser = "<article><p>Short card</p></article>"
    assert pages.main_text(f"<div><p>{'Long text of the page. ' * 9}</p></div>{teaser}").startswith("Long text")
    assert pages.main_text(f"<div>few</div>{teaser}") == "Short card"


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.extract_main_text(df).collect() == []
