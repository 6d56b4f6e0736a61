import html
import re

from nearlabel.llm import queries, wrappers


def plain(page):
    """The article of the tables' pages, cut out by hand: blocks begin at h1 and p."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"<(?:h1|p)>|</(?:h1|p)>", body)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op5_wrappers(spark, sf).collect()
    assert {r.page_id: r.text for r in rows} == {k: plain(v) for k, v in pages.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_inference():
    t = lambda page: tuple("#" if k == "#" else k + x for k, _, x in wrappers.stream(page))
    one = wrappers.fold(t("<ul><li>a<li>b<li>c</ul><p>x"))
    assert one == ("<ul", ("+", ("<li", "#", ">li")), ">ul", "<p", "#", ">p")
    other = wrappers.fold(t("<ul><li>a</ul><div class='ad'>y</div><p>x<p>z"))
    both = wrappers.infer([one, other])
    assert both == ("<ul", ("+", ("<li", "#", ">li")), ">ul", ("?", ("<div!", "#", ">div!")), ("+", ("<p", "#", ">p")))
    assert wrappers.slots(both) == {("ul", "li"), ("div!",), ("p",)}
    assert wrappers.infer([both, one, other]) == both


PAGES = [
    (1, "http://a.example/x", "<nav>menu</nav><main><h1>T&amp;t</h1><p>one<br>two <b>three</b><aside>no</aside><div id=comments><p>bad</div></main><footer>f</footer>", "T&t\none two three"),
    (2, "http://A.example/y", "<main><p>only &lt;text&gt;\n now</main><div class='cookie-notice'>no</div>", "only <text> now"),
    (3, "https://b.example/", "<div class='menu'>m</div><div><p>story &nbsp; here</p></div><form>f</form><script>var a='</p>';</script>", "story here"),
    (4, None, None, ""), (5, "", "", ""), (6, "x", "bare text <", "bare text <"), (7, "http://a.example", "<main>" + "<p>w</p>" * 20000, "\n".join(["w"] * 20000)),
    (8, "http://c.example", "<title>no</title><body><p>unclosed <!-- x", "unclosed"), (1, "http://a.example/x", "<p>outside</p><main>in</main>", "in"),
]


def test_odd_pages(spark, monkeypatch):
    df = spark.createDataFrame([(*p[:3], "clash") for p in PAGES], "page_id long, url string, html string, main_text string")
    for hosts in (wrappers.HOSTS, 0):
        monkeypatch.setattr(wrappers, "HOSTS", hosts)
        assert sorted((r.page_id, r.main_text) for r in wrappers.main_text(df).collect()) == sorted((p[0], p[3]) for p in PAGES)
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_wrapper_decides(spark):
    """Constant slots are template, an article container of template alone is no article, and a page without the host's
    article branch keeps its text."""
    rows, want = [], {}
    for i in range(4):
        rows += [(f"http://a.example/{i}", f"<div>All rights kept</div><div><h1>Title {i}</h1><p>Story {i} one<p>Story {i} two</div>")]
        want[rows[-1][0]] = f"Title {i}\nStory {i} one\nStory {i} two"
        rows += [(f"http://b.example/{i}", f"<main><p>Skip to content</main><section><p>Text {i}</section>")]
        want[rows[-1][0]] = f"Text {i}"
        rows += [(f"http://c.example/{i}", f"<article><h1>Heading</h1><p>Text {i}</article><p>other")]
        want[rows[-1][0]] = f"Heading\nText {i}"
        rows += [(f"http://d.example/{i}", "<div>Same</div><p>page")]
        want[rows[-1][0]] = "Same\npage"
    rows += [("http://c.example/9", "<div><p>No article here</div><p>other")]
    want[rows[-1][0]] = "No article here"
    df = spark.createDataFrame(rows, "url string, html string")
    for n in (1, 5):
        assert {r.url: r.main_text for r in wrappers.main_text(df.repartition(n)).collect()} == want


def test_containers_lose_no_article():
    """Class names count as a whole, never for the page, its main part or an article around or below; an empty svg is empty."""
    keep = [
        "<body class='has-sidebar'><p>text</p></body>",
        "<html class='menu'><body class='nav'><p>text</p></body></html>",
        "<main class='content no-sidebar'><p>text</p></main>",
        "<main class='comments'><p>text</p></main>",
        "<article class='post comments-open'><p>text</p></article>",
        "<div id='social-policy'><p>text</p></div>",
        "<div class='social'><main><p>text</p></main></div>",
        "<div class='menu'><div role='main'><p>text</p></div></div>",
        "<div class='banner'><article><p>text</p></article></div>",
        "<p>text</p><div class='cookie-notice'>no</div><div class='x sidebar'>no</div><div role=search>no</div>",
        "<main><p>text</p><div class='comments'><article>no</article></div></main>",
        "<svg class='a>b' width=1 />text",
        "<svg/><p>text</p><svg><title>no</title></svg>",
    ]
    assert [wrappers.extract(p) for p in keep] == ["text"] * len(keep)


def test_template_without_names(spark):
    """Menus and remarks that no tag or name tells apart from the article go, because they are the same on all pages; a
    host's wrapper decides that, and a page alone keeps them."""
    rows = [(f"http://h.example/{i}", f'<div class="hd">Site menu</div><div class="b"><h1>Title {i}</h1><p>Text {i}.</div><div class="rr">Reader says hi</div>') for i in range(30)]
    df = spark.createDataFrame([*rows, ("http://one.example/", rows[0][1])], "url string, html string")
    got = {r.url: r.main_text for r in wrappers.main_text(df).collect()}
    assert all(got[f"http://h.example/{i}"] == f"Title {i}\nText {i}." for i in range(30))
    assert got["http://one.example/"] == "Site menu\nTitle 0\nText 0.\nReader says hi"
