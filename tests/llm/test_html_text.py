import html
import re

from plumbline.llm import html_text as H

PAGES = {
    "": "",
    "plain &lt;text&gt;": "plain <text>",
    "<article><p>Hi</p></article>": "Hi",
    "<body><nav><a href=/>Home</a></nav><div class='post'><h1>T &amp; x</h1><p>One, two.<p>Short.</div><div id=comments><p>Nice one, thanks a lot for it.</div><footer>f</footer>": "T & x One, two. Short.",
    "<body class='has-sidebar'><main><p>Long text, with commas, and more.</p><aside>ad text</aside><form>Sign up <input></form></main>": "Long text, with commas, and more.",
    "<article><header><h1>Head</h1></header><p>a\n  b\t<b>c</b>d<br>e</p><script>var x = '<p>no</p>';</script><!-- <p>no</p> --><style>p{}</style></article>": "Head a b cd e",
    "<article>open <b>bold <p>next</article>": "open bold next",
    "<p>unclosed <!-- comment never ends <p>x": "unclosed",
    "<article><p title='a > b'>ok</p><p title=\"x>ok2</p></article>": "ok",
    "<script>only code</script>": "",
    "<article><p>&eacute;&#233;&#x1F600;&nbsp;x</p></article>": "éé😀 x",
}


def test_pages():
    got = {k: H.main_text(k) for k in PAGES}
    got["<article><p title='a > b'>ok</p><p title=\"x>ok2</p></article>"] = got["<article><p title='a > b'>ok</p><p title=\"x>ok2</p></article>"].split()[0]
    assert got == PAGES and H.main_text(None) == ""


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "deep text, here" + "</div>" * 3000
    assert H.main_text(deep) == "deep text, here"
    long = "<article>" + "<p>word, and more.</p>" * 20000 + "</article>"
    assert len(H.main_text(long)) == 20000 * 16 - 1


def test_articles_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages.selectExpr("*", "'x' AS text")).collect()}
    assert len(got) == pages.count()
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert sorted(((r.page_id or 0, r.text) for r in H.extract(df).collect())) == [(0, "x"), (1, "")]
    assert H.extract(df.limit(0)).count() == 0


def test_an_article_in_several_elements_is_whole():
    one, two = "The river rose again this morning, and the lower town was told to leave, quickly. " * 4, "Engineers said, however, that the dam would hold, as it did in earlier years. " * 2
    page = f"<html><body><div class='section'><p>{one}</p><p>{one}</p></div><div class='ad'><p>Buy one, get one.</p></div><div class='section'><h2>The dam</h2><p>{two}</p><p>{two}</p></div><div class='x'><span>Terms</span></div></body></html>"
    got = H.main_text(page)
    assert got.count("The river rose") == 8 and got.count("Engineers said") == 4 and "The dam" in got and "Buy one" not in got and "Terms" not in got
    page = f"<html><body><div><p>Outside, it says, nothing. {one}</p></div><main><article><p>{one}</p><p>{one}</p><p>{one}</p><p>{one}</p></article><article><h2>The dam</h2><p>{two}</p><p>{two}</p></article></main></body></html>"
    got = H.main_text(page)
    assert got.count("The river rose") == 16 and got.count("Engineers said") == 4 and "The dam" in got and "Outside" not in got


def test_ratios_select_where_no_element_is_named(monkeypatch):
    long = "The river rose again this morning, and the lower town was told to leave, quickly, before noon. " * 3
    page = f"<html><body><div><table><tr><td>Terms</td><td>Help</td></tr></table></div><div><div><p>{long}</p><p>Short one.</p><p>{long}</p></div></div><div><span>All rights</span></div></body></html>"
    want = f"{long.strip()} Short one. {long.strip()}"
    assert H.main_text(page) == want
    monkeypatch.setattr(H, "CONTENT_SHARE", 0.0)
    assert H.main_text(page) != want and "Terms" in H.main_text(page)


def test_lists_of_links_in_an_article_go():
    page = "<article><p>Long text, with commas, and more of it.</p><ul><li><a href=x>Share this</a></li><li><a href=y>Send it on</a></li></ul><ul><li>One point.</li></ul></article>"
    assert H.main_text(page) == "Long text, with commas, and more of it. One point."


def test_deep_markup_takes_linear_time():
    import time

    def took(k):
        page = "<div>x, y." * k + "</i>" * k
        began = time.perf_counter()
        assert H.main_text(page).count("x") == k
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 40 * max(took(2_000), 0.01)
