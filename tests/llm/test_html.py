"""Main text of pages: a page built around known text gives it back."""

from html import escape

from lamella.llm import html, queries

LONG = "It was the best of times and it was the worst of times, and we had all of it before us as they say in the book. " * 3
FRAME = (
    '<!DOCTYPE html><head><title>T</title><script>var a="</p>";</script></head><body class="home"><header><p>Site of the day and of the year</p></header>'
    '<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies and so do you.</div>{}'
    '<div id="comments"><p>' + LONG + '</p></div><aside>By the way</aside><form>Name <input></form><footer>&copy; x</footer></body></html>'
)


def test_articles_and_plain_pages():
    article = "<article><h1>A  title\n&amp; more</h1><p><b>One<br>two<br><p>" + escape(LONG) + "<p>Short.</article>"
    assert html.main_text(FRAME.format(article)) == "A title & more\nOne two\n" + LONG.strip() + "\nShort."
    plain = f"<div><h2>Heading</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><ul><li><a href=x>link</a><li><a href=y>link</a></ul></div>"
    assert html.main_text(FRAME.format(plain)) == "\n".join(["Heading", LONG.strip(), "Short one.", LONG.strip()])


def test_odd_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>a</nav>") == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text("<article>3 < 5 &lt;b&gt; <x") == "3 < 5 <b>"
    assert html.main_text("<article><p>a&nbsp; b<script>c") == "a b"
    assert html.main_text("<article><!-- x --><p title='a > b'>y</p><div class='ad'>z</div></article>") == "y"
    deep = "<div>" * 50_000 + "<article><p>x" + "<b>" * 50_000
    assert html.main_text(deep) == "x"
    assert html.main_text("<article>" + "<" * 200_000) .startswith("<")
    assert html.main_text("<article>" + '<a b="' * 20_000 + "x") is not None


def test_query(spark, tmp_path):
    rows = [(1, "u", FRAME.format("<article><p>é 😀 x</p></article>"), "clash"), (2, None, None, ""), (2, None, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, queries.op4_html(spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, "u", "é 😀 x", 5), (2, None, "", 0), (2, None, "", 0)]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    text = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        for drop in ("<h1>", "</h1>", "<b>", "<p>", "</p>", "<br>"):
            body = body.replace(drop, "\n")
        assert text[r.page_id].split() == html.unescape(body).split()


def test_rules_inside_articles_and_time_in_proportion():
    import time

    table = "alpha 1 2 3 beta 4 5 6 gamma 7 8 9 delta 10 11 12 epsilon 13 14 15 zeta 16 17 18"
    links = "<p><a href=x>" + "more of the same " * 8 + "</a></p>"
    assert html.main_text(f"<article><p>{LONG}</p><pre>{table}</pre>{links}<pre>{table}</pre></article>") == "\n".join([LONG.strip(), table, table])
    assert html.main_text(f"<article><div class='side-by-side'><p>{LONG}</p></div><p class='legal'>It is the law.</p><math><mi>x</mi></math></article>") == LONG.strip() + "\nIt is the law.\nx"
    assert html.main_text(f"<main><p>{LONG}</p><object><p>Short one.</p></main>") == LONG.strip() + "\nShort one."
    for page in ("<div>" * 100_000 + "</b>" * 100_000, "<div><p><b>" * 60_000, "<b><i></b></i>" * 50_000):
        start = time.time()
        html.main_text(page)
        assert time.time() - start < 10
