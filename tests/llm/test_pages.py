"""Main text of hand-made and of all given pages."""

import html
import re

from pyspark.sql import functions as F

from nascent.llm import pages, queries

PAGE = """<!DOCTYPE html><html><head><title>No</title><script>if (a < b) "</p>"</script></head><body class="home">
<header><h1>Site</h1></header><div id="top-menu"><a href=x>Home</a> <a>News</a></div>
<div class="content"><h2>Head &amp; line</h2><p>First paragraph, with words.<br>And <b>more
  text</b> here, indeed.<p>Second one: it goes on and on, with words; and punctuation.<ul><li>one, two<li>three</ul></div>
<div class="sidebar"><p>Read this, it is long and has commas, too, so many of them.</p></div>
<div class="x"><a href=1>Foo</a> <a href=2>Bar</a></div><section id=comments><p>I like it, very much!</p></section>
<div style="display: none">Hidden, not seen.</div><form><p>Name, please.</p></form><!-- <p>old</p> --><footer>(c) me</footer>"""


def test_menus_bars_and_comments_are_left_out():
    assert pages.main_text(PAGE) == (
        "Head & line\n\nFirst paragraph, with words. And more text here, indeed.\n\n"
        "Second one: it goes on and on, with words; and punctuation.\n\none, two\n\nthree"
    )


def test_an_article_keeps_its_short_parts():
    page = "<body><div>Long outside text, with commas, and more, and so on, for a while.</div><article><header><h1>T</h1></header><p>a</p><p>b</article>"
    assert pages.main_text(page) == "T\n\na\n\nb"


LONG = "A sentence of the story, with commas, names and dates; it goes on for a good while, as such do. "
BOXED = f"""<body><div id=top>Home</div><main><header><h1>Title</h1></header><p>{LONG * 4}</p>
<div class="box1"><p>Buy now and save!</p></div><p>{LONG * 3}</p><ul><li><a href=1>Part one</a><li><a href=2>Part two</a></ul>
<section class="s"><h2>Next</h2><p>{LONG * 2}</p></section>
<div class="box2"><h3>More stories</h3><ul><li><a href=3>Cats win</a><li><a href=4>Dogs lose</a></ul></div></main></body>"""


def test_unmarked_boxes_inside_an_article_go_by_their_ratio():
    kept = ["Title", (LONG * 4).strip(), (LONG * 3).strip(), "Part one", "Part two", "Next", (LONG * 2).strip()]
    assert pages.main_text(BOXED) == "\n\n".join(kept)


def test_the_share_decides_inside_an_article():
    everything = pages.main_text(BOXED, pages.PathSettings(inside=0.0))
    assert "Buy now" in everything and "Cats win" in everything and "Home" not in everything
    only_links = "<main><p>Read this, it is the story.</p><div class=m><ul><li><a href=1>Cats win</a></ul></div></main>"
    assert pages.main_text(only_links, pages.PathSettings(inside=0.0)) == "Read this, it is the story."


def test_odd_pages(spark):
    cases = {
        None: "",
        "": "",
        "<p> \n </p>": "",
        "plain &lt;b&gt; text": "plain <b> text",
        "<p>a<br>b <b>c</b>d<!-- open": "a b cd",
        "<script>never closed": "",
        "</div></p>x": "x",
        "<p title='a > b'>y</p>": "y",
        '<p title="open>z': "z",
        "<div>" * 3_000 + "deep": "deep",
        "<p>" + "long, " * 50_000: ("long, " * 50_000).strip(),
    }
    rows = [(i, "u", h) for i, h in enumerate(cases)] + [(99, None, "<p>x"), (99, None, "<p>x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("own"))
    got = pages.extract(frame).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)] == [*cases.values(), "x", "x"]
    assert pages.extract(frame.limit(0)).count() == 0


def test_query_gives_the_article_of_every_page(spark, data):
    source = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = queries.QUERIES["op1_pages"](spark, data).collect()
    assert sorted(r.page_id for r in rows) == sorted(source)
    for r in rows:
        page = source[r.page_id].html
        inner = page[page.index("<article>") : page.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert (r.url, r.n_chars) == (source[r.page_id].url, len(r.text))
