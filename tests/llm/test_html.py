import re
import time
from collections import Counter
from html import unescape

from pyspark.sql import functions as F

from plumage.llm import html


def test_op10_gives_the_articles(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = html.op10(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    changed = [sum(r[c] > 0 for r in got) for c in ("n_templates", "n_ruled")]
    assert changed[0] > 10, changed


def test_templates_are_what_recurs_by_plain_counting(spark, small):
    rows = [(r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    pages, found = {}, {r.host: set(r.template) for r in html.templates(spark.read.parquet(f"{small}/pages.parquet")).collect()}
    names = spark.createDataFrame([(u,) for u, _ in rows], "url string").select("url", F.xxhash64(html.host("url")).alias("h")).distinct().collect()
    host = {r.url: r.h for r in names}
    for url, text in rows:
        page = html.Page(text)
        pages.setdefault(host[url], {})[page.text()] = page.subtrees()  # copies once
    want = {}
    for h, own in pages.items():
        n = Counter(k for keys in own.values() for k in keys)
        much = {k for k, c in n.items() if c >= (3 if k & 1 else 10) and c >= (0.05 if k & 1 else 0.5) * len(own)}
        if much:
            want[h] = {html._signed(k) for k in much}
    assert found == want and want


def test_hostile_pages_are_read_in_linear_time():
    start = time.time()
    for text in ("<a x" * 250_000, "<a b='" * 160_000, "<i>" * 100_000 + "<li>" * 100_000, "<script></script x" * 50_000, "<header>" * 50_000 + "<h1>" * 50_000, "<!" * 400_000, "</p " * 250_000):
        html.Page(text).text()
    assert time.time() - start < 30


def test_rules():
    page = html.Page(
        '<html><body class="has-sidebar"><header><h1>Site</h1></header><main><article><header class="x"><h1>T &amp; x</h1><p>by me</p></header>'
        '<p>One<b>two</b><div class="share">s</div><p>Three\n <span class="ad">buy</span>four<ul><li>a<li>b</ul>'
        '<section id="comments"><p>no</p></section><script>if (a < b) { "</p>" }</script><!-- x > --><form><p>f</p></form></article></main><footer>f</footer>'
    )
    assert page.text() == "T & x\n\nOnetwo\n\nThree four\n\na\n\nb"
    assert html.Page("no tags &lt;").text() == "no tags <"
    assert html.Page("<div><nav>m</nav><p>a <p>b").text() == "a\n\nb"
    assert html.Page("<p>a<b don't t='>'>b</b></p><p>c < d</p></p x='>e").text() == "ab\n\nc < d\n\ne"
    assert html.Page("a <!-- b").text() == "a" and html.Page("").text() == ""


def test_no_text_is_lost_beside_a_teaser_or_by_one_word_of_a_name():
    assert html.Page("<div><p>Main story</p></div><article>teaser</article>").text() == "Main story\n\nteaser"
    assert html.Page("<div>by</div><article>the story</article>").text() == "the story"
    for name in ('class="share-price"', 'class="post-header x"', 'id="notice-board"', "class='layout with-sidebar'", "class", 'class="widgetry"'):
        assert html.Page(f"<article><p>one</p><div {name}><p>two</p></div></article>").text() == "one\n\ntwo", name
    for name in ('class="share"', 'class="wide social-share-buttons"', 'id="comments-area"', 'class="ad_slot-2"', 'class="Site-Footer"', "class=related-posts"):
        assert html.Page(f"<article><p>one</p><div {name}><p>two</p></div></article>").text() == "one", name


def test_templates(spark):
    url = "http://h.example/%d"
    box = "<div><b>Our house</b> style</div>"
    rows = [(i, url % i, f"<body>{box}<p>text number {i}</p></body>", "t") for i in range(12)]
    rows += [(100 + i, url % i, f"<body>{box}<article><h1>Same</h1><p>copy</p></article></body>", "t") for i in range(40)]
    rows += [(200, "http://other.example/", f"<body>{box}<p>x</p></body>", "t"), (201, None, None, "t"), (202, None, box, "t"), (None, "bad", "<p>" + "y " * 100_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, template string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert all(got[i] == f"text number {i}" for i in range(12))  # the box recurs on the host's pages
    assert all(got[100 + i] == "Same\n\ncopy" for i in range(40))  # copies of one page are no template
    assert got[200] == "Our house style\n\nx" and got[201] == "" and got[202] == "Our house style" and len(got[None]) == 199_999
    assert html.main_text(df.limit(0)).count() == 0
