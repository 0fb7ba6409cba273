"""Main text of pages, and the minimum cut against all labellings."""

import itertools
import random

from pyspark.sql import functions as F

from aeolis.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>Site &mdash; x</title><style>p{color:red}</style><script>var a="</p><p>no";</script></head>
<body class="page"><header><p>Site header words that go on and on for quite a while here</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>
<div class="cookieBanner"><p>We use cookies to make the site better for everyone who reads it.</p></div>
<div id="main"><article><h1>Tide &amp; time</h1><p>The first  paragraph is <b>long</b>er,
and has a <a href="/x">link</a> in it.<p>Caf&eacute; 3 &lt; 4<br>next<!-- gone --> line</p>
<div class="ad"><p>Buy the thing now, it is a very good thing and costs little.</p></div>
<aside><p>Related: other things that we also wrote about in other years.</p></aside>
<ul><li>one item<li>two items</ul><form><label>Mail</label><input type=text></form>
<section id="comments"><p>I think that this is a wonderful piece of writing, thanks!</p></section></article></div>
<div class="sidebar"><p>Popular posts of this week and of the week before it.</p></div><footer>&copy; 2020 Site</footer></body></html>"""
TEXT = "Tide & time The first paragraph is longer, and has a link in it. Café 3 < 4 next line one item two items"


def test_page():
    assert pages.main_text(PAGE) == TEXT


def test_plain_page():
    """No article element, no closing tags."""
    words = "Some prose of the page that goes on for a number of words and then ends."
    assert pages.main_text(f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><p>{words}<p>{words}<div class=footer>Made by us") == f"{words} {words}"


def test_names_around_the_article():
    """Names of what an element has or allows, and flags on what holds the article, do not drop it."""
    words = "Some prose of the page that goes on for a number of words and then ends here. " * 3
    body, want = f"<h1>Tide</h1><p>{words}<p>{words}", " ".join(f"Tide {words} {words}".split())
    side = "<div class='sidebar'><p>Popular posts of this week and of the week before it.</div>"
    for start, end in (
        ("<main class='with-sidebar'>", "</main>"), ("<div id='page' class='has-sidebar'><article>", "</article></div>"), ("<article class='post category-legal comments-open'>", "</article>"),
        ("<div class='widget-page'><main class='side'><article class='post notice'>", "</article></main></div>"),
    ):
        assert pages.main_text(f"<body>{start}{body}{end}{side}") == want
    comments = "<section id=comments><p>I think that this is a wonderful piece of writing, thanks!</section>"
    assert pages.main_text(f"<body><article class='has-comments'>{body}{comments}</article>") == want
    assert pages.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be.</article>") == "Let x=1 be."


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p>x</p>" * 3000), (5, "u", "<script>alert(1)"), (6, "u", "a" * 100_000), (6, "u", "<article>" * 500 + "deep"), (7, "u", "<p title='>'>q</p><p a=\"b")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()]
    assert [(i, n) for i, _, n in got] == [(1, 0), (2, 0), (3, 0), (4, 5999), (5, 0), (6, 100_000), (6, 4), (7, 1)]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_minimum_cut():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 1.5) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5}
        value = lambda label: sum(g for g, x in zip(gain, label) if x) - sum(w for (i, j), w in edges.items() if label[i] != label[j])  # noqa: B023, E731
        best = max(value(x) for x in itertools.product((False, True), repeat=n))
        assert abs(value(pages.minimum_cut(gain, edges)) - best) < 1e-6


def bare(source):
    """A page without names of classes and elements that tell what a part is for."""
    import re

    return re.sub(r"<(/?)(?:article|nav|footer|aside|header|main|section)\b", r"<\1div", re.sub(r"\sclass=(?:\"[^\"]*\"|[^\s>]+)", "", source))


def test_classifier_without_names(spark):
    """Weights fitted on some pages find the text of others that have no names left, better than chance and than the whole page."""
    from collections import Counter

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    train = spark.createDataFrame([r for r in rows if r["page_id"] % 2])
    weights = pages.learn(train)
    assert weights != pages.STATED and len(weights) == len(pages.TRAITS)

    def f1(got, want):
        both = sum((Counter(got.split()) & Counter(want.split())).values())
        return 2 * both / (len(got.split()) + len(want.split()))

    scores, whole = [], []
    for r in rows:
        if r["page_id"] % 2 == 0:
            want = pages.main_text(r["html"], weights)
            scores.append(f1(pages.main_text(bare(r["html"]), weights), want))
            whole.append(f1(" ".join(b.text for b in pages.blocks_of(bare(r["html"])) if not b.hidden), want))
    assert sum(scores) / len(scores) > 0.97 and sum(scores) > sum(whole)


def test_stated_weights_where_nothing_is_named(spark):
    df = spark.createDataFrame([(1, "u", "<p>One.</p>"), (2, "u", None)], "page_id long, url string, html string")
    assert pages.learn(df) == pages.STATED and pages.learn(df.limit(0)) == pages.STATED


def test_text_of_other_elements():
    """Fallbacks and drawings within an article are text of it, outside they are not."""
    words = "Some prose of the page that goes on for a number of words and then ends here. " * 3
    page = f"<body><noscript>Please switch scripts on to see all of this page.</noscript><article><p>{words}<object>A map of the river.</object> <svg><title>no</title><text>North</text></svg> <noscript>As a table.</noscript></article>"
    assert pages.main_text(page) == " ".join(f"{words} A map of the river. North As a table.".split())


def test_supplied_pages(spark):
    """Every supplied page has its article in one element."""
    import html
    import re

    for r in pages.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^<>]*>", lambda m: " " if re.match(r"</?(?:p|h1|br)\b", m[0]) else "", inner)).split())
