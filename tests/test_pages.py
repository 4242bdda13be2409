"""Articles, crawls, suggestions, facets and two-digit years against plain versions."""

import random
import re
from datetime import date
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from marquee.functions import dates
from marquee.operators import aggregate, ranking
from marquee.operators.postings import Postings
from marquee.sources import articles, frontier

PAGE = """<html><head><title>Head &amp; title</title>
<meta property="og:title" content="The  Title"><meta name="author" content="Ann Lee"><meta property="article:published_time" content="2021-03-04T10:00:00Z">
</head><body><nav>menu</nav><article><h1>Heading</h1><p>One <b>two</b><p>three<div>four<article>five</article></div><aside>side</aside></article><footer>end</footer></body></html>"""


def test_metadata_first():
    assert articles.read_page(PAGE) == ("Heading One two three four five", "The Title", "Ann Lee", date(2021, 3, 4))


@pytest.mark.parametrize(
    "html,expected",
    [
        (None, ("", None, None, None)),
        ("", ("", None, None, None)),
        ("plain & text", ("plain & text", None, None, None)),
        ("<main>a<nav>b</main><p>c", ("a", None, None, None)),
        ("<div><nav><ul><li>menu</div><p>kept", ("kept", None, None, None)),
        ("<nav>x<nav>y</nav>z</nav>kept<br/>more", ("kept more", None, None, None)),
        ("<h1>Only <i>one</i></h1><time datetime='2020-02-30'></time><time datetime='2020-02-29T01:02'>", ("Only one", "Only one", None, date(2020, 2, 29))),
        ('<p>by <a rel="author" href="/x">Bo  Li</a> now', ("by Bo Li now", None, "Bo Li", None)),
        (
            '<script type="application/ld+json">{"@graph": [{"headline": "H", "author": [{"name": "A"}, "B"], "datePublished": "1999-12-31"}]}</script>x',
            ("x", "H", "A, B", date(1999, 12, 31)),
        ),
        ('<script type="application/ld+json">{broken</script><script>var a="</p>"</script>x', ("x", None, None, None)),
        ("</p></div>x</span>", ("x", None, None, None)),
    ],
)
def test_pages(html, expected):
    assert articles.read_page(html) == expected


class Plain(HTMLParser):
    """Depth counters instead of open elements; right where every element is closed."""

    def __init__(self):
        super().__init__()
        self.depth, self.inside, self.text = 0, 0, {True: "", False: ""}

    def handle_starttag(self, tag, attrs):
        self.text = {k: v + " " for k, v in self.text.items()}
        self.depth += tag in articles.FURNITURE
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        self.text = {k: v + " " for k, v in self.text.items()}
        self.depth -= tag in articles.FURNITURE
        self.inside -= tag == "article"

    def handle_data(self, data):
        if not self.depth:
            self.text[True] += data if self.inside else ""
            self.text[False] += data


@pytest.mark.parametrize("seed", range(30))
def test_nested_elements_against_a_plain_parser(seed):
    rng = random.Random(seed)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["word", "two words ", "&amp;", "é"])
        tag = rng.choice(["div", "p", "nav", "aside", "article", "article", "b", "form"])
        return f"<{tag}>" + "".join(made(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    html = "".join(made(5) for _ in range(4))
    plain = Plain()
    plain.feed(html)
    plain.close()
    one = {k: re.sub(r"\s+", " ", v).strip() for k, v in plain.text.items()}
    assert articles.read_page(html)[0] == (one[True] or one[False])


def test_articles_as_a_table(spark):
    pages = spark.createDataFrame([(1, PAGE, "x"), (1, None, "x"), (None, "<p>a", "x")], "id long, h string, key string")
    got = articles.read_articles(pages, "id", "h")
    assert got.columns == ["id", "text", "title", "author", "published"]
    assert sorted(map(repr, (tuple(r)[:2] for r in got.collect()))) == sorted(map(repr, [(1, "Heading One two three four five"), (1, ""), (None, "a")]))
    assert articles.read_articles(pages.where("false"), "id", "h").count() == 0


def test_references_without_a_semicolon_are_text():
    """Titles are cut within references; script data is no text with references."""
    html = """<title>A &amp;&amp; b&amp</title><meta name=author content="C &amp D"><body>x&nbsp;&lt y &#39;z&#39 &copy2 &amp;lt; &
        <script type="application/ld+json">{"headline": "q & r &amp s &amp; t"}</script>"""
    text = "A && b&amp x &lt y 'z&#39 &copy2 &lt; &"
    assert articles.read_page(html) == (text, "q & r &amp s &amp; t", "C &amp D", None)
    assert articles.read_page("<title>A&amp;&amp</title>")[1] == "A&&amp"


def test_links_are_resolved(spark):
    base = "https://Ex.org/a/b.html?q=1"
    hrefs = ["/x", "c.html", "//h.net/y#z", "http://k.io/", "#top", "mailto:a@b.c", "?p=2", "d/e"]
    html = "".join(f"<a class=l href='{h}'><b>n</b> {i}</a>" for i, h in enumerate(hrefs)) + '<a name="n">no</a>'
    links = frontier.page_links(spark.createDataFrame([(base, html)], "u string, h string"), "u", "h").collect()
    folder = "https://Ex.org/a"
    assert [r.target for r in links] == ["https://Ex.org/x", f"{folder}/c.html", "https://h.net/y", "http://k.io/", f"{folder}/?p=2", f"{folder}/d/e"]
    assert links[0].anchor == "n 0"


def slow_crawl(links, pages, seeds, max_depth, max_pages, least, same_host):
    host = lambda u: re.sub(r"^.*?://([^/?#]*).*$", r"\1", u).lower()
    taken = [(s, 0, None) for s in dict.fromkeys(seeds) if s in pages][:max_pages]
    hosts = {host(p) for p, _, _ in taken}
    level = [p for p, _, _ in taken]
    for depth in range(1, max_depth + 1):
        best = {}
        for s, t, score in links:
            if s in level and t in pages and t not in {p for p, _, _ in taken} and score >= least and (not same_host or host(t) in hosts):
                best[t] = max(best.get(t, score), score)
        chosen = sorted(best.items(), key=lambda x: (-x[1], x[0]))[: max_pages - len(taken)]
        taken += [(t, depth, score) for t, score in chosen]
        level = [t for t, _ in chosen]
    return sorted(map(repr, taken))


@pytest.mark.parametrize("seed", range(4))
def test_crawl_against_brute_force(spark, seed):
    rng = random.Random(seed)
    urls = [f"http://{rng.choice('ab')}.org/{i}" for i in range(40)]
    links = [(rng.choice(urls), rng.choice(urls), rng.randint(0, 4)) for _ in range(150)]
    pages, seeds = set(urls[5:]), [urls[3], urls[7], urls[9], urls[7]]
    table = spark.createDataFrame(links, "source string, target string, score int")
    known = spark.createDataFrame([(u,) for u in pages], "page string")
    for depth, most, least, same in ((0, 10, 0, True), (3, 9, 1, True), (6, 100, 2, False), (2, 1, 0, True)):
        got = frontier.best_first(table, known, seeds, max_depth=depth, max_pages=most, least=least, same_host=same)
        assert sorted(repr(tuple(r)) for r in got.collect()) == slow_crawl(links, pages, seeds, depth, most, least, same)


def test_suggestions_are_read_by_key(spark, tmp_path):
    names = ["Red ring", "red Ring", "bored", "Redo", "re", "r", "", "Éclair", "a.b", None, "predator", "Red ring"]
    table = spark.createDataFrame([(n,) for n in names], "n string")
    posted = Postings.build(table, "n", f"{tmp_path}/p", buckets=8)
    for typed in ("re", "RED", "r", "red ring", "écl", ".b", "zzz", "", "o", "edat"):
        scan = ranking.suggest(table.where("n is not null").distinct(), "n", typed, 5)
        assert [tuple(r) for r in posted.suggest(spark, typed, 5).collect()] == [tuple(r) for r in scan.collect()]
    plan = posted.suggest(spark, "red", 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("IsNotNull", "isnotnull") and "EqualTo(gram,red)" in plan


def test_facets_keep_their_top_values(spark):
    rows = spark.createDataFrame([(["a", "b", "b"], "x"), (["a", None], None), (None, "x")], "t array<string>, k string")
    got = aggregate.facets(rows, {"tags": F.col("t"), "kind": F.col("k")}, {"tags": 1})
    assert sorted(map(tuple, got.collect())) == [("kind", "x", 2), ("tags", "a", 2)]
    assert "WindowExec" not in got._jdf.queryExecution().toString() and "TakeOrderedAndProject" in got._jdf.queryExecution().toString()


def test_two_digit_years_turn_after_50(spark):
    years = spark.createDataFrame([(f"3/4/{y:02d}",) for y in (50, 51, 68, 69, 0, 99)], "t string")
    assert [r[0].year for r in years.select(dates.parse_date(F.col("t"))).collect()] == [2050, 1951, 1968, 1969, 2000, 1999]
