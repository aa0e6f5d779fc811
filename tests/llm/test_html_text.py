import pytest

from grapheion.llm import html_text as h

CASES = [
    ("", ""),
    (None, ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b<br>c", "a b c"),
    ("<article><h1>T</h1><p>x <b>y</b>z &lt;&#233;&eacute;&nbsp; w</p></article><footer>f</footer>", "T x yz <éé w"),
    ("<nav>m</nav><div class='ad'>no</div><main><p>yes</p><form>q</form></main>", "yes"),
    ('<script>var t="</p><article>no</article>";</script><article>yes<style>p{}</style></article>', "yes"),
    ("<article><p>1 < 2 and 3 > 2</p><!-- <p>no</p> --></article>", "1 < 2 and 3 > 2"),
    ("<article><p>a</p><section id=comments><p>no</p></section><div class='reader-comments'>no</div></article>", "a"),
    ("<article class=comment>no</article><article>yes</article>", "yes"),
    ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table></article>", "a b c d e f g"),
    ("<article><p><b>bold<p>next</b></p> tail</article>", "bold next tail"),
    ("<article>a<script>x", "a"),
    ("<ARTICLE>Up<BR/>per</ARTICLE>", "Up per"),
    ("<div " * 3 + "x", "<div <div <div x"),
    ("<article><p hidden>no</p><p>yes</p></article>", "yes"),
]


@pytest.mark.parametrize("source,text", CASES)
def test_text_of(source, text):
    assert h.text_of(source) == text


def test_deep_nesting():
    assert h.text_of("<div>" * 5000 + "x" + "</div>" * 5000 + "y") == "x y"


def test_below_any_depth():
    deep = "<div>" * 3000
    assert h.text_of("<div><article>" + deep + "x" + "</div>" * 3000 + "<p>after</p></article></div><p>outside</p>") == "x after"
    assert h.text_of("<article>" + deep + "<nav>menu</nav><div class=ad>no</div>x" + "</div>" * 3000 + "</article>") == "x"
    root = h.parse("<article>" + deep + "x" + "</div>" * 3000 + "</article>")
    assert len(h.hash_subtrees(root)[0]) == 3000


def test_template_removal_by_recurrence(spark):
    rows = []
    for i in range(40):
        rows.append((i, f"http://a.org/{i}", f"<body><div><p>Our slogan</p></div><div><p>story {i}</p><p>end</p></div></body>", "x"))
        rows.append((100 + i, f"https://B.org:80/{i}", f"<article><p>tale {i}</p><div>Join us</div></article>" + "<p>Quoted</p>" * (i < 3), "x"))
        rows.append((200 + i, f"http://c.org/{i}", f"<div id=n{i}><p>the same copied story</p></div>", "x"))
    rows += [(300, None, None, "x"), (None, "odd", "<p>one</p>", "x"), (300, "http://a.org/0", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)
    got = {}
    for r in h.extract(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got[7] == ["story 7"]  # slogan and closing paragraph recur on every page
    assert got[107] == ["tale 7"] and got[101] == ["tale 1"]
    assert got[203] == ["the same copied story"]  # one article, copied: no template
    assert got[300] == ["", ""] and got[None] == ["one"]
    assert h.extract(pages.limit(0)).count() == 0


def test_counts_decide_over_names(spark):
    # furniture without telling names recurs; a telling name on one page of many is an honest block
    rows = []
    for i in range(30):
        rows.append((i, f"http://a.org/{i}", f"<div class=x1><p>Our slogan</p><p>All rights</p></div><div class=x2><h2>tale {i}</h2><p class=share>own words {i}</p></div>" + "<div class='notice side'><p>A stone fell at noon.</p></div>" * (i == 4)))
        rows.append((100 + i, f"http://b.org/{i}", f"<article><p>tale {i}</p></article><div class='ad box'>buy {i} now</div><article><section id=comments-{i}>reader {i}</section></article>"))
    rows.append((200, "http://c.org/", "<p>one</p><div class=ad>buy</div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert got[4] == "tale 4 A stone fell at noon."  # class "share" stands on every page, "notice" on one
    assert got[7] == "tale 7" and got[107] == "tale 7" and got[200] == "one"
    # the same pages with template removal off
    assert h.text_of(rows[14][2], frozenset()) == "Our slogan All rights tale 7 own words 7"
    assert h.text_of(rows[15][2], frozenset()) == "tale 7 reader 7"


def test_a_telling_name_on_few_of_many_articles_stays(spark):
    """A block is furniture by its share of the host, whatever the host's size."""
    rows = []
    for i in range(300):
        extra = "<div class='notice'><p>A stone fell at noon.</p></div>" * (i < 3) + f"<div class='side'><p>buy {i}</p></div>" * (i % 10 == 0)
        rows.append((i, f"http://a.org/{i}", f"<article><p>tale {i}</p>{extra}</article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert got[1] == "tale 1 A stone fell at noon." and got[0] == "tale 0 A stone fell at noon."
    assert got[10] == "tale 10" and got[7] == "tale 7"


def test_broken_markup_in_linear_time():
    import time

    for unit in ("<a ", "<a", "<div \"x\" ", "<!", "</x>", "<b><hr>", "<p><div><b><li>", "<a href='", "<a \"'"):
        for tail in ("", ">", "\">\"", "<p>end</p>"):
            source = unit * (1_000_000 // len(unit)) + tail
            began = time.time()
            h.text_of(source)
            assert time.time() - began < 30, (unit, tail)


def test_ends_table_equals_scan():
    import random

    rng = random.Random(2)
    for _ in range(500):
        source = "".join(rng.choice("ab>\"' ") for _ in range(30))
        table = h._Ends(source)
        table._tabulate()
        for at in range(30):
            scan = h._Ends(source)
            assert scan.find(at) == table.find(at)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(h, "BROADCAST_ROWS", -1)
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", f"<div><p>menu</p></div><p>s{i}</p>") for i in range(10)], "page_id long, url string, html string")
    assert sorted(r.text for r in h.extract(pages).collect()) == [f"s{i}" for i in range(10)]


def test_fixture_pages_give_the_article(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br|div|ul|li)[^>]*>", body)]
        assert got[r.page_id] == " ".join(p for p in parts if p)
