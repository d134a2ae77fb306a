"""HTML reading, selectors and extraction rules."""

import pytest
from pyspark.sql import functions as F

from webloom.operators import extract as E
from webloom.operators import nodes as P
from webloom.operators.select import css, select, xpath

HTML = ('<!DOCTYPE html><html><head><title>A &amp; B</title><script>var t="</p>";</script></head><body>'
        '<div id="main" class="box wide"><p>One<br>two</p><p class="x">Three <b>bold</b></p></div>'
        '<ul><li><a href="/a?k=v%201&amp;z=2">First</a></li><li><a href="http://o.org/b">Second</a></li><li>bare</li></ul></body></html>')


@pytest.fixture(scope="module")
def trees(spark):
    return P.page_nodes(spark.createDataFrame([(1, "http://s.com/x", HTML)], "page_id long, url string, html string"))


def test_tree():
    nodes = P.parse_page(HTML)
    by_tag = {n["tag"]: n for n in nodes}
    assert by_tag["html"]["end_node"] == len(nodes)
    assert by_tag["br"]["end_node"] == by_tag["br"]["node"] + 1
    assert by_tag["script"]["end_node"] == by_tag["script"]["node"] + 1
    assert [n["text"] for n in nodes if n["tag"] == P.TEXT][:3] == ["A & B", "One", "two"]


def test_closing_tag_reaches_back_twenty_tags():
    near, far = "<div>" + "<br>" * 19 + "</div>x", "<div>" + "<br>" * 20 + "</div>x"
    assert P.parse_page(near)[0]["end_node"] == 20
    assert P.parse_page(far)[0]["end_node"] == 1


@pytest.mark.parametrize("body", ["", "plain", "<", "<a", "<!-- open", "</p></p>", "<script>never closed", "<p a=1 a=2 b='x>y'>t"])
def test_broken_html_is_read(body):
    P.parse_page(body)


@pytest.mark.parametrize("selector, tags", [
    ("p", ["p", "p"]), ("div > p.x", ["p"]), ("#main b", ["b"]), ("div.box.wide", ["div"]), ("body > p", []), ("ul a[href^='/a']", ["a"]),
    ("title, b", ["title", "b"]), ("ul > *", ["li", "li", "li"]), ("a[href]", ["a", "a"]), ("li a[href$='b']", ["a"])])
def test_css(trees, selector, tags):
    found = F.transform(select(F.col("nodes"), selector), lambda p: F.get(F.col("nodes"), p["node"])["tag"])
    assert trees.select(found.alias("t")).first()["t"] == tags


def test_invalid_selectors():
    for bad in ("", "p >", "p:hover", "div,,p"):
        with pytest.raises(ValueError):
            css(bad)
    with pytest.raises(ValueError):
        xpath("//a[position()<3]")


def record(trees, steps, items=None):
    rows = E.extract_records(trees, E.Extraction({"v": steps}, items=items)).orderBy("record").collect()
    return [r["v"] for r in rows]


def test_steps(trees):
    assert record(trees, "title") == ["A & B"]
    assert record(trees, "li a") == ["First,Second"]
    assert record(trees, ["li a", "first()", "@href"]) == ["/a?k=v%201&z=2"]
    assert record(trees, ["li a", "@href", "query-param(k)"]) == ["v 1"]
    assert record(trees, ["p.x", "/Three (\\w+)/"]) == ["bold"]
    assert record(trees, ["p.x", "s/Three/3/", "prepend(#)", "append( !)"]) == ["#3 bold !"]
    assert record(trees, ["#main", "first()", "/<b>([a-z]+)/"]) == [None]
    assert record(trees, "table") == [None]


def test_inner_html_is_read_when_there_is_no_value(trees):
    assert record(trees, ["/<b>(\\w+)</b>/"]) == ["bold"]


def test_items_strict_and_lax(trees):
    fields = {"name": "a", "link": ["a", "@href"]}
    strict = E.extract_records(trees, E.Extraction(fields, items="li"))
    assert [r["name"] for r in strict.orderBy("record").collect()] == ["First", "Second"]
    lax = E.extract_records(trees, E.Extraction({"name": "a", "rest": "/bare/"}, items="li", strict=False))
    assert [r["rest"] for r in lax.orderBy("record").collect()] == [None, None, "bare"]


def test_xpath_items(trees):
    rows = E.xpath_block(trees, "//ul/li", {"name": "/a/text()", "url": "//a"}).orderBy("record").collect()
    assert [(r["record"], r["name"], r["url"]) for r in rows] == [(0, "First", "/a?k=v%201&z=2"), (1, "Second", "http://o.org/b")]
    second = E.xpath_block(trees, "//ul/li[2]", {"name": "/a"}).collect()
    assert [r["name"] for r in second] == ["Second"]


def test_allow_list(trees):
    clean = P.sanitize_html(trees, {"p": ("class",), "b": ()}).first()["clean"]
    assert '<p>Onetwo</p><p class="x">Three <b>bold</b></p>' in clean and "<a" not in clean


def test_links_in_every_attribute_form(spark):
    from webloom.operators import links

    html = ("<a href='/x'>1</a><a href=/y class=q>2</a><A HREF = \"/z\">3</A><a data-href=\"/no\" title='a > b' href=\"/w&eacute;?a=1&amp;b=&#233;&#x1F600;&nope;\">"
            "4</a><a name=top>5</a><a href>6</a><abbr href='/no'>7</abbr><a title=\"href='/no'\" href=/v/>8</a><!-- <a href='/c'> --><a href=\"/unclosed>")
    pages = spark.createDataFrame([(1, "http://h.org/p", html), (2, "http://h.org/q", "<base href='/b/'><a href=r>" + "<a x" * 2000)], "page_id long, url string, html string")
    got = [(r["page_id"], r["href"]) for r in links.raw_links(pages).orderBy("page_id", "pos").collect()]
    assert got == [(1, "/x"), (1, "/y"), (1, "/z"), (1, "/wé?a=1&b=é😀&nope;"), (1, ""), (1, "/v/"), (2, "r")]
    assert [r["link"] for r in links.raw_links(pages.filter("page_id = 2")).collect()] == ["http://h.org/b/r"]


def test_links_equal_those_of_the_page_tree(spark):
    from pyspark.sql import functions as F

    from tests.conftest import FOLDER
    from webloom.operators import links, nodes
    from webloom.plans.registry import Tables
    from webloom.plans.url_plans import mixed

    pages = mixed(Tables(spark, FOLDER)).filter("page_id < 40")
    anchors = nodes.node_rows(nodes.page_nodes(pages)).filter("tag = 'a'").select("page_id", F.try_element_at("attrs", F.lit("href")).alias("href")).filter("href is not null")
    count = lambda df: sorted(map(tuple, df.groupBy("page_id", "href").count().collect()))
    assert count(anchors) == count(links.raw_links(pages).select("page_id", "href"))


def test_broken_links_meet_in_canonical_form(spark):
    from webloom.operators import links

    pages = spark.createDataFrame([(1, "http://h.org/p", "<a href='HTTP://h.org/a'></a><a href=/b#x><a href=/c>")], "page_id long, url string, html string")
    answers = spark.createDataFrame([("http://H.org:80/b", 200), ("http://h.org/c", 404)], "url string, status int")
    got = {r["link"]: r["status"] for r in links.broken_links(pages, answers).collect()}
    assert got["http://h.org/c"] == 404 and "http://h.org/b" not in got


def test_names_must_not_be_blank(spark):
    import pytest

    from webloom.operators import links

    known, fresh = (spark.createDataFrame(rows, "name string") for rows in ([("A",)], [("a",), (" ",)]))
    with pytest.raises(Exception, match="a row has no name"):
        links.upsert_dimension(known, fresh, "name").collect()


def test_status_map_has_every_status(spark):
    from webloom.operators import fetchlog

    log = spark.createDataFrame([(1, k, k, s) for k, s in enumerate([200, 404, 403, 200, 599])], "site int, event_id long, ended long, status int")
    last = fetchlog.running_status_map(log).orderBy("ended").collect()[-1]
    assert last["requests_by_status"] == {200: 2, 404: 1, 403: 1, 599: 1}


SELECTED = ("<div id=top class='a b'><ul><li>1</li><li class=x>2</li><li class=x>3</li><li>4</li></ul><p>one</p><p title='a,b]'>two <b>bold</b></p>"
            "<table><tr><td>11</td><td>12</td></tr><tr><td>21</td><td class=x>22</td></tr></table><h2>h</h2><p>three</p></div>")


def test_selectors_with_positions_and_siblings(spark):
    import pytest
    from pyspark.sql import functions as F

    from webloom.operators import nodes
    from webloom.operators.select import follow, select, xpath

    trees = nodes.page_nodes(spark.createDataFrame([(1, "u", SELECTED)], "page_id long, url string, html string"))
    told = lambda places: F.transform(places, lambda p: nodes.text_of(F.col("nodes"), p["node"], p["end_node"]))
    wanted = {
        "li:nth-child(2)": ["2"], "li:first-child": ["1"], "li:last-child": ["4"], "li:nth-child(odd)": ["1", "3"], "li:nth-child(-n+2)": ["1", "2"],
        "li:not(.x)": ["1", "4"], "li.x + li": ["3", "4"], "li.x ~ li": ["3", "4"], "ul + p": ["one"], "ul ~ p": ["one", "two bold", "three"],
        "p:nth-of-type(2)": ["two bold"], "p:nth-last-of-type(1)": ["three"], "p[title='a,b]'], h2": ["two bold", "h"], "td:nth-child(2)": ["12", "22"],
        "div.a.b > h2": ["h"], "p:nth-child(2)": ["one"], "#top p:not([title]):not(:first-child)": ["one", "three"],
    }
    paths = {
        "//td[2]": ["12", "22"], "//tr/td[1]": ["11", "21"], "//li[last()]": ["4"], "//li[@class='x'][2]": ["3"], "//li[@class='x'][last()]": ["3"],
        "//p[contains(@title, 'b]')]": ["two bold"], "//p[contains(., 'bold')]": ["two bold"], "//p[contains(text(), 'bold')]": [],
        "//li[text()='3']": ["3"], "//li[not(@class)]": ["1", "4"], "//*[starts-with(@id, 'to')]/h2": ["h"], "/div/p[3]": ["three"], "//li[2][@class]": ["2"],
        "//li[@class][1]": ["2"],
    }
    row = trees.select(*[told(select(F.col("nodes"), s)).alias(s.replace(".", "_").replace("`", "")) for s in wanted],
                       *[told(follow(F.col("nodes"), xpath(p)[0])).alias(p.replace(".", "_")) for p in paths]).first()
    assert {s: row[s.replace(".", "_")] for s in wanted} == wanted
    assert {p: row[p.replace(".", "_")] for p in paths} == paths
    for bad in ("li:hover", "li >", "", "li:nth-child(x)"):
        with pytest.raises(ValueError):
            select(F.col("nodes"), bad)
    with pytest.raises(ValueError):
        xpath("//li[foo()]")
