"""Replay: links to stored copies and out of the archive, forms and scripts off."""

import pytest

from quarrystone.functions import html
from quarrystone.operators import compare, joins, replay

OUT = ' target="_blank" rel="noopener noreferrer external"'
PAGES = [
    (1, "r1", "https://a.test/d/one?x=1", '<A class="k" HREF = "two#f&amp;g">2</a><a href=\'../other\'>o</a><a name=x>n</a><a href=two>unquoted</a>'),
    (2, "r1", "https://a.test/d/two", '<a data-href="/no" href="HTTPS://A.test/d/one?x=1">1</a><a href="#top">t</a><a href=" javascript:x()">j</a><a href="data:,">d</a><a href="mailto:a@b">m</a><a href="">e</a>'),
    (3, "r2", "https://a.test/d/one?x=1", '<a href="two" target="_self" rel=\'next\'>other run</a><a href="ftp://f.test/x">f</a><a href="//b.test/?q=1&amp;r=\'">q</a>'),
    (4, "r1", "https://a.test/none", "no links <form><form action='/x' inert><FORM ACTION=/y data-inert=1><script src=a><script TYPE='module' x><script type=text/x>"),
    (5, "r1", "https://a.test/null", None),
]
NAVIGATED = {
    1: f'<A class="k" HREF = "https://o.test/snapshots/2/content#f&amp;g">2</a><a href=\'https://a.test/other\'{OUT}>o</a><a name=x>n</a><a href=two>unquoted</a>',
    2: '<a data-href="/no" href="https://o.test/snapshots/1/content">1</a><a href="#top">t</a><a href="#">j</a><a href="#">d</a><a href="mailto:a@b">m</a><a href="">e</a>',
    3: f'<a href="https://a.test/d/two" target="_blank" rel="noopener noreferrer external">other run</a><a href="ftp://f.test/x">f</a><a href="https://b.test?q=1&amp;r=&#x27;"{OUT}>q</a>'.replace("b.test?", "b.test/?"),
    4: f'no links <form action="about:blank" inert><form action="about:blank" inert><FORM ACTION=/y data-inert=1 inert><script src=a type="{html.DISABLED_SCRIPT}"><script type="{html.DISABLED_SCRIPT}" x><script type=text/x>',
    5: None,
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "id long, run_id string, url string, body string")


@pytest.fixture(scope="module")
def page_map(pages):
    return compare.page_map(pages.withColumnsRenamed({"url": "source_url"}).selectExpr("*", "source_url as final_url"))


def test_links_lead_to_copies_of_their_run(pages, page_map):
    assert {r["id"]: r["body"] for r in replay.navigation(pages, page_map, "https://o.test/").collect()} == NAVIGATED
    assert replay.navigation(pages.where("false"), page_map, "https://o.test").count() == 0


def test_without_origin_links_leave(pages, page_map):
    got = {r["id"]: r["body"] for r in replay.linked(pages, page_map, "").collect()}
    assert f'HREF = "https://a.test/d/two#f&amp;g"{OUT}' in got[1] and "snapshots" not in "".join(filter(None, got.values()))


def test_documents(spark, page_map):
    body = '<html><HEAD lang=x><meta http-equiv=Content-Security-Policy content="y"></head><iframe src="https://www.googletagmanager.com/z">\n</iframe><img src="/snapshots/a/asset/b.png"><base href="/x"><a href=\'/d/two\'>'
    rows = spark.createDataFrame([(1, "r1", "https://a.test/", body), (2, "r1", "https://a.test/?a&b", "<p>bare"), (3, "r1", "https://a.test/", "<p>content-security-policy <base>")], "id long, run_id string, url string, body string")
    rules = '<meta http-equiv="Content-Security-Policy" content="' + "; ".join(f"{k} {v}" for k, v in html.REPLAY_RULES.items()) + ';">'
    got = {r["id"]: r["body"] for r in replay.documents(rows, page_map, "https://o.test", "<i>").collect()}
    assert got[1] == f"<html><HEAD lang=x>{rules}<i></head><img src=\"https://o.test/snapshots/a/asset/b.png\"><base href=\"https://o.test/\"><a href='https://o.test/snapshots/2/content'>"
    assert got[2] == f'<base href="https://o.test/">{rules}<i><p>bare' and got[3] == '<i><p>content-security-policy <base href="https://o.test/">'
    assert replay.documents(rows, page_map, "").where("id = 2").first()["body"].startswith('<base href="https://a.test/?a&amp;b">')


def test_lookup_deals_out_hot_keys(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) as k")
    known = spark.createDataFrame([("hot", 1), ("7", 2), (None, 3)], "k string, v int")
    got = joins.lookup(rows, known, ["k"])
    assert got.columns == ["k", "id", "v"] and got.count() == 5000 and got.where("v = 1").count() == 1667 and got.where("v = 2").count() == 1
