import datetime
import fnmatch
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import dates, html, html_kernels, text, url_kernels, urls


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, expected",
    [(" Example.COM/archive#section ", "https://Example.COM/archive"), ("ftp://example.com/", None), ("", None), ("http://a.b?q=1#x", "http://a.b?q=1"), ("https://", None)],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, urls.normalize_url(F.col("u")), u=url) == expected


def test_canonical_url(spark):
    u = "HTTPS://Example.COM/news?utm_source=x&b=2&a=1&fbclid=abc#story"
    assert one(spark, urls.canonical_url(F.col("u")), u=u) == "https://example.com/news?a=1&b=2"
    assert one(spark, urls.canonical_url(F.col("u"), "drop"), u="https://example.com/news?a=1") == "https://example.com/news"
    assert one(spark, urls.canonical_url(F.col("u"), "preserve"), u="HTTP://A.b?x=2&x=1") == "http://a.b/?x=2&x=1"
    read = lambda u: one(spark, urls.canonical_decoded(F.col("u")), u=u)
    assert read(u) == "https://example.com/news?a=1&b=2"
    assert read("http://a/?b=%20&a%20=0&a=1&bare") == "http://a/?a=1&a+=0&b=+&bare="
    assert read("http://a/?x=%zz&~=*&%75tm_x=1&é=ü&a=b=c&=v") == "http://a/?=v&a=b%3Dc&x=%25zz&~=%2A&%C3%A9=%C3%BC"


def test_queries_read_and_written_as_forms(spark):
    pool = ["a", "B", "%20", "+", "%", "%4", "%41", "=", "&", "~", "*", "é", "%C3%BC", "/", "?", ".", "-", "utm_x", "gclid", ";", "日"]
    r = random.Random(1)
    made = ["http://h/p?" + "".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(made)), "i int, u string")
    for got in rows.select("u", urls.query_pairs(F.col("u")).alias("pairs"), urls.canonical_decoded(F.col("u")).alias("c")).collect():
        want = urllib.parse.parse_qsl(got["u"].partition("?")[2], keep_blank_values=True)
        assert [tuple(p) for p in got["pairs"]] == want, got["u"]
        kept = [p for p in want if p[0].lower() not in urls.TRACKING_KEYS and p[0][:4].lower() != "utm_"]
        assert got["c"].partition("?")[2] == urllib.parse.urlencode(sorted(kept)), got["u"]


def test_native_and_decoded_canonical_agree_on_simple_queries(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet")
    assert rows.where(urls.canonical_url(F.col("url")) != urls.canonical_decoded(F.col("url"))).count() == 0


def test_policy_globs(spark):
    f = lambda u: one(spark, urls.matches_policy(F.col("u"), ["/news/*"], ["/news/private/*"]), u=u)
    assert [f("https://a/news/one"), f("https://a/about"), f("https://a/news/private/a")] == [True, False, False]
    patterns = ["*", "/a?c", "/[ab]*", "/[!ab]*", "/x.y", "/[]x]", "/(1)+", "/a[", "/[^a]b", "/ü*"]
    targets = ["/abc", "/x.y", "/xzy", "/bcd", "/]", "/(1)+", "/a[", "/^b", "/üb", "/cb", "/a\nb"]
    rows = spark.createDataFrame([(t,) for t in targets], "t string")
    for p in patterns:
        got = [r["x"] for r in rows.select(F.col("t").rlike(urls.glob_regex(p)).alias("x")).collect()]
        assert got == [fnmatch.fnmatchcase(t, p) for t in targets], p


def test_url_parts(spark):
    assert one(spark, urls.site_name(F.col("u")), u="https://www.example.test:80/") == "example.test"
    assert one(spark, urls.host_key(F.col("u")), u="https://WWW.a.b:8080/x") == "a.b:8080"
    assert one(spark, urls.diagnostic_url(F.col("u")), u="https://me:pw@example.test/image.png?token=secret&size=2#f") == "https://example.test/image.png?token=redacted&size=redacted"
    assert one(spark, urls.split_patterns(F.col("u")), u="/news/*, /about\n/contact") == ["/news/*", "/about", "/contact"]
    assert one(spark, urls.looks_like_page(F.col("u")), u="https://a/b.PNG?x") is False
    assert one(spark, urls.archived_original(F.col("u")), u="https://web.archive.org/web/2001id_/http://a/b") == "http://a/b"
    assert [one(spark, urls.local_return(F.col("u")), u=u) for u in ("/x", "//evil", "http://e")] == ["/x", "/dashboard", "/dashboard"]


def test_references(spark):
    import random

    r = random.Random(1)
    bases = ["https://a.test/dir/page?x=1", "http://a.test", "http://a.test/", "HTTP://U@a.test:80/b/c/d;p?q#f", "https://a.test/b//c/", "https://a.test/../x", "mailto:x@y", "http://a.test/b/c/."]
    refs = ["/root", "//b.test/x", "https://c.test/", "?q=2", "", "x/../y", "./z", "#f", "../up", "..", ".", "../", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g;x=1/../y", "http:g", "https:g/../h", " /x\n ", "a//b///c", "//b.test", "//b.test?q#f", "mailto:a@b", "javascript:x()", "?", "#", "1a:b", "/a/b/../..", "//", "é/ü", "a\tb"]
    pairs = [(b, h) for b in bases for h in refs]
    pairs += [(r.choice(bases), "".join(r.choice(("a", "b", ".", "..", "/", "/", "?", "#", "x=1")) for _ in range(r.randint(1, 9)))) for _ in range(1500)]
    pairs = [(b, h) for b, h in pairs if "///" not in h[:3] and not h.startswith("//?") and not h.startswith("//#")] + [(None, "x"), ("http://a.test/", None)]
    rows = spark.createDataFrame(pairs, "b string, h string").withColumn("got", urls.resolve(F.col("b"), F.col("h"))).collect()
    wrong = [(b, h, got, urllib.parse.urljoin(b, h.strip())) for b, h, got in rows if b is not None and h is not None and got != urllib.parse.urljoin(b, h.strip())]
    assert not wrong, wrong[:20]
    assert [x["got"] for x in rows[-2:]] == [None, None]


def test_reasons_and_addresses(spark):
    read = lambda t: one(spark, urls.safe_reason(F.col("t")), t=t)
    assert read("a \n b https://u:p@x.test/?k=v") == "a b https://x.test/?k=redacted"
    assert read("") == "Unknown error" and read("x" * 300) == "x" * 240
    assert read("HTTP://A.b:080/c?d=1&e#f, http://x.test:99999/ and <https://y/?q q>") == "http://a.b:80/c?d=redacted&e=redacted http://x.test/ and <https://y/?q=redacted q>"
    verdicts = [url_kernels.address_verdict(a) for a in ("10.0.0.8", "100.64.0.8", "127.0.0.1", "169.254.169.254", "::1", "8.8.8.8", "x")]
    assert verdicts == ["private", "private", "blocked", "blocked", "blocked", "allowed", "blocked"]
    assert url_kernels.address_verdict("10.0.0.8", True) == "allowed"


def test_text(spark):
    assert [one(spark, text.human_size(F.col("n")), n=n) for n in (0, 1023, 1280, 5 << 20)] == ["0 B", "1023 B", "1.2 KB", "5.0 MB"]
    assert one(spark, text.initials(F.col("n")), n=" ada  lovelace x") == "AL" and one(spark, text.initials(F.col("n")), n=" ") == "?"
    assert one(spark, text.digest_hex(text.digest_wire(text.sha256_hex(F.col("b")))), b="x") == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    assert one(spark, text.excerpt(F.col("t"), "NEEDLE", 3), t="aaaa needle bbbb") == "…aa needle bb…"
    assert one(spark, text.canonical_json(b=F.lit(1), a=F.lit("x"))) == '{"a":"x","b":1}'
    assert one(spark, text.asset_number(F.col("i")), i="asset_012") == 12
    assert one(spark, text.contains_any(" 100% Missing ", F.col("t")), t="HTTP 100% missing") is True


def ts(s):
    return datetime.datetime.fromisoformat(s)


def test_dates(spark):
    got = [one(spark, dates.interval_days(F.col("i"), F.col("c")), i=i, c=c) for i, c in (("daily", ""), ("weekly", ""), ("monthly", ""), ("yearly", ""), ("custom", "0"), ("x", "invalid"), ("x", ""))]
    assert got == [1, 7, 30, 365, 1, 30, 30]
    next_at = lambda t, *a, **k: one(spark, dates.next_calendar(F.lit(t).cast("timestamp"), *a, **k).cast("timestamp_ntz"))
    assert next_at("2027-01-31 12:00:00", "monthly", clock="09:00", month_day=31) == ts("2027-02-28T09:00")
    assert next_at("2026-03-22 10:00:00", "weekly", "Europe/London", "09:00", weekday=6) == ts("2026-03-29T08:00")
    assert next_at("2026-03-22 10:00:00", "daily", clock="09:00") == ts("2026-03-23T09:00")
    assert next_at("2026-12-31 10:00:00", "monthly", clock="09:00", month_day=1) == ts("2027-01-01T09:00")
    assert next_at("2026-01-01 10:00:00", "yearly", clock="09:00", custom_days=3) == ts("2026-01-04T09:00")
    at = lambda h: one(spark, dates.window_open(F.lit(f"2026-01-01 {h}:00").cast("timestamp"), "22:00", "06:00"))
    assert [at("23:00"), at("05:59"), at("12:00")] == [True, True, False]
    assert one(spark, dates.wire_time(dates.compact_time(F.col("c"))), c="20010925123456") == "2001-09-25T12:34:56Z"
    assert one(spark, dates.valid_clock(F.col("c")), c="24:00") is False


def test_markup(spark):
    page = "<html><TITLE>Ventnor &amp; Arts\n Club</title><body><script>x</script><p>Hi <b>you</b></p><a href='/x'>1</a><a class=c href=\"/y\">2</a></body>"
    assert one(spark, html_kernels.unescape(html.title(F.col("p"))), p=page) == "Ventnor & Arts Club"
    assert one(spark, html.visible_text(F.col("p")), p="<style>a</style>A<template>t</template> <i>b</i>") == "A t b"
    assert html_kernels.links_of(page) == ["/x", "/y"]
    assert one(spark, html.render_reason(F.col("p")), p="<div id='root'> </div>" + "x" * 300) == "empty application root"
    assert one(spark, html.render_reason(F.col("p")), p='<html data-ssr="false">') == "server-side rendering is off"
    assert one(spark, html.render_reason(F.col("p")), p="<noscript>Please enable JavaScript</noscript>") == "scripts are asked for"
    assert one(spark, html.render_reason(F.col("p")), p="<p>plain</p>") is None
    assert one(spark, html.first_frame(F.col("p")), p='<frameset><frame src="menu.html"><frame src="c.html">') == "menu.html"
    page = '<link rel="stylesheet" href="https://cdn.test/a.css"><img src="/snapshots/s/asset/gone"><img alt="x">'
    assert one(spark, html.local_references(F.col("p")), p=page) == ["gone"] and one(spark, html.images_without_source(F.col("p")), p=page) == 1
    assert [r["url"] for r in one(spark, html.resources(F.col("p")), p=page)] == ["https://cdn.test/a.css", "/snapshots/s/asset/gone"]


def test_rewriting():
    lazy = html_kernels.promote_lazy('<img src="data:image/gif;base64,R" data-src="/real.png" alt="a&amp;b">')
    assert 'src="/real.png"' in lazy and 'alt="a&amp;b"' in lazy
    assert html_kernels.promote_lazy("<img data-original='o.png' data-src=s.png>") == '<img data-original="o.png" data-src="s.png" src="o.png">'
    assert html_kernels.css("a{background:url( 'x.png' )}@import \"y.css\";b{background:url(data:x)}", "https://a.test/c/", str.upper) == 'a{background:url("HTTPS://A.TEST/C/X.PNG")}@import "HTTPS://A.TEST/C/Y.CSS";b{background:url(data:x)}'
    assert html_kernels.srcset("a.png 1x, b.png 2x", "https://a.test/", str.upper) == "HTTPS://A.TEST/A.PNG 1x, HTTPS://A.TEST/B.PNG 2x"


def test_assigned_addresses_are_private_in_every_release():
    verdicts = [url_kernels.address_verdict(a) for a in ("192.0.0.9", "::ffff:192.0.0.10", "192.0.0.170", "191.255.255.255", "192.0.1.0")]
    assert verdicts == ["private", "private", "private", "allowed", "allowed"]


def test_titles_keep_what_a_cut_leaves_of_a_reference(spark):
    decode = lambda t: one(spark, html_kernels.unescape_cut(html.title(F.col("t"))), t=t)
    assert decode("<title>" + "x" * 155 + "&amp;&amp;</title>") == "x" * 155 + "&"
    assert decode("<title>" + "x" * 156 + "&amp;</title>") == "x" * 156 + "&amp" and decode("<title></title>") is None
    assert decode("<title>&lt;a&gt; &quot;b&quot; &amp;lt; &#233;&#xE9; &eacute; &amp &none; &notit;</title>") == '<a> "b" &lt; éé é &amp &none; &notit;'


def test_assets_of_any_name_become_absolute(spark):
    page = '<a href="/snapshots/s1/asset/êtes"> url(/snapshots/s1/asset/a1) /snapshots/s1/asset/%C3%A9 x/snapshots/s1/asset/b'
    want = '<a href="https://a.test/snapshots/s1/asset/êtes"> url(https://a.test/snapshots/s1/asset/a1) https://a.test/snapshots/s1/asset/%C3%A9 x/snapshots/s1/asset/b'
    assert one(spark, html.absolute_assets(F.col("t"), "https://a.test/"), t=page) == want
