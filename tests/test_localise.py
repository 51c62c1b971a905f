"""Localisation against a plain version that stores one resource after another."""

import random
import re
from urllib.parse import urldefrag, urljoin

import pytest

from quarrystone.operators import localise

HOST = "https://cdn.test/x/"


def plain_order(page, url, resources, most):
    """rank order of one page, as if each resource were fetched in turn."""
    assets, cache = [], set()

    def store(address, stage, depth):
        address = urldefrag(address)[0]
        if address in cache or len(assets) >= most or address not in resources:
            return
        final, kind, body = resources[address]
        assets.append({"url": address, "stage": stage, "depth": depth, "css": "text/css" in kind.lower(), "body": body or "", "base": final or address})
        cache.update((address, final or address))

    for stage, ref in page:
        store(urljoin(url, ref), stage, 0)
    done = set()
    while True:
        left = [a for a in assets if a["css"] and a["url"] not in done]
        if not left:
            break
        style = min(left, key=lambda a: len(re.findall(r"url\(", a["body"], re.I)))
        done.add(style["url"])
        for m in re.finditer(r"""@import\s+(["'])(.*?)\1[^;]*;""", style["body"], re.I | re.S):
            store(urljoin(style["base"], m[2]), "css_dependency", style["depth"] + 1)
        for m in re.finditer(r"url\(\s*([^)]+?)\s*\)", style["body"], re.I):
            raw = m[1].strip().strip("\"'")
            if raw and not raw.startswith(("data:", "#", "mailto:", "tel:")):
                store(urljoin(style["base"], raw), "css_dependency", style["depth"] + 1)
    return [(i + 1, a["url"], a["stage"], a["depth"]) for i, a in enumerate(assets)]


@pytest.mark.parametrize("most", [120, 9])
def test_order_against_a_plain_version(spark, most):
    r = random.Random(most)
    names = [f"n{i}" for i in range(60)]
    resources = {}
    for n in names[:50]:
        css = r.random() < 0.7
        refs = [r.choice(names) + r.choice(("", "#f", "?q")) for _ in range(r.choice((0, 3, 8, 12)))]
        parts = [r.choice((f'@import "{x}";', f"@IMPORT '../x/{x}' screen;", f"a{{background:url({x})}}", f"b{{src:URL( '/x/{x}' )}}", f"url(data:{x})", "url(#z)")) for x in refs]
        final = r.choice((None, None, HOST + r.choice(names), "https://other.test/y/" + n))
        resources[HOST + n] = (final, r.choice(("text/css", "Text/CSS; charset=utf-8")) if css else "image/png", "".join(parts) if css else None)
    pages, want = [], {}
    for i in range(40):
        kinds = {"html_link": [], "html_asset": [], "html_srcset": [], "inline_css": []}
        for _ in range(r.randint(0, 12)):
            kinds[r.choice(list(kinds))].append(r.choice(names))
        tags = [f'<link rel="x Stylesheet" href="{n}">' for n in kinds["html_link"]] + [f"<img src='./{n}#a'>" for n in kinds["html_asset"]]
        tags += [f'<img data-src="no" src="keep" srcset="{n} 1x, data:x 2x">'.replace(' data-src="no" src="keep"', "") for n in kinds["html_srcset"]] + [f'<p style="background:url(/x/{n})">' for n in kinds["inline_css"]]
        r.shuffle(tags)
        order = {k: [] for k in kinds}
        for t in tags:
            k = "html_link" if "<link" in t else "html_srcset" if "srcset" in t else "html_asset" if "<img" in t else "inline_css"
            order[k].append(re.search(r"n\d+", t)[0])
        pages.append((i, "https://a.test/p", f'<base href="{HOST}">' + "".join(tags)))
        want[i] = plain_order([(k, n) for k in order for n in order[k]], HOST, resources, most)
    rows = spark.createDataFrame(pages, "id long, url string, body string")
    table = spark.createDataFrame([(u, *v) for u, v in resources.items()], "url string, final_url string, content_type string, body string")
    got = {i: [] for i in want}
    for x in localise.localised(rows, table, most).orderBy("id", "rank").collect():
        got[x["id"]].append((x["rank"], x["url"], x["stage"], x["depth"]))
    assert got == want
    assert max(len(v) for v in want.values()) >= (9 if most == 9 else 15) and max(d for v in want.values() for *_, d in v) > 1


def test_odd_pages(spark):
    rows = spark.createDataFrame([(1, "https://a.test/", None), (2, "https://a.test/", ""), (3, None, '<img src="x">'), (4, "https://a.test/", "<img src='/snapshots/s/asset/a'><img src='javascript:x'><img data-src='z' src='data:image/gif,'>")], "id long, url string, body string")
    table = spark.createDataFrame([("https://a.test/z", None, None, None), ("https://a.test/q", None, "text/css", None)], "url string, final_url string, content_type string, body string")
    assert [tuple(r) for r in localise.localised(rows, table).collect()] == []
    some = table.na.fill("image/png", ["content_type"])
    assert [tuple(r) for r in localise.localised(rows, some).collect()] == [(4, 1, "https://a.test/z", "https://a.test/z", "html_asset", 0)]
    assert localise.localised(rows.where("false"), some).count() == 0 and localise.localised(rows, some.where("false")).count() == 0
