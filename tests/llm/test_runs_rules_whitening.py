"""Periodic runs, address rules and whitening against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm import periodic_runs, queries, url_filter, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least, times):
    """Every stretch that repeats with a period, by trying all periods; those with a smaller period fall out."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= 2 * q:
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, times * q))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (4, 2), (2, 2), (9, 4)])
def test_runs_against_all_periods(least, times):
    r = random.Random(least)
    documents = [[], [b"a"], [b"a"] * 40, [b"a", b"b"] * 30, [b"x"] + [b"a", b"a", b"b"] * 20 + [b"y"], [b"b", b"a"] * 12 + [b"b", b"a", b"a"] * 12]
    for _ in range(120):
        words = []
        while len(words) < r.randint(1, 120):
            words += [bytes([97 + r.randrange(r.choice((1, 2, 3, 9)))]) for _ in range(r.randint(1, 7))] * r.choice((1, 1, 2, 5, 9))
        documents.append(words)
    fib = [b"a"], [b"a", b"b"]
    for _ in range(9):
        fib = fib[1], fib[1] + fib[0]
    documents.append(fib[1])
    want = [brute_runs(d, least, times) for d in documents]
    assert periodic_runs.find_runs(documents, least, times) == want
    assert sum(map(len, want)) > 20
    for d, runs in zip(documents, want, strict=True):
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert periodic_runs.collapsed(d, runs) == [w for i, w in enumerate(d) if i not in gone]


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words, 24, 3)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_lyndon_runs_query(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(r.choice((1, 3, 30, 200)))), "x") for i in range(150)]
    rows += [(i, "ab  cd\n" * r.choice((3, 13, 60)) + "tail ", "x") for i in range(150, 200)]
    rows += [(None, None, "x"), (None, "a " * 30, "x"), (1000, None, "x"), (1001, "", "x"), (1002, " \n\t ", "x"), (7, rows[7][1], "x"), (1003, "ünï \x85b\xa0c \x1c😀 " * 25, "x"), (-5, "q " * 24, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_lyndon_runs(spark, str(tmp_path))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 6 + ["string"] * 2
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert periodic_runs.find(docs.where("false")).count() == 0
    found = periodic_runs.find(docs.where("doc_id = -5")).first()
    assert found["collapsed"] == "q" and [tuple(x) for x in found["runs"]] == [(0, 24, 1)]
    with pytest.raises(ValueError):
        periodic_runs.find(docs, times=1)


def test_runs_of_long_texts_and_many_batches(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = periodic_runs.with_repetitions(F.col("text"), F.col("doc_id")).alias("text")
    one = sorted(map(str, periodic_runs.find(docs.select("doc_id", text)).collect()))
    monkeypatch.setattr(periodic_runs, "WORDS", 50)
    assert one == sorted(map(str, periodic_runs.find(docs.select("doc_id", text)).collect()))
    words = [b"%d" % (i % 977) for i in range(300_000)]
    assert periodic_runs.find_runs([words]) == [[(0, 300_000, 977)]]
    assert periodic_runs.find_runs([[b"a"] * 200_000, [b"%d" % i for i in range(30)]]) == [[(0, 200_000, 1)], []]


ODD_URLS = [
    (1, "https://a.Example.ORG/en/12?x"), (2, "http://example.org"), (3, "http://example.org/es/"), (4, "http://xexample.org/es/1"), (5, None), (6, ""), (7, "no scheme.org/es/"), (8, "x://y://example.org/es/"),
    (None, "http://b.example.org/en/1"), (None, "http://b.example.org/en/1"), (1, "https://a.Example.ORG/en/12?x"), (9, "http://com/de/x"), (10, "http://.com/fr/"), (11, "http://org./es/"), (12, "http://É.example.org/es/#a"),
    (13, "http://a.com?/de/"), (14, "http://a.com/DE/"), (15, "http://" + "a." * 3000 + "com/de/" + "p" * 20_000), (16, "http://a.com:80/de/"), (17, "https://x.example.org/en/2"), (18, "http://org/"), (19, "http://a\n.org/\nb"),
]
MORE_RULES = [
    ("a.com", "/", "block"), ("A.com", "/DE", "allow"), ("a.com", "/", "allow"), ("example.org", "/en/12", "allow"), (None, "/", "block"), ("org", None, "block"), ("org", "/", None), ("org", "x", "block"), ("o/rg", "/", "block"), ("org", "/?", "block"), ("com", "", "allow"), ("net", "/", "maybe"),
]


def brute_judge(url, rules):
    head, mark, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if mark else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if mark else ""
    lower = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and p is not None and v in ("allow", "block") and not re.search("[/?#]", h) and (p == "" or p.startswith("/") and not re.search("[?#]", p))]
    fits = [f for f in fits if (lower == f[3][: f[1]].lower() or lower.endswith("." + f[3][: f[1]].lower())) and path.startswith(f[3][f[1] :])]
    best = max(fits, default=None)
    return lower, path, best and best[3][: best[1]].lower() + best[3][best[1] :], best[4] if best else "allow"


@pytest.mark.parametrize("rules", [list(queries.RULES), [*queries.RULES, *MORE_RULES], []])
@pytest.mark.parametrize("broadcast", [True, False])
def test_rules_against_all_rules(spark, monkeypatch, rules, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(url_filter, "COPIES", 2)
    r = random.Random(5)
    urls = ODD_URLS + [(100 + i, f"http://{r.choice(('', 'w.', 'a.b.'))}{r.choice(('example.org', 'org', 'a.com', 'com', 'net'))}/{r.choice(('en/1', 'en/12', 'es/', 'de/', 'fr/', 'DE', 'e'))}{i}") for i in range(200)] + [(3, "http://example.org/es/")] * 4
    pages = spark.createDataFrame([(i, u, "c", "d") for i, u in urls], "page_id long, url string, host string, verdict string")
    got = url_filter.judge(pages, spark.createDataFrame(rules, url_filter.SCHEMA))
    assert sorted(map(str, ((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in got.collect()))) == sorted(str((i, *brute_judge(u, rules))) for i, u in urls)
    assert url_filter.allowed(pages, spark.createDataFrame(rules, url_filter.SCHEMA)).count() == sum(brute_judge(u, rules)[3] == "allow" for _, u in urls)
    assert url_filter.judge(pages.where("false"), spark.createDataFrame(rules, url_filter.SCHEMA)).count() == 0


def test_rules_shuffle_ids_and_addresses_once(spark, small):
    plan = queries.op12_url_rules(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_id#") == 1 and "html" not in plan


def test_rules_sql(spark, small):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{small}/pages.parquet'")
    mine = sorted(map(str, (tuple(x) for x in queries.op12_url_rules(spark, small).collect())))
    assert mine == sorted(map(str, c.sql(queries.oracle_sql()["op12_url_rules"]).fetchall()))


def whole(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    return x


def test_states_merge_without_loss():
    r = np.random.default_rng(6)
    x = (r.normal(size=(900, 12)) * np.geomspace(1, 300, 12) + 1_000_000).astype(np.int64)
    for cuts in ([1, 2, 3, 450], [5, 800], list(range(10, 900, 10))):
        states = [whitening.state_of(p) for p in np.split(x, cuts)]
        while len(states) > 1:
            states = [whitening.merge(a, b) for a, b in zip(states[::2], states[1::2], strict=False)] + states[len(states) // 2 * 2 :]
        s = states[0]
        centred = x - x.mean(axis=0)
        assert s.n == 900 and (s.sums == x.sum(axis=0)).all() and len(s.scale) == 12
        np.testing.assert_allclose(s.rows.T @ s.rows, centred.T @ centred, rtol=0, atol=1e-11 * s.scale[0] ** 2)
        np.testing.assert_allclose(s.scale, np.linalg.svd(centred, compute_uv=False), rtol=1e-11)
    doubles = whitening.merge(whitening.state_of(x[:100].astype(float)), whitening.state_of(x[100:].astype(float)))
    np.testing.assert_allclose(doubles.scale, np.linalg.svd(centred, compute_uv=False), rtol=1e-8)


def test_whitening_query(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(7)
    good = [(r.normal(size=40) * np.linspace(0.5, 4, 40)).astype(np.float32).tolist() for _ in range(300)]
    good += [good[0]] * 150
    bad = [None, [None] + good[0][1:], [float("nan")] + good[0][1:], good[0][:-1] + [float("inf")], good[0][:-1] + [float("-inf")], [], good[0][:3]]
    rows = [(i, v, 5) for i, v in enumerate(good)] + [(1000 + i, v, 1) for i, v in enumerate(bad)] + [(None, good[1], 0), (7, good[7], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened int").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "ROWS", 16)
    got = queries.op13_svd_whitening(spark, str(tmp_path)).toPandas()
    kept = [(i, v) for i, v, _ in rows if v is not None and len(v) == 40 and all(c is not None and np.isfinite(c) for c in v)]
    x = whole([v for _, v in kept])
    n, sums = len(kept), x.sum(axis=0)
    dev = ((n * x - sums) ** 2).sum(axis=1)
    centred = (x - sums / n).astype(float)
    cov = centred.T @ centred / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    assert len(got) == 32 * n and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    np.testing.assert_allclose(got.drop_duplicates("component").sort_values("component")["explained"], (e / e.sum())[:32], rtol=1e-10)
    white = centred @ vec[:, :32] / np.sqrt(e[:32])
    for at in (0, 5, 299):
        mine = got[got["vec_id"] == kept[at][0]].sort_values("component")
        np.testing.assert_allclose(np.abs(mine["whitened"]), np.abs(white[at]), rtol=1e-7, atol=1e-9)
        assert set(mine["deviation"]) == {int(dev[at])}
    assert (got["vec_id"].isna().sum(), (got["vec_id"] == 7).sum()) == (32, 64)
    signs = [np.sign(got[got["vec_id"] == kept[at][0]].sort_values("component")["whitened"].to_numpy() * white[at]) for at in (0, 5, 299)]
    assert (signs[0] == signs[1]).all() and (signs[0] == signs[2]).all()


def test_whitening_of_odd_tables(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    table = lambda rows: spark.createDataFrame(rows, schema)
    for rows in ([], [(1, None)], [(1, [])], [(1, [float("nan")])]):
        found, model = whitening.whiten(table(rows))
        assert found.count() == 0 and model is None and found.columns == ["vec_id", "deviation", "whitened"]
    found, model = whitening.whiten(table([(1, [0.5, 2.0, -1.0])]))
    assert found.collect() == [(1, 0, [None] * 3)] and model.n == 1 and model.explained == [0.0] * 3 and model.error == 0
    found, model = whitening.whiten(table([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 5.0]), (3, [4.0, 2.0, 9.0])]))  # on a line
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in found.collect())
    assert model.error < 1e-12 and abs(model.explained[0] - 1) < 1e-12 and np.allclose(model.vectors @ model.vectors.T, np.eye(3))
    found, _ = whitening.whiten(table([(1, [1e300]), (2, [-1e300]), (3, [0.0])]))
    assert {r["vec_id"]: r["deviation"] for r in found.collect()} == {1: None, 2: None, 3: (3 * 1_000_000 - 1_000_000) ** 2}
