"""Canonical JSON and compiled schemas."""

import copy
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import json_kernels, schema


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"b": 1, "a": [1, {"d": null, "c": true}]}', ('{"a":[1,{"c":true,"d":null}],"b":1}', None, None)),
        ('{"a":1,"a":2}', ('{"a":2}', None, None)), ('"\\u001f\\n\\u00e9/"', ('"\\u001f\\né/"', None, None)), ("-0", ("0", None, None)), ("9007199254740991", ("9007199254740991", None, None)),
        ("[[1.0]]", (None, "fraction", "$[0][0]")), ("1e3", (None, "fraction", "$")), ('{"a":{"b":-9007199254740992}}', (None, "integer range", "$.a.b")), ("1" * 40, (None, "integer range", "$")),
        ('{"x":1,"é":1.5}', (None, "key", "$")), ('{"x":[1.5],"é":1}', (None, "fraction", "$.x[0]")), ('["a","\\ud800x"]', (None, "surrogate", "$[1]")), ('{"k":"\\ud83d\\ude00"}', ('{"k":"😀"}', None, None)),
        ('{"a":{"é":1}}', (None, "key", "$.a")), ('["é"]', (None, "not composed", "$[0]")), ("{", (None, "not JSON", "$")), ("", (None, "not JSON", "$")), ("NaN", (None, "fraction", "$")), ("[" * 100_000, (None, "too deep", "$")), (None, (None, None, None)),
    ],
)
def test_canonical_json(text, want):
    assert json_kernels.canonical_of(text) == want


def test_canonical_json_is_stable(spark):
    import random

    r = random.Random(3)

    def some(depth):
        kind = r.randrange(5 if depth else 3)
        if kind == 3:
            return [some(depth - 1) for _ in range(r.randrange(4))]
        if kind == 4:
            return {r.choice("abcxyz\n\"") + str(r.randrange(9)): some(depth - 1) for _ in range(r.randrange(4))}
        return r.choice((None, True, False, r.randrange(-(1 << 53) + 1, 1 << 53), "".join(r.choice("aé\u0000 \"\\/😀") for _ in range(r.randrange(5)))))

    values = [some(4) for _ in range(200)]
    rows = [(json.dumps(v, indent=r.choice((None, 2)), ensure_ascii=r.random() < 0.5),) for v in values]
    got = spark.createDataFrame(rows, "t string").select(json_kernels.canonical("t").alias("c")).select("c.*").collect()
    for v, row in zip(values, got, strict=True):
        assert row["problem"] is None and json.loads(row["canonical"]) == v and unicodedata.is_normalized("NFC", row["canonical"])
        assert json_kernels.canonical_of(row["canonical"])[0] == row["canonical"] == json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


DIGEST = "sha256:" + "a" * 43
OPAQUE = {k: f"{k}_{'x' * 16}" for k in "manifest archive site capture page resource".split()}
STORED = {"status": 200, "content_type": "text/html", "bytes": 1, "digest": DIGEST}
GOOD = {
    "schema": "archive-manifest.v1", "format_version": "1.0", "manifest_id": OPAQUE["manifest"], "archive_id": OPAQUE["archive"], "site_id": OPAQUE["site"], "capture_id": OPAQUE["capture"], "captured_at": "2024-02-01T00:00:00+01:00",
    "entry_page_id": OPAQUE["page"], "pages": [{"id": OPAQUE["page"], "source_url": "https://a/", "final_url": "https://a/", **STORED, "resource_ids": [OPAQUE["resource"]]}], "resources": [{"id": OPAQUE["resource"], "source_url": "", "final_url": "", **STORED}],
}
GONE = object()


def changed(*changes):
    m = copy.deepcopy(GOOD)
    for *path, key, value in changes:
        at = m
        for p in path:
            at = at[p]
        if value is GONE:
            del at[key]
        else:
            at[key] = value
    return json.dumps(m)


CASES = [
    (json.dumps(GOOD), []), (changed(("pages", 0, "bytes", 3.0)), []), (changed(("resources", [])), []),
    *((changed((k, GONE)), [(f"$.{k}", "required")]) for k in GOOD), *((changed(("pages", 0, k, GONE)), [(f"$.pages[0].{k}", "required")]) for k in GOOD["pages"][0]), *((changed(("resources", 0, k, GONE)), [(f"$.resources[0].{k}", "required")]) for k in GOOD["resources"][0]),
    *((changed((f"{k}_id", f"{k}_short")), [(f"$.{k}_id", "pattern")]) for k in ("manifest", "archive", "site", "capture")), (changed(("entry_page_id", OPAQUE["site"])), [("$.entry_page_id", "pattern")]),
    (changed(("schema", "x"), ("format_version", 1.0)), [("$.format_version", "const"), ("$.schema", "const")]), (changed(("captured_at", "2024-13-01T00:00:00Z")), [("$.captured_at", "format")]), (changed(("captured_at", None)), [("$.captured_at", "type")]),
    (changed(("pages", [])), [("$.pages", "minItems")]), (changed(("pages", {})), [("$.pages", "type")]), (changed(("pages", 0, 3)), [("$.pages[0]", "type")]), (changed(("z", 1), ("pages", 0, "é", {})), [("$.pages[0].é", "additionalProperties"), ("$.z", "additionalProperties")]),
    (changed(("pages", 0, "status", -1), ("resources", 0, "status", 1000)), [("$.pages[0].status", "minimum"), ("$.resources[0].status", "maximum")]), (changed(("pages", 0, "status", True)), [("$.pages[0].status", "type")]), (changed(("pages", 0, "status", "200")), [("$.pages[0].status", "type")]),
    (changed(("pages", 0, "bytes", 1.5)), [("$.pages[0].bytes", "type")]), (changed(("pages", 0, "content_type", "")), [("$.pages[0].content_type", "minLength")]), (changed(("resources", 0, "content_type", "x" * 256)), [("$.resources[0].content_type", "maxLength")]),
    (changed(("pages", 0, "digest", DIGEST[:-1])), [("$.pages[0].digest", "pattern")]), (changed(("pages", 0, "source_url", "/relative")), [("$.pages[0].source_url", "format")]), (changed(("resources", 0, "source_url", "/relative")), []),
    (changed(("pages", 0, "resource_ids", [OPAQUE["resource"]] * 2)), [("$.pages[0].resource_ids", "uniqueItems")]), (changed(("pages", 0, "resource_ids", ["x", OPAQUE["resource"], 7])), [("$.pages[0].resource_ids[0]", "pattern"), ("$.pages[0].resource_ids[2]", "type")]),
    ("[]", [("$", "type")]), ("{", [("$", "json")]), ("null", [("$", "type")]), (None, None),
]


def test_manifests_broken_in_each_way(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i long, t string")
    got = {r["i"]: r["f"] for r in rows.select("i", schema.faults(schema.MANIFEST, F.col("t")).alias("f")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert (None if got[i] is None else [tuple(f) for f in got[i]]) == want, text


def test_other_schemas(spark):
    s = {"$defs": {"n": {"type": ["number", "null"], "minimum": 0.5}}, "type": "array", "maxItems": 3, "items": {"$ref": "#/$defs/n"}}
    rows = spark.createDataFrame([("[1,0.25,null]",), ("[1,2,3,4]",), ('["x"]',)], "t string")
    got = [[tuple(f) for f in r[0]] for r in rows.select(schema.faults(s, F.col("t"))).collect()]
    assert got == [[("$[1]", "minimum")], [("$", "maxItems")], [("$[0]", "type")]]
    assert [tuple(f) for f in rows.limit(1).select(schema.faults({"type": "object", "properties": {"a": {"enum": ["x"]}}}, F.lit('{"a":"y","b":1}'))).first()[0]] == [("$.a", "enum")]
    with pytest.raises(ValueError):
        schema.faults({"oneOf": []}, F.col("t"))


def test_a_tampered_signature_is_another_one(spark):
    from quarrystone.plans.integrity import _tampered

    made = [f'{{"algorithm":"Ed25519","signature":"{s}"}}' for s in ("AAbc", "ABbc", "BBbc", "-_bc")]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in made], "e string").select(_tampered(F.col("e"), F.lit("6"))).collect()]
    assert all(g != m and len(g) == len(m) for g, m in zip(got, made, strict=True))
