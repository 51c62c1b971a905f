"""Signatures, keyed digests and multipart forms against published vectors and the standard library."""

import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import ed25519, forms, keyed
from quarrystone.operators import manifests

from .test_integrity import GOOD

#: The first three vectors of RFC 8032: secret, public, message, signature.
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


@pytest.mark.parametrize("vector", VECTORS)
def test_published_signatures(vector):
    secret, public, message, signature = map(bytes.fromhex, vector)
    assert ed25519.public_of(secret) == public and ed25519.sign(secret, message) == signature and ed25519.verify(public, message, signature)
    for i in range(64):
        bad = bytearray(signature)
        bad[i] ^= 1 << i % 8
        assert not ed25519.verify(public, message, bytes(bad))
    assert not ed25519.verify(public, message + b"x", signature) and not ed25519.verify(public, message, signature[:63])
    more = (int.from_bytes(signature[32:], "little") + ed25519.ORDER).to_bytes(32, "little")
    assert not ed25519.verify(public, message, signature[:32] + more)  # one form only
    for key in (b"", b"\xff" * 32, bytes(31), (2).to_bytes(32, "little")):
        assert not ed25519.verify(key, message, signature)
    with pytest.raises(ValueError):
        ed25519.sign(b"short", message)


def test_base_point_table():
    assert all(ed25519.bytes_of(ed25519.times_base(n)) == ed25519.bytes_of(ed25519.times(n, ed25519.BASE)) for n in (0, 1, 2, 15, 16, 12345678901234567890, ed25519.ORDER - 1))
    assert ed25519.bytes_of(ed25519.times_base(ed25519.ORDER)) == ed25519.bytes_of(ed25519.NEUTRAL)


def test_envelopes(spark):
    secret = bytes(range(32))
    public = ed25519.public_of(secret)
    rows = [(1, json.dumps(GOOD, indent=1)), (2, json.dumps(GOOD | {"format_version": "2"})), (3, '{"a":1.5}'), (4, None), (5, "{")]
    made = manifests.signed(spark.createDataFrame(rows, "id long, payload string"), 'key "one"', secret)
    got = {r["id"]: (r["problem"], r["envelope"]) for r in made.collect()}
    assert [got[i][0] for i in range(1, 6)] == [None, "$.format_version const", "$.a fraction", "payload", "$ not JSON"] and [got[i][1] is None for i in range(1, 6)] == [False, True, True, True, True]
    e = json.loads(got[1][1])
    assert e["payload"] == GOOD and got[1][1] == json.dumps(e, sort_keys=True, separators=(",", ":"))
    tries = [
        (e, None), (dict(reversed(e.items())), None), (e | {"x": 1}, "fields"), ({k: v for k, v in e.items() if k != "schema"}, "fields"), (e | {"algorithm": "none"}, "version"), (e | {"key_id": "x"}, "key"), (e | {"payload": "x"}, "payload"), (e | {"payload": GOOD | {"pages": []}}, "$.pages minItems"),
        (e | {"payload": GOOD | {"captured_at": "2024-02-02T00:00:00Z"}}, "signature"), (e | {"signature": e["signature"][:-2]}, "signature"), (e | {"signature": "*"}, "signature"), (e | {"signature": None}, "signature"),
    ]
    rows = spark.createDataFrame([(i, json.dumps(t, indent=2)) for i, (t, _) in enumerate(tries)] + [(98, None), (99, "{")], "id long, envelope string")
    got = {r["id"]: r["problem"] for r in manifests.verified(rows, 'key "one"', public).collect()}
    assert got == {i: p for i, (_, p) in enumerate(tries)} | {98: "fields", 99: "fields"}
    assert manifests.verified(rows.where("id = 0"), 'key "one"', ed25519.public_of(bytes(32))).first()["problem"] == "signature"


def test_hmac(spark):
    keys = ["", "key", "k" * 64, "k" * 65, "é" * 40, None]
    rows = spark.createDataFrame([(k, m) for k in keys for m in ("", "The quick brown fox", "x.y", "é", None)], "k string, m string")
    for r in rows.select("k", "m", keyed.hmac_sha256(F.col("k"), F.col("m")).alias("h"), keyed.signed(F.col("m"), F.col("k")).alias("s")).collect():
        want = None if r["k"] is None or r["m"] is None else hmac.new(r["k"].encode(), r["m"].encode(), hashlib.sha256).hexdigest()
        assert r["h"] == want and r["s"] == (want and f"{r['m']}.{want}")
    back = rows.where("k is not null and m is not null").withColumn("s", keyed.signed(F.col("m"), F.col("k")))
    assert back.where(keyed.unsigned(F.col("s"), F.col("k")) != F.col("m")).count() == 0
    assert back.select(keyed.unsigned(F.concat("s", F.lit("0")), F.col("k")).alias("a"), keyed.unsigned(F.col("s"), F.lit("other")).alias("b"), keyed.unsigned(F.lit("nodot"), F.col("k")).alias("c")).where("coalesce(a, b, c) is not null").count() == 0
    # RFC 4231, cases 1 and 6
    assert spark.range(1).select(keyed.hmac_sha256(F.lit(b"\x0b" * 20), F.lit("Hi There"))).first()[0] == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"
    assert spark.range(1).select(keyed.hmac_sha256(F.lit(b"\xaa" * 131), F.lit("Test Using Larger Than Block-Size Key - Hash Key First"))).first()[0] == "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"


def test_passwords(spark):
    rows = spark.createDataFrame([("password", "salt"), ("pässword" * 20, "x"), ("", "")], "p string, s string")
    for rounds in (1, 2, 300):
        for r in rows.select("p", "s", keyed.pbkdf2_sha256(F.col("p"), F.col("s"), rounds).alias("d")).collect():
            assert r["d"] == hashlib.pbkdf2_hmac("sha256", r["p"].encode(), r["s"].encode(), rounds).hex()
    stored = "salt$" + base64.b64encode(hashlib.pbkdf2_hmac("sha256", b"password", b"salt", 50)).decode()
    tries = spark.createDataFrame([("password", stored, True), ("Password", stored, False), ("password", stored[5:], False), ("password", None, False), ("password", "salt$" + stored[6:], False), (None, stored, False)], "p string, s string, want boolean")
    assert tries.where(keyed.password_matches(F.col("p"), F.col("s"), 50) != F.col("want")).count() == 0


FORM = 'multipart/form-data; boundary="a b"'
FORMS = [
    (FORM, b"--a b\r\nContent-Disposition: form-data; name=x\r\n\r\n1\r\n--a b--", [("x", None, "1", None, None)]),
    (FORM, b"--a b\r\nContent-Disposition: form-data; name=x\r\n\r\n1\r\n--a b\r\nContent-Disposition: form-data; name=\"x\"\r\n\r\n\r\n--a b--\r\n", [("x", None, "", None, None)]),
    (FORM, b"--a b \nContent-Disposition: FORM-DATA;\n name=\"q\\\"1\"; filename=\"f;g\"\nContent-Type: Image/PNG; x=y\n\n\x00\xff\r\n--a bc\r\n\n--a b--", [('q"1', "f;g", None, b"\x00\xff\r\n--a bc\r\n", None)]),
    (FORM, b"--a b\r\nContent-Disposition: form-data; name=x\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n\xe9\r\n--a b\r\nContent-Disposition: form-data; name=y\r\n\r\n\xe9\r\n--a b--", [("x", None, "é", None, None), ("y", None, None, b"\xe9", "text that isn't of its charset")]),
    (FORM, b"--a b\r\n\r\nno headers\r\n--a b\r\nContent-Disposition: form-data\r\n\r\nno name\r\n--a b--", []),
    (FORM, b"--a b\r\nContent-Disposition: form-data; name=x\r\n--a b--", [(None, None, None, None, "headers without an end")]),
    (FORM, b"--a b\r\nContent-Disposition: form-data; name=x\r\n\r\n1", [("x", None, "1", None, None), (None, None, None, None, "not closed")]),
    (FORM, b"", [(None, None, None, None, "no boundary in the body")]), (FORM, b"--a b--", []), ("multipart/form-data", b"--\r\n", [(None, None, None, None, "no multipart form")]), ("text/plain; boundary=x", b"", [(None, None, None, None, "no multipart form")]), (None, b"", [(None, None, None, None, "no multipart form")]),
]


def test_multipart_forms(spark):
    rows = spark.createDataFrame([(i, t, bytearray(b)) for i, (t, b, _) in enumerate(FORMS)] + [(99, FORM, None)], "i long, t string, b binary")
    got = {r["i"]: r["f"] for r in rows.select("i", forms.multipart("t", "b").alias("f")).collect()}
    for i, (_, body, want) in enumerate(FORMS):
        assert [(f["name"], f["filename"], f["value"], None if f["body"] is None else bytes(f["body"]), f["problem"]) for f in got[i]] == want, body
    assert got[99] is None and got[2][0]["content_type"] == "image/png"
    many = b"".join(b"--a b\r\nContent-Disposition: form-data; name=n%d\r\n\r\n%d\r\n" % (i % 150, i) for i in range(160)) + b"--a b--"
    found = forms.fields_of(FORM, many)
    assert len(found) == forms.MOST and found[3]["value"] == "153" and found[50]["value"] == "50"


def test_forms_are_answered_in_small_batches(spark):
    from pyspark.sql import functions as F

    from quarrystone.functions import forms

    body = F.concat(F.lit('--b\r\nContent-Disposition: form-data; name="n"\r\n\r\n'), F.col("id").cast("string"), F.lit("\r\n--b--")).cast("binary")
    rows = spark.range(0, 200, 1, 1).select("id", F.lit("multipart/form-data; boundary=b").alias("content_type"), F.when(F.col("id") != 7, body).alias("body"))
    found = forms.with_fields(rows)
    assert {r["id"]: r["fields"] and r["fields"][0]["value"] for r in found.collect()} == {i: None if i == 7 else str(i) for i in range(200)} and found.columns == ["id", "fields"]
