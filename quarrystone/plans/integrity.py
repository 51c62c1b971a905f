"""Queries on canonical JSON, schemas and signatures of manifests, keyed digests and multipart forms.

The tables hold no JSON of this kind, so it is made of what rows hold, with faults where their language, length or digest says so; SQL
says from these what must be found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ed25519, forms, json_kernels, keyed, schema, text
from ..operators import manifests
from ..sources.shared import fresh_folder
from ..sources.tables import Archive
from .registry import query


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


_THIRD = "n_chars % 3 = 0"
_CANONICAL = """'{"a":' || n_chars || ',"big":9007199254740991,"list":["x","ok","ok"],"meta":{"deep":{"k":[true,null,{}]},"n":' || n_chars || '},"z":' || to_json(text) || '}'"""


@query(
    f"""select doc_id, if(fault is null, 'sha256:' || rtrim(replace(replace(base64(unhex(sha256({_CANONICAL}))), '+', '-'), '/', '_'), '='), null) as digest, split_part(fault, ' ', 2) as path, replace(split_part(fault, ' ', 1), '_', ' ') as problem from (
    select *, case when n_chars % 11 = 0 then 'not_JSON $' when lang = 'fr' and {_THIRD} then 'not_composed $.list[1]' when lang = 'es' and {_THIRD} then 'surrogate $.list[2]' when n_chars % 7 = 0 then 'fraction $.meta.n'
      when lang = 'de' and {_THIRD} then 'key $.meta.deep' when n_chars > 3000 then 'integer_range $.big' end as fault from documents)"""
)
def jsn1_canonical_documents(a: Archive):
    third = F.expr(_THIRD)
    made = _joined(
        '{ "z" : ', text.json_text(F.col("text")), ',\n"list":["x", ', F.when((F.col("lang") == "fr") & third, '"é"').otherwise('"ok"'), ",", F.when((F.col("lang") == "es") & third, '"\\ud800"').otherwise('"\\u006fk"'),
        '],\t"meta":{"n":', F.when(F.col("n_chars") % 7 == 0, _joined(F.col("n_chars"), ".5")).otherwise(F.col("n_chars").cast("string")), ',"deep":{"', F.when((F.col("lang") == "de") & third, "ß").otherwise("k"),
        '":[true,null, {}]}},"big":', F.when(F.col("n_chars") > 3000, "9007199254740992").otherwise("9007199254740991"), ',"a":0,"a":', F.col("n_chars"), F.when(F.col("n_chars") % 11 == 0, "").otherwise(" }"),
    )
    rows = a.raw("documents").select("doc_id", json_kernels.canonical(made).alias("c"))
    return rows.select("doc_id", text.digest_wire(F.sha2("c.canonical", 256)).alias("digest"), "c.path", "c.problem")


_BREAKS = {
    "0": "$.site_id required", "1": "$.extra additionalProperties", "2": "$.pages[0].status maximum", "3": "$.pages[0].status type", "4": "$.captured_at format", "5": "$.pages minItems", "6": "$.resources[0].digest pattern",
    "7": "$.pages[0].resource_ids uniqueItems", "8": "$.pages[0].source_url format", "9": "$.resources[0].bytes minimum", "a": "$.pages[0].bytes type", "b": "$.resources[0].content_type minLength",
    "c": "$.entry_page_id pattern; $.extra additionalProperties; $.pages[0].final_url required; $.resources[0] type", "d": "$ json",
}


def _manifest() -> Column:
    """A manifest of a page with one resource, as JSON."""
    hexed = F.sha2("html", 256)
    opaque = lambda kind, c: _joined(kind, "_", F.left(F.sha2(c.cast("string"), 256), F.lit(20)))
    stored = lambda n: _joined('"status":200,"content_type":"text/html","bytes":', n, ',"digest":"', text.digest_wire(hexed), '"')
    resource = _joined('{"id":"', opaque("resource", F.col("html")), '","source_url":"","final_url":"",', stored(F.length("html")), "}")
    page = _joined('{"id":"', opaque("page", F.col("url")), '","source_url":', text.json_text(F.col("url")), ',"final_url":', text.json_text(F.col("url")), ",", stored(F.octet_length("html")), ',"resource_ids":["', opaque("resource", F.col("html")), '"]}')
    head = _joined('{"schema":"archive-manifest.v1","format_version":"1.0","manifest_id":"', opaque("manifest", F.col("page_id")), '","archive_id":"', opaque("archive", F.lit("a")), '","site_id":"', opaque("site", F.col("url")), '","capture_id":"')
    return _joined(head, opaque("capture", F.col("page_id")), '","captured_at":"2024-01-01T00:00:00Z","entry_page_id":"', opaque("page", F.col("url")), '","pages":[', page, '],"resources":[', resource, "]}")


@query("select page_id, coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in _BREAKS.items()) + "}[left(sha256(html), 1)], '') as faults from pages")
def int3_schema_faults(a: Archive):
    k = F.left(F.sha2("html", 256), F.lit(1))
    swap = lambda pattern, new: F.regexp_replace("m", pattern, new)
    broken = (
        F.when(k == "0", swap('"site_id":"[^"]*",', "")).when(k == "1", swap("}$", ',"extra":{"a":1}}')).when(k == "2", swap('^(.*?)"status":200', '$1"status":1000')).when(k == "3", swap('^(.*?)"status":200', '$1"status":"200"'))
        .when(k == "4", swap("T00:00:00Z", " 00:00")).when(k == "5", swap(r'"pages":\[.*?\]\}\],', '"pages":[],')).when(k == "6", swap('.{3}"\\}\\]\\}$', '"}]}')).when(k == "7", swap(r'"resource_ids":\["([^"]*)"', '"resource_ids":["$1","$1"'))
        .when(k == "8", swap('^(.*?)"source_url":"', '$1"source_url":"no address ')).when(k == "9", swap('"bytes":(\\d+)(?=[^{]*$)', '"bytes":-$1')).when(k == "a", swap('^(.*?)"bytes":(\\d+)', '$1"bytes":$2.5')).when(k == "b", swap('text/html(?=[^{]*$)', ""))
        .when(k == "c", F.regexp_replace(F.regexp_replace(F.regexp_replace(swap('"final_url":"[^"]+",', ""), r'"resources":\[.*\]', '"resources":[[]]'), "entry_page_id\":\"page", "entry_page_id\":\"site"), "^\\{", '{"extra":null,'))
        .when(k == "d", swap("}$", "")).otherwise(F.col("m"))
    )
    rows = a.raw("pages").select("page_id", _manifest().alias("m"), "html").select("page_id", broken.alias("m"))
    faults = rows.withColumn("f", schema.faults(schema.MANIFEST, F.col("m")))
    return faults.select("page_id", F.array_join(F.transform("f", lambda x: F.concat(x["path"], F.lit(" "), x["rule"])), "; ").alias("faults"))


_SECRET = bytes(range(32))
_TAMPERED = {
    "0": "fields", "1": "fields", "2": "version", "3": "key", "4": "$.pages[0].bytes minimum", "5": "signature", "6": "signature", "7": "signature", "8": "payload", "9": "signature", "a": "fields",
}


def _tampered(e: Column, k: Column) -> Column:
    """An envelope changed as a digit says; each change to a signature gives another one, whatever it was."""
    swap = lambda pattern, new: F.regexp_replace(e, pattern, new)
    other = F.when(k == "0", swap(",\"signature\":\"[^\"]*\"", "")).when(k == "1", swap("^\\{", '{"x":1,')).when(k == "2", swap('"Ed25519"', '"RSA"')).when(k == "3", swap("key_one", "key_two"))
    other = other.when(k == "4", swap('"bytes":(\\d)(?=.*"final_url":"h)', '"bytes":-$1')).when(k == "5", swap('"status":200', '"status":201')).when(k == "6", F.when(e.contains('signature":"A'), swap('signature":".', 'signature":"B')).otherwise(swap('signature":".', 'signature":"A'))).when(k == "7", swap('"signature":"([^"]{10})', '"signature":"'))
    other = other.when(k == "8", swap('"payload":.*,"schema"', '"payload":[],"schema"')).when(k == "9", swap('"signature":"', '"signature":"*')).when(k == "a", F.substring(e, F.lit(1), F.length(e) - 1))
    spaced = F.regexp_replace(e, '^\\{"algorithm":"Ed25519",(.*),"signature":("[^"]*")\\}$', '{"signature" : $2,\n$1, "algorithm":"Ed25519"}')
    return other.when(k == "b", spaced).otherwise(e)


@query("select page_id, map {" + ", ".join(f"'{k}': '{v}'" for k, v in _TAMPERED.items()) + "}[left(sha256(html), 1)] as problem, strlen(html)::bigint as bytes from pages")
def int4_signed_manifests(a: Archive):
    """Manifests are signed, written, read back, changed as their page's digest says, and verified."""
    made = manifests.signed(a.raw("pages").select("page_id", F.left(F.sha2("html", 256), F.lit(1)).alias("k"), F.octet_length("html").cast("long").alias("bytes"), _manifest().alias("payload")), "key_one", _SECRET)
    folder = fresh_folder(a.spark, "envelopes")
    made.select("page_id", "k", "bytes", "envelope").write.json(folder)
    back = a.spark.read.schema("page_id long, k string, bytes long, envelope string").json(folder)
    changed = back.withColumn("envelope", _tampered(F.col("envelope"), F.col("k")))
    return manifests.verified(changed, "key_one", ed25519.public_of(_SECRET)).select("page_id", "problem", "bytes")


def _pad(key: bytes, byte: int) -> str:
    """A constant key's pad as a DuckDB literal."""
    return "unhex('" + bytes(x ^ byte for x in key.ljust(64, b"\0")).hex() + "')"


_KEYS = {"en": "key of English", "fr": "clé " * 20, "de": ""}
_VALUE = "source || '.' || doc_id"


def _marked(key: str) -> str:
    import hashlib

    raw = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    return f"sha256({_pad(raw, 0x5C)} || unhex(sha256({_pad(raw, 0x36)} || encode({_VALUE}))))"


@query(
    f"""select doc_id, case lang {" ".join(f"when '{k}' then {_marked(v)}" for k, v in _KEYS.items())} else {_marked("other")} end as mark,
    if(n_chars % 4 = 0 or n_chars % 4 = 1 and lang <> 'es', null, {_VALUE}) as value from documents"""
)
def hsh4_signed_values(a: Archive):
    key = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _KEYS.items() for x in kv)), "lang"), F.lit("other"))
    rows = a.raw("documents").select("doc_id", "lang", "n_chars", F.concat_ws(".", "source", "doc_id").alias("value"), key.alias("key"))
    signed = rows.withColumn("signed", keyed.signed(F.col("value"), F.col("key")))
    changed = F.when(F.col("n_chars") % 4 == 0, F.concat(F.lit("x"), F.col("signed"))).otherwise(F.col("signed"))
    asked = F.when(F.col("n_chars") % 4 == 1, F.lit("other")).otherwise(F.col("key"))
    read = signed.withColumn("read", changed).withColumn("asked", asked)
    return read.select("doc_id", F.substring_index("signed", ".", -1).alias("mark"), keyed.unsigned(F.col("read"), F.col("asked")).alias("value"))


_ROUNDS = 12
_HMAC = "sha256(xor(key::bit, o::bit)::blob || unhex(sha256(xor(key::bit, i::bit)::blob || {0})))"


@query(
    f"""with recursive k as (select n_nationkey as id, repeat(n_name, 1 + n_nationkey % 12) as password, 'salt' || n_regionkey as salt, repeat('\\x36'::blob, 64) as i, repeat('\\x5C'::blob, 64) as o from nation),
    p as (select id, salt, i, o, if(strlen(password) > 64, unhex(sha256(password)), encode(password)) as raw from k), q as (select id, salt, i, o, raw || repeat('\\x00'::blob, 64 - octet_length(raw)) as key from p),
    r as (select id, key, i, o, 1 as n, {_HMAC.format("encode(salt) || unhex('00000001')")} as u, {_HMAC.format("encode(salt) || unhex('00000001')")} as s from q
      union all select id, key, i, o, n + 1, v, lower(hex(xor(unhex(s)::bit, unhex(v)::bit)::blob)) from (select *, {_HMAC.format("unhex(u)")} as v from r where n < {_ROUNDS}))
    select id, s as digest, id % 2 = 0 as matches from r where n = {_ROUNDS}"""
)
def hsh4_passwords(a: Archive):
    """Passwords are tried against what is stored for them; every other one is another user's."""
    rows = a.raw("nation").select(F.col("n_nationkey").alias("id"), F.expr("repeat(n_name, cast(1 + n_nationkey % 12 as int))").alias("password"), F.concat(F.lit("salt"), F.col("n_regionkey")).alias("salt"))
    digests = rows.withColumn("digest", keyed.pbkdf2_sha256(F.col("password"), F.col("salt"), _ROUNDS))
    stored = F.concat("salt", F.lit("$"), F.base64(F.unhex("digest")))
    tried = F.when(F.col("id") % 2 == 0, F.col("password")).otherwise(F.reverse("password"))
    return digests.select("id", "digest", keyed.password_matches(tried, stored, _ROUNDS).alias("matches"))


@query(
    """select doc_id, case lang when 'es' then null when 'fr' then source || chr(13) || chr(10) else source end as source, if(lang in ('es', 'de'), null, text) as text, if(lang = 'es', null, 'a;"' || lang || '".txt') as filename, if(lang = 'es', null, sha256(text)) as file_digest,
    case lang when 'es' then 'no multipart form' when 'fr' then 'not closed' when 'de' then 'headers without an end' end as problem from documents"""
)
def src14_multipart_forms(a: Archive):
    """Forms made of documents: a repeated field, a text, a file, a part that is none; German ones have a part without headers, French ones no end, Spanish ones no boundary."""
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\r\n"))
    field = lambda about, value, more="": F.concat(line("--b'1--x"), line("Content-Disposition: form-data; ", about), F.lit(more), line(""), line(value))
    text_part = F.when(F.col("lang") == "de", F.concat(line("--b'1--x"), line('Content-Disposition: form-data; name="text"'))).otherwise(field('name="text"', F.col("text"), "Content-Type: text/plain;\r\n charset=UTF-8\r\n"))
    body = F.concat(
        F.lit("preamble\r\n"), field("name=source", F.lit("first")), text_part, field(F.concat(F.lit('name="file"; filename="a;\\"'), F.col("lang"), F.lit('\\".txt"')), F.col("text"), "content-type: APPLICATION/x; y=z\r\n"),
        F.concat(line("--b'1--x"), line("Content-Disposition: attachment; name=z"), line(""), line("no form data")), field('name="source"', F.col("source")), F.when(F.col("lang") == "fr", "").otherwise("--b'1--x--\r\nepilogue"),
    )
    kind = F.when(F.col("lang") == "es", "multipart/form-data").otherwise("Multipart/Form-Data; charset=x; boundary=\"b'1--x\"")
    rows = forms.with_fields(a.raw("documents").select("doc_id", kind.alias("content_type"), body.cast("binary").alias("body")), name="f")
    of = lambda name: F.get(F.filter("f", lambda x: x["name"] == name), F.lit(0))
    problem = F.get(F.filter("f", lambda x: x["problem"].isNotNull()), F.lit(0))["problem"]
    return rows.select("doc_id", of("source")["value"].alias("source"), of("text")["value"].alias("text"), of("file")["filename"].alias("filename"), F.sha2(of("file")["body"], 256).alias("file_digest"), problem.alias("problem"))
