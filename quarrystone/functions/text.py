"""Text, digest and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_size(n: Column) -> Column:
    """Bytes in steps of 1024, with one decimal, ties to even, from KB to TB; null counts as 0."""
    n = F.coalesce(n, F.lit(0))
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        below = n < 1024 ** (i + 1) if unit != "TB" else F.lit(True)
        out = out.when(below, F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(1024**i)), 1)), F.lit(f" {unit}")))
    return out


def initials(name: Column) -> Column:
    """First letters of the first two words, in capitals; a question mark without any."""
    words = F.filter(F.split(F.btrim(name), r"\s+"), lambda w: w != "")
    letters = F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.coalesce(letters, F.lit("")) == "", F.lit("?")).otherwise(letters)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def excerpt(text: Column, term: str, radius: int = 90) -> Column:
    """The first hit with ``radius`` characters around it and marks where text was cut; null without a hit."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(at - radius, F.lit(1))
    end = F.least(at + len(term) + radius, F.length(text) + 1)
    cut = F.btrim(F.substring(text, start, end - start))
    dots = F.lit("…")
    return F.when(at > 0, F.concat(F.when(start > 1, dots).otherwise(F.lit("")), cut, F.when(end <= F.length(text), dots).otherwise(F.lit(""))))


def asset_number(asset_id: Column) -> Column:
    found = F.regexp_extract(asset_id, r"^asset_(\d+)$", 1)
    return F.when(found != "", found.cast("long"))


def asset_kind(content_type: Column) -> Column:
    """css, script, image, font or other; the first that fits."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(t.contains("css"), "css").when(t.contains("javascript") | t.contains("ecmascript"), "script").when(t.startswith("image/"), "image").when(t.contains("font"), "font").otherwise("other")


def image_type(body: Column) -> Column:
    """Image type by leading bytes, else null."""
    head = F.hex(F.substring(body, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def digest_wire(hexed: Column) -> Column:
    """``sha256:`` and unpadded URL-safe base64 of a hex digest."""
    b64 = F.translate(F.base64(F.unhex(hexed)), "+/", "-_")
    return F.concat(F.lit("sha256:"), F.rtrim(b64, F.lit("=")))


def digest_hex(wire: Column) -> Column:
    """The hex digest of its wire form; null for other text."""
    body = F.translate(F.regexp_extract(wire, r"^sha256:([A-Za-z0-9_-]{43})$", 1), "-_", "+/")
    return F.when(body != "", F.lower(F.hex(F.unbase64(F.concat(body, F.lit("="))))))


def json_text(c: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with its keys in order."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"})


def exact_keys(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no others."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def contains_any(needle: str, *cols: Column) -> Column:
    """Substring search over several columns, the needle trimmed, in lower case and at most 200 long."""
    q = needle.strip().lower()[:200]
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(q)
    return hit if q else F.lit(True)
