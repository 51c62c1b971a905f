"""URL functions as built-in expressions.

An address is cut by one pattern into scheme, authority, path, query and fragment, as RFC 3986
does, so nothing raises on odd input. Queries are read as forms write them: ``+`` and percent
escapes are decoded before names are compared, and encoded again afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
#: Query keys that only track, and path endings that are no pages.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "msclkid")
ASSET_ENDINGS = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".pdf", ".zip", ".mp4", ".mp3", ".mov", ".avi", ".css", ".js", ".xml", ".json",
    ".woff", ".woff2", ".ttf", ".eot",
)
SKIPPED_PREFIXES = ("#", "mailto:", "tel:", "javascript:", "data:")


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def hostname(url: Column) -> Column:
    """Lower-case host without user information and port."""
    return F.lower(F.regexp_extract(netloc(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def _join(s: Column, n: Column, p: Column, q: Column) -> Column:
    return F.concat(s, F.lit("://"), n, p, F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def normalize_url(url: Column) -> Column:
    """Trimmed, https where no scheme is given, without fragment; null for anything but http(s) with a host."""
    trimmed = F.btrim(url, F.lit(" \t\n\r\x0b\f"))
    full = F.when(trimmed.contains("://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    ok = (trimmed != "") & scheme(full).isin("http", "https") & (netloc(full) != "")
    return F.when(ok, _join(scheme(full), netloc(full), path(full), query(full)))


def host_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def _path_or_slash(url: Column) -> Column:
    return F.when(path(url) == "", F.lit("/")).otherwise(path(url))


def replay_link_key(url: Column) -> Column:
    """Scheme and authority in lower case, a path at least, the query, no fragment."""
    return _join(scheme(url), F.lower(netloc(url)), _path_or_slash(url), query(url))


def canonical_url(url: Column, mode: str = "normalize") -> Column:
    """Lower-case scheme and authority, a path at least, no fragment; the query kept, sorted or dropped.

    Sorting leaves out tracking keys and empty pairs and orders pairs as they are written;
    ``canonical_decoded`` decodes them first.
    """
    if mode == "drop":
        q = F.lit("")
    elif mode == "preserve":
        q = query(url)
    else:
        key = lambda p: F.lower(F.substring_index(p, "=", 1))
        kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~key(p).isin(*TRACKING_KEYS) & ~key(p).startswith("utm_"))
        q = F.array_join(F.array_sort(kept), "&")
    return _join(scheme(url), F.lower(netloc(url)), _path_or_slash(url), q)


def looks_like_page(url: Column) -> Column:
    return ~F.lower(path(url)).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in ASSET_ENDINGS) + ")$")


def followed(href: Column) -> Column:
    """False for fragments and for schemes that lead to no page; prefixes count as they are written."""
    return ~F.btrim(href).rlike("^(?:" + "|".join(SKIPPED_PREFIXES) + ")")


_BLANK = " \t\n\r\x0b\f\x1c\x1d\x1e\x1f"
#: Schemes whose addresses have relative references.
HIERARCHICAL = ("http", "https", "ftp", "file")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _parsed(url: Column) -> Column:
    """Scheme, authority, path, query and fragment as a struct of s, n, p, q and f; cut at single characters, which is cheaper than by patterns."""
    rest = lambda x, n: F.substring(x, n, F.length(x))

    def hierarchy(x: Column, a: Column, b: Column, s: Column, r: Column) -> Column:
        n = F.when(r.startswith("//"), F.substring_index(rest(r, F.lit(3)), "/", 1)).otherwise("")
        last = lambda n: F.struct(
            s.alias("s"), n.alias("n"), F.when(r.startswith("//"), rest(r, F.length(n) + 3)).otherwise(r).alias("p"), rest(a, F.length(b) + 2).alias("q"), rest(x, F.length(a) + 2).alias("f")
        )
        return bound(n, last)

    def cut(x: Column, a: Column, b: Column) -> Column:
        s = F.when(b.contains(":"), F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).otherwise("")
        return bound(s, lambda s: bound(F.when(s == "", b).otherwise(rest(b, F.length(s) + 2)), lambda r: hierarchy(x, a, b, s, r)))

    return bound(url, lambda x: bound(F.substring_index(x, "#", 1), lambda a: bound(F.substring_index(a, "?", 1), lambda b: cut(x, a, b))))


def _without_dots(p: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved, one segment after another; a ``..`` too many is dropped."""
    step = lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.array_append(kept, s))
    kept = F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), step)
    closed = F.when(p.rlike(r"(?:^|/)\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(closed, "/")).otherwise(p)


def resolve(base: Column, ref: Column) -> Column:
    """A reference against its base, as RFC 3986 resolves it; null if either is.

    White space around it goes, and line ends in it. An empty one gives the base, one with another scheme or on a base without
    hierarchy stays as it is, and the base's own scheme before a relative path is ignored. Slashes between merged paths become one; empty
    queries and fragments go.
    """
    rooted = lambda x: F.when((x == "") | x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
    mark = lambda sign, x: F.when(x == "", F.lit("")).otherwise(F.concat(F.lit(sign), x))

    def against(v: Column) -> Column:
        s, n, p, q, f = (v["r"][k] for k in "snpqf")
        b = v["b"]
        joined = bound(F.when(p.startswith("/"), p).otherwise(F.regexp_replace(F.concat(F.regexp_extract(b["p"], "(?s)^(.*/)[^/]*$", 1), p), "/{2,}", "/")), _without_dots)
        there = F.when(p == "", rooted(b["p"])).otherwise(bound(joined, lambda x: F.when(x == "", "/").otherwise(rooted(x))))
        own = F.concat(F.lower(F.when(s == "", b["s"]).otherwise(s)), F.lit("://"), n, rooted(p), mark("?", q), mark("#", f))
        inside = F.concat(F.lower(b["s"]), F.lit("://"), b["n"], there, mark("?", F.when((p == "") & (q == ""), b["q"]).otherwise(q)), mark("#", f))
        apart = ((s != "") & (F.lower(s) != F.lower(b["s"]))) | ~F.lower(b["s"]).isin(*HIERARCHICAL)
        return F.when(v["given"] == "", v["base"]).when(apart, v["given"]).when(n != "", own).otherwise(inside)

    given = F.btrim(ref, F.lit(_BLANK))
    plain = lambda v: F.struct(v["base"], v["given"], _parsed(v["base"]).alias("b"), _parsed(F.translate(v["given"], "\t\r\n", "")).alias("r"))
    found = bound(bound(F.struct(base.alias("base"), given.alias("given")), plain), against)
    return F.when(base.isNotNull() & ref.isNotNull(), found)


def site_name(url: Column) -> Column:
    host = F.when(hostname(url) == "", url).otherwise(hostname(url))
    return F.substring(F.regexp_replace(host, r"^www\.", ""), 1, 160)


def decoded(value: Column) -> Column:
    """A name or value of a query in plain text; a percent sign that starts no escape stands for itself."""
    return F.url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def encoded(value: Column) -> Column:
    """The inverse of ``decoded``: letters, digits and ``_.-~`` stay, a space becomes ``+``."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column) -> Column:
    """The query's decoded (key, value) structs in order; a bare name has an empty value."""
    written = F.filter(F.split(query(url), "&"), lambda p: p != "")
    value = lambda p: F.when(p.contains("="), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise("")
    return F.transform(written, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), decoded(value(p)).alias("value")))


def _query_of(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(encoded(p["key"]), F.lit("="), encoded(p["value"]))), "&")


def form_fields(body: Column) -> Column:
    """The fields of a form as a map; of a repeated field the last value counts, and fields without a value none."""
    pairs = F.filter(query_pairs(F.concat(F.lit("?"), F.regexp_replace(body, "#", "%23"))), lambda p: p["value"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def canonical_decoded(url: Column) -> Column:
    """``canonical_url`` with pairs compared and sorted as they read, then encoded in one way."""
    key = lambda p: F.lower(p["key"])
    kept = F.filter(query_pairs(url), lambda p: ~key(p).isin(*TRACKING_KEYS) & ~key(p).startswith("utm_"))
    return _join(scheme(url), F.lower(netloc(url)), _path_or_slash(url), _query_of(F.array_sort(kept)))


def diagnostic_url(url: Column) -> Column:
    """Without credentials and fragment, query values redacted, at most 1000 characters; other text at most 500."""
    port = F.regexp_extract(netloc(url), r":(\d{1,9})$", 1).try_cast("int")
    host = F.concat(hostname(url), F.when(port.between(1, 65535), F.concat(F.lit(":"), port.cast("string"))).otherwise(F.lit("")))
    names = F.transform(query_pairs(url), lambda p: F.struct(p["key"].alias("key"), F.lit("redacted").alias("value")))
    clean = F.substring(_join(scheme(url), host, path(url), _query_of(names)), 1, 1000)
    return F.when(url.isNull() | (url == ""), F.lit(None)).when(scheme(url).isin("http", "https"), clean).otherwise(F.substring(url, 1, 500))


_ADDRESS = r"(?i)https?://[^\s<>\"']+"


def safe_reason(text: Column, most: int = 240) -> Column:
    """A failure's text on one line, every address in it as ``diagnostic_url`` shows it."""
    given = F.when(F.coalesce(text, F.lit("")) == "", F.lit("Unknown error")).otherwise(text)
    line = F.trim(F.regexp_replace(given, r"(?U)[\s\x1c-\x1f]+", " "))
    around, addresses = F.split(line, _ADDRESS, -1), F.regexp_extract_all(line, F.lit(_ADDRESS), F.lit(0))
    told = F.concat(F.transform(addresses, diagnostic_url), F.array(F.lit("")))  # a text more than addresses
    return F.substring(F.array_join(F.zip_with(around, told, lambda a, b: F.concat(a, b)), ""), 1, most)


def split_patterns(value: Column) -> Column:
    """Patterns between commas and line ends, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[,\n\r]"), lambda p: F.btrim(p, F.lit(" \t"))), lambda p: p != "")


def glob_regex(glob: str) -> str:
    """A regular expression for a case-sensitive glob of ``*``, ``?``, ``[seq]`` and ``[!seq]``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "!" else i + 3) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", r"\^", 1) if body[0] == "^" else body) + "]")
            i = end
        else:
            out.append("\\" + c if c in r"\.^$+{}()|[]" else c)
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def matches_policy(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Path with query against globs: any of ``include``, if there are some, and none of ``exclude``."""
    q = query(url)
    target = F.concat(_path_or_slash(url), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    hit = lambda globs: target.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def is_web(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & (netloc(url) != ""), F.lit(False))


def outbound_problem(url: Column) -> Column:
    """Why an address may not be fetched, by its form alone: scheme, credentials or port; null if it may."""
    port = F.regexp_extract(netloc(url), r"^(?:.*@)?(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    return (
        F.when(~F.coalesce(scheme(url).isin("http", "https") & (hostname(url) != ""), F.lit(False)), "scheme").when(netloc(url).contains("@"), "credentials")
        .when((port != "") & (~port.rlike(r"^\d{1,5}$") | (port.try_cast("int") > 65535)), "port")
    )


def redirects_allowed(chain: Column) -> Column:
    """Every hop of a redirect must pass the outbound policy anew."""
    return F.forall(chain, lambda hop: outbound_problem(hop).isNull())


#: Usual endings of content types.
ENDINGS = {
    "application/javascript": ".js", "application/json": ".json", "application/pdf": ".pdf", "font/woff2": ".woff2", "image/gif": ".gif", "image/jpeg": ".jpg",
    "image/png": ".png", "image/svg+xml": ".svg", "image/webp": ".webp", "text/css": ".css", "text/html": ".html", "text/javascript": ".js", "text/plain": ".txt",
}


def asset_extension(url: Column, content_type: Column) -> Column:
    """The path's ending if it has at most 8 characters, else the content type's, else ``.bin``."""
    own = F.regexp_extract(path(url), r"[^/](\.[^./]{1,7})/*$", 1)
    kind = F.lower(F.btrim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    usual = F.try_element_at(F.create_map(*(F.lit(x) for kv in ENDINGS.items() for x in kv)), kind)
    return F.when(own != "", own).otherwise(F.coalesce(usual, F.lit(".bin")))


def archive_capture_url(timestamp: Column, url: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), timestamp, F.lit("id_/"), url)


def replay_reference(base: Column, raw: Column) -> Column:
    """What a stored page's reference stands for: a stored copy's own path, an archive's capture of it if the page is one, else ``resolve``."""

    def meant(v: Column) -> Column:
        raw, base, host, p = v["raw"], v["base"], v["host"], v["path"]
        behind = F.when(v["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), v["query"]))
        stamp, inside, original = v["stamp"], v["stamp"] != "", v["original"]
        web, archive = scheme(raw).isin("http", "https"), host == "web.archive.org"
        doubled = lambda s: p.contains(f"/{s}:/") & ~p.contains(f"/{s}://")
        return (
            F.when(p.startswith("/snapshots/"), F.concat(p, behind))
            .when(archive & doubled("http"), F.regexp_replace(raw, "/http:/", "/http://")).when(archive & doubled("https"), F.regexp_replace(raw, "/https:/", "/https://"))
            .when(web & archive & ~p.startswith("/web/") & inside, archive_capture_url(stamp, F.concat(original, p, behind))).when(web & ~archive & inside, archive_capture_url(stamp, raw))
            .when(web, raw).when(inside & raw.startswith("/"), archive_capture_url(stamp, F.concat(original, raw))).otherwise(resolve(base, raw))
        )

    at = lambda i: F.regexp_extract(base, r"^[a-z]+://web\.archive\.org/web/(\d+)(?:[a-z_]+)?/(https?://[^/?#]*)", i)
    told = F.coalesce(raw.contains("/snapshots/") | raw.contains("web.archive.org") | base.contains("web.archive.org"), F.lit(False))
    parts = F.struct(base.alias("base"), raw.alias("raw"), netloc(raw).alias("host"), path(raw).alias("path"), query(raw).alias("query"), at(1).alias("stamp"), at(2).alias("original"))
    plainly = F.when(raw.rlike("(?i)^https?:"), raw).otherwise(resolve(base, raw))
    return F.when(told, bound(parts, meant)).otherwise(plainly)


def archive_history_url(url: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/*/"), normalize_url(url))


def archived_original(url: Column) -> Column:
    """The address inside an archive address, else null."""
    found = F.regexp_extract(url, r"^https?://web\.archive\.org/web/\d+(?:[a-z]{2}_)?/(.+)$", 1)
    return F.when(found != "", found)


def local_return(value: Column, fallback: str = "/dashboard") -> Column:
    v = F.btrim(F.coalesce(value, F.lit("")))
    ok = v.startswith("/") & ~v.startswith("//") & (F.length(v) <= 4096)
    return F.when(ok, v).otherwise(F.lit(fallback))
