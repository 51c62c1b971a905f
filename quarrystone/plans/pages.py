"""Queries on page markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, html_kernels, text
from ..operators import secrets
from ..sources.tables import Archive
from .registry import query

_TITLE = r"left(trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '[\s\x{00A0}]+', ' ', 'g')), 160)"
_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g'))"


@query(f"select page_id, nullif({_TITLE}, '') as title from pages")
def htm1_titles(a: Archive):
    return a.raw("pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(f"select page_id, replace(replace(replace(replace(nullif({_TITLE}, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') as title from pages")
def htm1_titles_decoded(a: Archive):
    return a.raw("pages").select("page_id", html_kernels.unescape_cut(html.title(F.col("html"))).alias("title"))


@query(f"select page_id, {_VISIBLE} as body from pages")
def htm2_visible_text(a: Archive):
    return a.raw("pages").select("page_id", html.visible_text(F.col("html")).alias("body"))


@query(f"select page_id, if(page_id % 10 = 9, '', {_VISIBLE}) as body from pages")
def htm2_search_text(a: Archive):
    kind = F.when(F.col("page_id") % 10 == 9, "image/png").otherwise("text/html")
    return a.raw("pages").select("page_id", html.search_text(F.col("html"), kind).alias("body"))


@query(r"""select page_id, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l) as href from (select page_id, regexp_extract_all(html, '(?is)<(?:a|area)\b[^>]*?\shref\s*=\s*"([^"]*)"', 1) as l from pages)""")
def htm4_links(a: Archive):
    return a.raw("pages").select("page_id", F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href"))


@query(r"""select page_id, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l) as href from (select page_id, regexp_extract_all(html, '(?is)<(?:a|area)\b[^>]*?\shref\s*=\s*"([^"]*)"', 1) as l from pages)""")
def htm4_links_parsed(a: Archive):
    return a.raw("pages").select("page_id", F.posexplode(html_kernels.links(F.col("html"))).alias("pos", "href"))


@query(
    r"""select page_id, (length(html) - length(replace(lower(html), '<script', '<scrip')))::bigint as scripts, (length(html) - length(replace(lower(html), '<form', '<for')))::bigint as forms,
    len(regexp_extract_all(html, '(?i)<(?:iframe|frame)\b'))::bigint as frames, len(regexp_extract_all(html, '(?i)<a\b'))::bigint as anchors from pages"""
)
def htm14_quality_counts(a: Archive):
    h = F.col("html")
    return a.raw("pages").select("page_id", html.tag_count(h, "script").alias("scripts"), html.tag_count(h, "form").alias("forms"), html.tag_count(h, "iframe", "frame").alias("frames"), html.tag_count(h, "a").alias("anchors"))


#: The pages hold links and bold text, but no images, frames or markers; here links become other references, by what
#: the page itself says. SQL reads the expected facts from the page as it is.
_LANG, _LINK = r'<html lang="([a-z]+)"', r'<a href="([^"]*)"'
_FACTS = f"""(select page_id, url, html, regexp_extract(html, '{_LANG}', 1) as lang, regexp_extract_all(html, '{_LINK}', 1) as l from pages)"""
_REFS = r"list_sort(list_distinct(list_filter(list_transform(l, lambda x: regexp_extract(x, '^/([A-Za-z0-9._~-]+)', 1)), lambda x: x <> '')))"
_BOLD = "(length(html) - length(replace(html, '<b>', '')))::bigint // 3"


def _lang():
    return F.regexp_extract("html", _LANG, 1)


def _swap(old: str, new: str):
    return F.replace(F.col("html"), F.lit(old), F.lit(new))


def _as_stored():
    """Links as addresses of stored assets."""
    return _swap('<a href="/', '<a href="/snapshots/s1/asset/')


@query(
    f"""select page_id, case lang when 'fr' then 'html_link' when 'de' then 'html_asset' when 'es' then 'html_srcset' else 'inline_css' end as stage, u as url from (
    select page_id, lang, unnest(if(lang = 'es', list_filter(list_transform(flatten(list_transform(l, lambda x: string_split(x, ','))), lambda x: split_part(trim(x), ' ', 1)), lambda x: x <> ''), l)) as u from {_FACTS})"""
)
def htm11_resources(a: Archive):
    styled = F.regexp_replace("html", _LINK, '<a style="background:url($1)"')
    body = F.when(_lang() == "fr", _swap('<a href="', '<link rel="icon" href="')).when(_lang() == "de", _swap('<a href="', '<img alt="" src="')).when(_lang() == "es", _swap('<a href="', '<img srcset="')).otherwise(styled)
    return a.raw("pages").select("page_id", F.explode(html.resources(body)).alias("r")).select("page_id", "r.stage", "r.url")


@query(f"select page_id, url as base, nullif(trim(l[1]), '') as frame, {_BOLD} as bare_images, {_REFS} as local_refs from {_FACTS}")
def htm6_base_and_references(a: Archive):
    based = F.concat(F.lit('<base target=x href="'), F.col("url"), F.lit('">'), F.col("html"))
    return a.raw("pages").select(
        "page_id", html.base_href(based).alias("base"), html.first_frame(_swap("<a href=", "<frame name=x src=")).alias("frame"),
        html.images_without_source(_swap("<b>", '<img alt="x">')).alias("bare_images"), F.array_sort(html.local_references(_as_stored())).alias("local_refs"),
    )


_MISSING = f"len(list_filter({_REFS}, lambda x: regexp_matches(x, '^[A-Z]')))"


def _missing():
    """References whose object was never stored: here those in capitals."""
    return F.filter(html.local_references(_as_stored()), lambda x: x.rlike("^[A-Z]"))


@query(f"select page_id, case when {_MISSING} > 0 then 'problems' when {_BOLD} > 0 then 'warnings' else 'complete' end as status from {_FACTS}")
def htm14_quality_status(a: Archive):
    bare = html.images_without_source(_swap("<b>", '<img alt="x">'))
    return a.raw("pages").select("page_id", html.quality_status(F.size(_missing()), bare).alias("status"))


@query(
    f"""select page_id, case when {_MISSING} > 0 then 'Problems' when {_BOLD} > 0 then 'Warnings' else 'Complete' end as label,
    coalesce(n, 0) || ' local assets · ' || len(l) || ' remote dependencies · ' || {_MISSING} || ' missing local resources · ' || {_BOLD} || ' images without a source' as facts,
    list_filter({_REFS}, lambda x: regexp_matches(x, '^[A-Z]'))[:10] as shown
    from {_FACTS} left join (select snapshot_id, count(*) as n from assets group by snapshot_id) on snapshot_id = page_id""",
    ("assets",),
)
def htm19_quality_labels(a: Archive):
    stored = a.assets.groupBy(F.col("snapshot_id").alias("page_id")).agg(F.count("*").alias("n"))
    bare = html.images_without_source(_swap("<b>", '<img alt="x">'))
    rows = a.raw("pages").select("page_id", F.array_sort(_missing()).alias("missing"), bare.alias("bare"), F.size(html.hrefs(F.col("html"))).alias("remote")).join(stored, "page_id", "left")
    facts = html.quality_facts(F.coalesce("n", F.lit(0)), F.col("remote"), F.size("missing"), F.col("bare"))
    return rows.select("page_id", html.quality_label(html.quality_status(F.size("missing"), F.col("bare"))).alias("label"), facts.alias("facts"), F.slice("missing", 1, 10).alias("shown"))


@query(f"select page_id, if(lang in ('en', 'fr'), nullif(trim(l[1]), ''), null) as frame from {_FACTS}")
def htm7_first_frames(a: Archive):
    framed = F.when(_lang().isin("en", "fr"), _swap("<a href=", "<FRAME name=a src=")).otherwise(F.col("html"))
    return a.raw("pages").select("page_id", html.first_frame(framed).alias("frame"))


@query(
    f"""select id, reason, if(kind <> 'wayback' and contains(content_type, 'text/html') and reason is not null, 'browser', 'native') as engine from (
    select id, kind, content_type, case when lang = 'fr' then 'server-side rendering is off' when lang = 'de' then 'empty application root' when lang = 'es' and length(v) < 240 then 'application markers with little text'
      when lang = 'en' and length(v) < 240 then 'scripts are asked for' end as reason
    from (select id, kind, content_type, regexp_extract(html, '{_LANG}', 1) as lang, {_VISIBLE} as v from (select * replace (replace(body, '<nav>', '<noscript>Please enable JavaScript</noscript><nav>') as body), body as raw_body from snapshots) t(id, site_id, run_id, source_url, final_url, kind, content_type, bytes, digest, created_at, html, raw_body)))""",
    ("snapshots",),
)
def htm13_engines(a: Archive):
    # every page asks for scripts; French ones are not rendered, German ones hold an empty root, Spanish ones a marker
    noted = F.replace(F.substring("body", 1, 1 << 30), F.lit("<nav>"), F.lit("<noscript>Please enable JavaScript</noscript><nav>"))
    lang = F.regexp_extract("body", _LANG, 1)
    body = (
        F.when(lang == "fr", F.replace(noted, F.lit('<html lang="fr"'), F.lit('<html data-ssr="false"'))).when(lang == "de", F.concat(noted, F.lit("<div id='root'>  </div>")))
        .when(lang == "es", F.replace(noted, F.lit("<nav>"), F.lit("<nav ng-version=9>"))).otherwise(noted)
    )
    rows = a.snapshots.select("id", "kind", "content_type", body.alias("page"))
    return rows.select("id", html.render_reason(F.col("page")).alias("reason"), html.engine(F.col("page"), F.col("content_type"), F.col("kind") == "wayback").alias("engine"))


@query("select page_id, replace(html, '<a href=\"/', '<a href=\"https://a.test/snapshots/s1/asset/') as page from pages")
def htm17_absolute_assets(a: Archive):
    return a.raw("pages").select("page_id", html.absolute_assets(_as_stored(), "https://a.test/").alias("page"))


#: English pages name the original first, others the lazy source.
_FIRST = "if(starts_with(html, '<!DOCTYPE html><html lang=\"en\"'), '/o', '')"


@query(f"""select page_id, replace(regexp_replace(html, '{_LINK}', '<img src="' || {_FIRST} || '\\1" ' || if({_FIRST} = '', 'data-src="\\1" data-original="/o\\1"', 'data-original="/o\\1" data-src="\\1"'), 'g'), '<b>', '<b><br>') as html from pages""")
def htm8_lazy_images(a: Archive):
    german = F.regexp_replace("html", _LINK, '<img src="data:image/gif;base64,R0" data-src="$1" data-original="/o$1"')
    english = F.regexp_replace("html", _LINK, '<img src="data:image/gif;base64,R0" data-original="/o$1" data-src="$1"')
    holder = F.when(_lang() == "en", english).otherwise(german)
    return a.raw("pages").select("page_id", html_kernels.lazy_sources(F.replace(holder, F.lit("<b>"), F.lit("<b><br>"))).alias("html"))


@query("select doc_id, " + ", ".join(f"regexp_matches(text, '{p}') as {n}" for n, p in secrets.CLASSES.items()) + " from documents")
def flt20_secret_classes(a: Archive):
    return secrets.classes(a.raw("documents"), "text").select("doc_id", *secrets.CLASSES)


_MAGIC = {"0": "89504E470D0A1A0A", "1": "FFD8FFE0", "2": "474946383761", "3": "474946383961", "4": "524946460000000057454250", "5": "5249464600000000", "6": "89504E47"}


@query(
    f"""select doc_id, case when starts_with(h, '89504E470D0A1A0A') then 'image/png' when starts_with(h, 'FFD8FF') then 'image/jpeg' when starts_with(h, '474946383761') or starts_with(h, '474946383961') then 'image/gif'
    when starts_with(h, '52494646') and substr(h, 17, 8) = '57454250' then 'image/webp' end as kind
    from (select doc_id, case left(sha256(text), 1) {" ".join(f"when '{k}' then '{v}'" for k, v in _MAGIC.items())} else '' end || hex(encode(text)) as h from documents)"""
)
def str7_image_types(a: Archive):
    first = F.substring(F.sha2("text", 256), 1, 1)
    head = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _MAGIC.items() for x in kv)), first), F.lit(""))
    return a.raw("documents").select("doc_id", text.image_type(F.concat(F.unhex(head), F.col("text").cast("binary"))).alias("kind"))


@query(f"""select page_id, array_to_string(list_transform(list_filter(list_transform(l, lambda x: trim(replace(x, ',', ' '))), lambda x: x <> ''), lambda x: 'https://a.test' || split_part(x, ' ', 1) || ' 2x'), ', ') as rewritten from {_FACTS}""")
def htm9_srcsets(a: Archive):
    @F.pandas_udf("string")
    def absolute(values):
        return values.map(lambda v: html_kernels.srcset(v, "https://a.test/x", lambda u: u))

    words = F.transform(html.hrefs(F.col("html")), lambda x: F.concat(F.split(F.trim(F.replace(x, F.lit(","), F.lit(" "))), " ")[0], F.lit("   2x")))
    return a.raw("pages").select("page_id", absolute(F.array_join(words, ", ,")).alias("rewritten"))
