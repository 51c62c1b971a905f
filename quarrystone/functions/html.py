"""Page functions as built-in expressions: titles, visible text, links, resources, engine choice, replay quality.

They work on decoded markup. Entities are decoded by ``html_kernels.unescape``; the native
forms leave them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_html

#: Markers of client-side applications, and of pages that ask for scripts.
APP_MARKERS = ("__nuxt", "__next", "data-reactroot", "ng-version", "data-v-app", 'type="module"', "type='module'")
NOSCRIPT_MARKERS = ("enable javascript", "javascript is required", "you need to enable javascript", "please enable javascript")
#: Link relations that load something, visible characters that a rendered page has, and the text window.
ASSET_RELATIONS = ("stylesheet", "icon", "apple-touch-icon", "manifest", "preload", "modulepreload")
VISIBLE_LEAST, WINDOW = 240, 2 << 20
_SPACE = r"[\s ]+"


def collapse(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, _SPACE, " "))


def title(page: Column) -> Column:
    """The first title, white space collapsed, at most 160 characters; null if empty or missing."""
    text = F.substring(collapse(F.regexp_extract(page, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), 1, 160)
    return F.when(text != "", text)


def _without(page: Column, *tags: str) -> Column:
    for t in tags:
        page = F.regexp_replace(page, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ")
    return page


def visible_text(page: Column, templates: bool = False) -> Column:
    """Text without scripts, styles, (if asked) templates, and tags; white space collapsed."""
    body = _without(page, "script", "style", *(("template",) if templates else ()))
    return collapse(F.regexp_replace(body, "<[^>]+>", " "))


def search_text(page: Column, content_type: Column) -> Column:
    """Searchable text of the window's start; empty for anything but text, JSON and XML."""
    return F.when(F.lower(content_type).rlike("text|json|xml"), visible_text(F.substring(page, 1, WINDOW))).otherwise(F.lit(""))


def hrefs(page: Column) -> Column:
    """Quoted link targets of anchors and areas in document order."""
    return F.regexp_extract_all(page, F.lit(r"""(?is)<(?:a|area)\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)')"""), F.lit(1))


def base_href(page: Column) -> Column:
    found = F.regexp_extract(page, r"""(?is)<base\b[^>]*\bhref\s*=\s*["']([^"']*)["']""", 1)
    return F.when(found != "", found)


def first_frame(page: Column) -> Column:
    found = F.btrim(F.regexp_extract(page, r"""(?is)<frame\b[^>]*\bsrc\s*=\s*["']([^"']*)["']""", 1))
    return F.when(found != "", found)


def count_of(page: Column, pattern: str) -> Column:
    return F.regexp_count(page, F.lit(pattern)).cast("long")


def tag_count(page: Column, *tags: str) -> Column:
    return count_of(page, rf"(?i)<(?:{'|'.join(tags)})\b")


def render_reason(page: Column) -> Column:
    """Why a page needs a browser, the first rule that holds; null if none does."""
    lower, visible = F.lower(page), F.length(visible_text(page, templates=True))
    marked = F.lit(False)
    for m in APP_MARKERS:
        marked = marked | lower.contains(m)
    notes = F.array_join(F.regexp_extract_all(lower, F.lit(r"(?s)<noscript\b[^>]*>(.*?)</noscript>"), F.lit(1)), " ")
    asked = F.lit(False)
    for m in NOSCRIPT_MARKERS:
        asked = asked | notes.contains(m)
    root = r"""(?is)<(?:div|main)\b[^>]*\bid\s*=\s*['"](?:__nuxt|__next|root|app|application)['"][^>]*>\s*</(?:div|main)>"""
    return (
        F.when(lower.rlike("data-ssr=(?:\"false\"|'false')"), "server-side rendering is off")
        .when(page.rlike(root), "empty application root")
        .when(marked & (visible < VISIBLE_LEAST), "application markers with little text")
        .when(asked & (visible < VISIBLE_LEAST), "scripts are asked for")
    )


def engine(page: Column, content_type: Column, archived: Column, browser: bool = True, evidence: bool = False) -> Column:
    """``browser`` or ``native``."""
    html = F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html")
    if not browser:
        return F.lit("native")
    wanted = F.lit(True) if evidence else render_reason(page).isNotNull()
    return F.when(~archived & html & wanted, "browser").otherwise("native")


def resources(page: Column) -> Column:
    """Resource references in order of priority: links, sources, source sets, inline styles; (stage, url) structs."""
    rel = "|".join(ASSET_RELATIONS)
    link = rf"""(?is)<link\b(?=[^>]*\brel\s*=\s*["'][^"']*\b(?:{rel})\b)[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
    src = r"""(?is)(?<![\w-])(?:src|poster)\s*=\s*["']([^"']*)["']"""
    sets = r"""(?is)(?<![\w-])srcset\s*=\s*["']([^"']*)["']"""
    css = r"""(?i)url\(\s*["']?([^)"']+?)["']?\s*\)"""
    found = lambda p: F.regexp_extract_all(page, F.lit(p), F.lit(1))
    staged = lambda a, s: F.transform(a, lambda u: F.struct(F.lit(s).alias("stage"), F.btrim(u).alias("url")))
    each = F.flatten(F.transform(found(sets), lambda s: F.transform(F.split(s, ","), lambda x: F.split(F.btrim(x), r"\s+")[0])))
    every = F.concat(staged(found(link), "html_link"), staged(found(src), "html_asset"), staged(each, "html_srcset"), staged(found(css), "inline_css"))
    return F.filter(every, lambda r: (r["url"] != "") & ~r["url"].rlike("^(?:data:|#|mailto:|tel:)"))


def css_references(style: Column) -> Column:
    """What a stylesheet loads: quoted imports first, then ``url()``, each in order; no data and nothing that is stored already."""
    imports = F.regexp_extract_all(style, F.lit(r"""(?is)@import\s+(["'])(.*?)\1[^;]*;"""), F.lit(2))
    urls = F.transform(F.regexp_extract_all(style, F.lit(r"(?i)url\(\s*([^)]+?)\s*\)"), F.lit(1)), lambda u: F.btrim(F.btrim(u), F.lit("\"'")))
    return F.concat(imports, F.filter(urls, lambda u: (u != "") & ~u.rlike("^(?:data:|#|mailto:|tel:|/snapshots/)")))


def css_url_count(style: Column) -> Column:
    return F.regexp_count(style, F.lit(r"(?i)url\("))


def local_references(page: Column) -> Column:
    """Ids of stored assets that a page refers to."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r"(?i)/snapshots/[A-Za-z0-9_-]+/asset/([A-Za-z0-9._~-]+)"), F.lit(1)))


def images_without_source(page: Column) -> Column:
    tags = F.regexp_extract_all(page, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    return F.size(F.filter(tags, lambda t: ~t.rlike(r"""(?is)(?<![\w-])(?:src|srcset)\s*=\s*(["']).+?\1"""))).cast("long")


def quality_status(problems: Column, warnings: Column) -> Column:
    return F.when(problems > 0, "problems").when(warnings > 0, "warnings").otherwise("complete")


def quality_label(status: Column) -> Column:
    return F.when(status.isin("complete", "warnings", "problems"), F.initcap(status)).otherwise("Unknown")


def quality_facts(assets: Column, remote: Column, missing: Column, bare: Column) -> Column:
    """One line of what a quality report counts."""
    counts = ((assets, "local assets"), (remote, "remote dependencies"), (missing, "missing local resources"), (bare, "images without a source"))
    return F.array_join(F.array(*(F.concat(n.cast("string"), F.lit(f" {what}")) for n, what in counts)), " · ")


def has_relation(rel: Column, relations: tuple[str, ...] = ASSET_RELATIONS) -> Column:
    """Whether any of a link's relations is among ``relations``, whatever their case."""
    return F.arrays_overlap(F.split(F.lower(F.btrim(rel)), r"\s+"), F.array(*map(F.lit, relations)))


def absolute_assets(page: Column, origin: str) -> Column:
    """Root-relative addresses of stored assets made absolute, whatever letters the asset's name begins with."""
    return F.regexp_replace(page, r"""(?m)(^|["'(=\s])(/snapshots/[A-Za-z0-9_-]+/asset/)""", "$1" + origin.rstrip("/") + "$2")


#: What an anchor, its reference, and an attribute are.
ANCHOR = r"(?is)<a\b[^>]*>"
_HREF = r"""(?is)^(.*?(?<![\w-])href\s*=\s*)(["'])(.*?)\2(.*)$"""
DISABLED_SCRIPT = "application/x-disabled"


def _attribute(name: str) -> str:
    return rf"(?<![\w-]){name}\s*="


def anchors(page: Column) -> Column:
    """The start tags of anchors in order."""
    return F.regexp_extract_all(page, F.lit(ANCHOR), F.lit(0))


def anchor_href(tag: Column) -> Column:
    """The quoted reference of a start tag as it is written; empty if there is none."""
    return F.regexp_extract(tag, _HREF, 3)


def _with_href(tag: Column, value: Column) -> Column:
    at = lambda i: F.regexp_extract(tag, _HREF, i)
    return F.concat(at(1), at(2), value, at(2), at(4))


def _with_attribute(tag: Column, name: str, value: str) -> Column:
    """The first quoted attribute of that name gets the value; a tag without one gets it at its end."""
    changed = F.regexp_replace(tag, rf"""(?is)^(.*?)(?<![\w-]){name}\s*=\s*(["']).*?\2(.*)$""", f'$1{name}="{value}"$3')
    return F.when(tag.rlike("(?i)" + _attribute(name)), changed).otherwise(F.concat(F.substring(tag, F.lit(1), F.length(tag) - 1), F.lit(f' {name}="{value}">')))


def led_anchor(tag: Column, raw: Column, target: Column, copy: Column) -> Column:
    """An anchor that leads to ``copy`` if there is one, else out of the archive to ``target``; scripts and data (no target) lead nowhere, and without ``raw`` nothing changes."""
    outside = _with_attribute(_with_attribute(_with_href(tag, escape_html(target)), "target", "_blank"), "rel", "noopener noreferrer external")
    return F.when(raw.isNull(), tag).when(target.isNull(), _with_href(tag, F.lit("#"))).when(copy.isNotNull(), _with_href(tag, escape_html(copy))).when(target.rlike("^https?://"), outside).otherwise(tag)


def with_anchors(page: Column, tags: Column) -> Column:
    """A page with its anchors' start tags replaced, one for one; null ``tags`` change nothing."""
    around = F.split(page, ANCHOR, -1)
    whole = F.array_join(F.zip_with(around, F.concat(tags, F.array(F.lit(""))), lambda text, tag: F.concat(text, tag)), "")
    return F.when(tags.isNull(), page).otherwise(whole)


def disabled_forms(page: Column) -> Column:
    """Forms that send nothing: their action leads nowhere, and they are inert."""
    out = F.regexp_replace(page, r"""(?is)(<form\b[^>]*?)(?<![\w-])action\s*=\s*(["'])[^>]*?\2""", '$1action="about:blank"')
    out = F.regexp_replace(out, rf"(?is)(<form\b(?![^>]*{_attribute('action')})[^>]*)>", '$1 action="about:blank">')
    return F.regexp_replace(out, r"(?is)(<form\b(?![^>]*(?<![\w-])inert(?:\s|=|>))[^>]*)>", "$1 inert>")


def disabled_scripts(page: Column) -> Column:
    """Scripts of a type that no browser runs."""
    out = F.regexp_replace(page, rf"""(?is)(<script\b(?![^>]*{DISABLED_SCRIPT})[^>]*?)(?<![\w-])type\s*=\s*(["'])[^>]*?\2""", f'$1type="{DISABLED_SCRIPT}"')
    return F.regexp_replace(out, rf"(?is)(<script\b(?![^>]*{_attribute('type')})[^>]*)>", f'$1 type="{DISABLED_SCRIPT}">')


#: What a replayed page may load: its own copies, nothing by scripts, nothing sent.
REPLAY_RULES = {
    "default-src": "'self' data: blob:", "img-src": "'self' data: blob:", "style-src": "'self' 'unsafe-inline' data: blob:", "script-src": "'none'", "font-src": "'self' data: blob:",
    "media-src": "'self' data: blob:", "connect-src": "'none'", "form-action": "'none'", "frame-src": "'self'",
}
#: Frames of a tracker, and a page's own content rules.
_TRACKER = r"""(?is)<iframe\b[^>]*\bsrc\s*=\s*(["'])[^"']*googletagmanager\.com[^"']*\1[^>]*>.*?</iframe>"""
_OWN_RULES = r"""(?i)<meta[^>]+http-equiv=["']?content-security-policy["']?[^>]*>"""


def without_trackers(page: Column) -> Column:
    return F.regexp_replace(page, _TRACKER, "")


def _in_head(page: Column, inserted: Column) -> Column:
    """Behind the first start tag of a head, else in front."""
    at = F.length(F.regexp_extract(page, r"(?is)^(.*?<head\b[^>]*>)", 1))
    return F.concat(F.substring(page, F.lit(1), at), inserted, F.substring(page, at + 1, F.length(page)))


def replay_rules(page: Column, base: Column, repairs: str = "") -> Column:
    """A page under the content rules of a replay instead of its own, with ``base`` in the first base element or in a new one.

    ``repairs`` is markup that goes with the rules, such as styles that show what scripts would have shown.
    """
    rules = F.lit('<meta http-equiv="Content-Security-Policy" content="' + "; ".join(f"{k} {v}" for k, v in REPLAY_RULES.items()) + ';">')
    tag = F.concat(F.lit('<base href="'), escape_html(base), F.lit('">'))
    out = F.regexp_replace(page, _OWN_RULES, "")
    at = F.regexp_extract(out, r"(?is)^(.*?)<base\b[^>]*>", 0)
    before = F.regexp_extract(out, r"(?is)^(.*?)<base\b[^>]*>", 1)
    based = F.concat(before, tag, F.substring(out, F.length(at) + 1, F.length(out)))
    told = F.when(F.lower(out).contains("content-security-policy"), F.lit(repairs)).otherwise(F.concat(rules, F.lit(repairs)))
    fresh = _in_head(out, F.concat(tag, rules, F.lit(repairs)))
    return F.when(~F.lower(out).contains("<base"), fresh).otherwise(_in_head(F.when(at == "", out).otherwise(based), told))


def replay_document(page: Column, base: Column) -> Column:
    """A page without tracker frames, with its base and the rules of a replay; its links stay as they are (``operators.replay`` leads them)."""
    return replay_rules(without_trackers(page), base)
