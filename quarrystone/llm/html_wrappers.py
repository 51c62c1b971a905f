"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over a host's pages: elements in order, each
maybe optional or repeated, with repeated groups of several elements and with text slots that
are constant or vary. It is inferred by aligning pages one after another. Where the
token streams of wrapper and page differ, a difference of texts makes a slot that varies; one of
tags is a repetition if what came before comes again, else an optional part that is skipped until both
streams meet. A host's distinct pages go to shares of bounded size by a digest of their content and are aligned
there in the digest's order; wrappers align with wrappers in the same way, by shares in their order, a
few at a time. So a wrapper depends on what the host's pages hold and on nothing else, and no host's pages meet in one task.

The wrapper gathers from all pages of the host how much text and how much link text each slot
holds. That, with the meaning of tags and of class names, decides which of its elements is the
article and which parts in it are boilerplate; every page's elements then follow their wrapper's.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checked_broadcast, written

#: Elements whose content is no text, elements without content, elements inside a line.
#: Those of RAW run to the page's end when unclosed; those of CLOSED are then read as if their tags weren't there.
RAW, CLOSED = "script|style|iframe|textarea|title", "noscript|template|svg|select|object|canvas|audio|video"
CLOSED_TAGS = set(CLOSED.split("|"))
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol menu dl table article section main div body".split())
#: Elements and words of classes, ids and roles that are not the article.
BOILER_TAGS = set("nav footer aside form menu dialog button fieldset".split())
BOILER_WORDS = set(
    """ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
    disqus feedback footer form login menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo
    promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored
    subscribe subscription tags toolbar toc widget complementary contentinfo""".split()
)
#: Words beside those of boilerplate that only tell of an element's place, form or number.
FORM_WORDS = set(
    """area article bar block body bottom box btn button buttons card container content div entry featured group head heading holder icon icons inline inner item items
    left link links list main module outer page panel photo post posts right row section site slot small stories story thread title top unit user users wrap wrapper""".split()
)
HEAD_WORDS = set("header masthead topbar".split())
MAIN_WORDS = set("article articlebody body-text content entry main maincontent post postbody story".split())
#: Elements nested deeper than the first join the one around them, unless their names tell what they are; those join it beyond the second.
MAX_DEPTH, NAMED_DEPTH = 120, 160
#: Distinct pages, and share of the host's, on which a text must be the same to count as template.
CONSTANT, MOSTLY = 3, 0.5
#: Pages of a host that are aligned together, about, and wrappers of shares.
PAGES_TOGETHER, SHARES_TOGETHER = 300, 16
#: Wrappers up to so many bytes together are broadcast; more are joined with salted pages.
BROADCAST_BYTES, SALTS = 32 << 20, 32

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z",
    re.S | re.I,
)
_CLOSED = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)({CLOSED})(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S | re.I)
_OPTIONS = re.compile(r"(?:\s*</?(?:option|optgroup)\b[^>]*>[^<]*)*", re.I)
_ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


# ---- pages as trees: an element is [signature, children], a text [None, text, link characters]


@lru_cache(maxsize=20_000)
def _signature(tag: str, attrs: str) -> str:
    """Tag, then class, id, role and itemprop words without digits."""
    words = [x for a in _ATTR.findall(attrs) for x in re.sub(r"\d+", "", " ".join(a[1:])).split()]
    return " ".join([tag, *sorted(set(words))])


def _ends(page: str) -> dict[int, int]:
    """Where each element of CLOSED that has an end tag starts and ends."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in _CLOSED.finditer(page):
        if not m[3]:
            continue
        starts = open_.setdefault(m[3].lower(), [])
        if m[2]:
            if starts:
                out[starts.pop()] = m.end()
        elif m[3].lower() == "svg" and m[4].endswith("/"):
            out[m.start()] = m.end()
        else:
            starts.append(m.start())
    return out


def parse(page: str) -> list:
    """The tree of a page's block elements; inline elements only join or part text."""
    root = ["body", []]
    stack, opened = [("body", root, 1)], Counter()  # every open tag, the node that takes what is in it, and how deep that lies
    buf, link, linked = [], 0, 0

    def flush():
        nonlocal linked
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                stack[-1][1][1].append([None, text, min(linked, len(text))])
        linked = 0

    def close(names, stop):
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                for tag, *_ in stack[i:]:
                    opened[tag] -= 1
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at = 0
    ends = None
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            part = page[at : m.start()]
            buf.append(part)
            if link:
                linked += len(part.strip())
        at = m.end()
        end, tag, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            if m[1]:
                buf.append(" ")
            continue
        tag = tag.lower()
        if tag in CLOSED_TAGS:
            buf.append(" ")
            if not end:
                ends = _ends(page) if ends is None else ends
                at = max(at, ends.get(m.start(), at))
                if tag == "select" and m.start() not in ends:
                    at = _OPTIONS.match(page, at).end()
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if end else 1
            elif tag == "br":
                buf.append(" ")
            continue
        flush()
        if tag in ("html", "head", "body"):
            continue
        if end:
            close({tag}, {"body"})
            link = 0
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPES | {"td", "th", "li"})
        if tag in CLOSES_OWN:
            close(CLOSES_OWN[tag], SCOPES - {"div"})
        if tag in VOID:
            continue
        node, (_, around, depth) = [_signature(tag, attrs or ""), []], stack[-1]
        if depth < MAX_DEPTH or (depth < NAMED_DEPTH and (_is_boiler(node[0], True) or _main_kind(node[0]))):
            around[1].append(node)
            stack.append((tag, node, depth + 1))
        else:
            stack.append((tag, around, depth))
        opened[tag] += 1
    if at < len(page):
        buf.append(page[at:])
    flush()
    return root


# ---- wrappers: an element is {s, o, r, k}, a group {s: "()", ...}, a slot {s: "#", o, r, c, n, e, t, a}; n and e count
# distinct pages, of the wrapper and of what is being aligned with it; a page of which there are k copies counts 1 / k


def _constant(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def _item(node: list, weight: float = 1.0) -> dict:
    if node[0] is None:
        return {"s": "#", "o": 0, "r": 0, "c": _constant(node[1]), "n": 0, "e": weight, "t": len(node[1]), "a": node[2]}
    return {"s": node[0], "o": 0, "r": 0, "k": [_item(x, weight) for x in node[1]]}


def _merged(x: dict, y: dict) -> dict:
    out = {"s": x["s"], "o": x["o"] | y["o"], "r": x["r"] | y["r"]}
    if x["s"] == "#":
        return out | {"c": x["c"] if x["c"] == y["c"] else None, "n": max(x["n"], y["n"]), "e": max(x["e"], y["e"]), "t": x["t"] + y["t"], "a": x["a"] + y["a"]}
    return out | {"k": align(x["k"], y["k"])}


def _inside(x: dict) -> set[str]:
    """Names of what an element holds, groups' members among them."""
    return {n for k in x["k"] for n in (_inside(k) if k["s"] == "()" else (k["s"],))}


def _alike(a: set[str], b: set[str]) -> bool:
    """Whether elements of one name may be the same part of a page: they hold something in common, or one is empty."""
    return not a or not b or not a.isdisjoint(b)


def _same(x: dict, y: dict) -> bool:
    if x["s"] != y["s"]:
        return False
    if x["s"] == "#":
        return True
    if x["s"] == "()":
        return len(x["k"]) == len(y["k"]) and all(map(_same, x["k"], y["k"]))
    return _alike(_inside(x), _inside(y))


def _repeats(out: list[dict], rest: list[dict], at: int) -> int:
    """Items of ``rest`` from ``at`` on that repeat the end of ``out``, which takes them in; 0 if none do."""
    if out and _same(out[-1], rest[at]):
        out[-1] = _merged(out[-1], rest[at]) | {"r": 1}
        return 1
    if out and out[-1]["s"] == "()":
        group = out[-1]["k"]
        part = rest[at : at + len(group)]
        if len(part) == len(group) and all(map(_same, group, part)):
            out[-1]["k"] = list(map(_merged, group, part))
            return len(part)
    for p in (2, 3, 4):
        part, last = rest[at : at + p], out[-p:]
        if len(part) == p == len(last) and all(map(_same, last, part)) and not any(i["o"] for i in last):
            out[-p:] = [{"s": "()", "o": 0, "r": 1, "k": list(map(_merged, last, part))}]
            return p
    return 0


def align(a: list[dict], b: list[dict], optional: bool = True) -> list[dict]:
    """The sequence that both match; only where they differ is anything repeated or optional.

    ``optional`` False: ``a`` is empty and ``b`` is folded into its repetitions.
    """
    out: list[dict] = []
    i = j = 0

    def put(x: dict) -> None:
        out.append(x | {"o": 1} if optional else x)

    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and _same(a[i], b[j]):
            out.append(_merged(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        if j < len(b) and (n := _repeats(out, b, j)):
            j += n
            continue
        if i < len(a) and (n := _repeats(out, a, i)):
            i += n
            continue
        if i < len(a) and j < len(b):  # the nearest place where the streams meet again
            in_a = next((d for d in range(1, len(a) - i) if _same(a[i + d], b[j])), None)
            in_b = next((d for d in range(1, len(b) - j) if _same(b[j + d], a[i])), None)
            if in_a is not None and (in_b is None or in_a <= in_b):
                put(a[i])
                i += 1
            elif in_b is not None:
                put(b[j])
                j += 1
            else:
                put(a[i])
                put(b[j])
                i, j = i + 1, j + 1
        elif i < len(a):
            put(a[i])
            i += 1
        else:
            put(b[j])
            j += 1
    return out


def _counted(x: dict, fresh: bool = False) -> dict:
    """All counts moved to ``n``, or to ``e`` for a wrapper that is to be aligned with another."""
    if x["s"] == "#":
        both = round(x["n"] + x["e"], 9)
        x["n"], x["e"] = (0, both) if fresh else (both, 0)
    else:
        for k in x["k"]:
            _counted(k, fresh)
    return x


def _together(wrapper: dict | None, one: dict) -> dict:
    """A wrapper with a page's or, counted afresh, another's; ``p`` is the number of distinct pages."""
    if wrapper is None:
        return _counted(one)
    return _counted(_merged(wrapper, one)) | {"p": wrapper["p"] + one["p"]}


def _page(page: str, weight: float) -> dict:
    return _item(parse(page), weight) | {"p": weight}


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages, aligned in the order given."""
    wrapper, copies = None, Counter(pages)
    for page in pages:
        wrapper = _together(wrapper, _page(page, 1 / copies[page]))
    return wrapper


# ---- what a wrapper's elements are


#: Parts of class names that say something about other elements than their own.
STATES = set("has no with without is not hide show open closed enabled disabled status active count".split())


def _words(signature: str) -> set[str]:
    """Words of classes and ids, without those of names that only tell of a state, like ``has-sidebar``."""
    out: set[str] = set()
    for name in signature.split(" ")[1:]:
        words = [w.lower() for w in _WORD.findall(name)]
        if not STATES & set(words):
            out.update(words)
    return out


def _is_boiler(signature: str, inside: bool) -> bool:
    tag, *names = signature.split(" ")
    if tag in ("article", "main"):  # these are boilerplate only by a whole name
        return bool(BOILER_WORDS & {n.lower() for n in names})
    if tag in BOILER_TAGS:
        return True
    if inside:  # in an article a name must say nothing else
        return any(_tells_boiler(n) for n in names)
    words = _words(signature)
    return tag == "header" or bool(words & (BOILER_WORDS | HEAD_WORDS))


@lru_cache(maxsize=20_000)
def _tells_boiler(name: str) -> bool:
    """Whether a name is made of words for boilerplate, beside such that only tell of place and form."""
    words = {w.lower() for w in _WORD.findall(name)}
    return bool(words & BOILER_WORDS) and words <= BOILER_WORDS | FORM_WORDS and not words & STATES


def _main_kind(signature: str) -> str | None:
    """What names an element as the article, the strongest first: ``article``, ``main`` or ``words``; None if nothing does."""
    tag, words = signature.split(" ", 1)[0], _words(signature) | set(signature.lower().split()[1:])
    if tag == "article" or "articlebody" in words:
        return "article"
    return "main" if tag == "main" or "main" in words else "words" if words & MAIN_WORDS else None


def _flat(items: list[dict]) -> list[dict]:
    return [x for i in items for x in (_flat(i["k"]) if i["s"] == "()" else [i])]


def _slots(x: dict, inside: bool = False) -> Iterator[tuple[dict, bool]]:
    """Text slots of a wrapper, each with whether it lies in an article element."""
    here = inside or x["s"].split(" ", 1)[0] in ("article", "main")
    for k in _flat(x["k"]):
        if k["s"] == "#":
            yield k, here
        else:
            yield from _slots(k, here)


def judge(wrapper: dict, several: bool = True) -> dict:
    """Marks parts of the wrapper: ``d`` dropped, ``m`` the article (there may be several).

    Text that never varies over CONSTANT distinct pages or more, and MOSTLY of the host's, belongs to the template, unless it lies in an
    article element or the template would then outweigh what varies. ``several`` False: one page alone tells
    nothing about that.
    """
    weights = {True: 0, False: 0}
    for x, _ in _slots(wrapper):
        weights[x["c"] is not None] += x["t"]
    templates = several and weights[True] < weights[False]
    least = max(CONSTANT, MOSTLY * wrapper.get("p", 1)) - 1e-6

    def weigh(x: dict, inside: bool) -> tuple[int, int]:
        """Characters that count for the article, and all of the element's characters in links."""
        if x["s"] == "#":
            x["d"] = int(templates and not inside and x["c"] is not None and x["n"] >= least)
            return (0 if x["d"] else x["t"] - x["a"]), x["a"]
        here = inside or x["s"].split(" ", 1)[0] in ("article", "main")
        x["d"] = int(_is_boiler(x["s"], inside))
        text = linked = 0
        for k in x["k"] if x["s"] == "()" else _flat(x["k"]):
            t, a = weigh(k, here)
            text, linked = text + t, linked + a
        listed = x["s"].split(" ", 1)[0] in ("ul", "ol", "dl", "table")
        names = [i["s"] for i in x["k"]]
        several_ = any(i["r"] for i in x["k"]) or len(set(names)) < len(names)
        if linked > (0.9 if here or not listed else 0.5) * (text + linked) and (listed or not here) and several_:
            x["d"] = 1
        x["w"] = 0 if x["d"] else text
        return x["w"], linked

    weigh(wrapper, False)
    wrapper["d"] = 0
    found: dict[str, list[dict]] = {"article": [], "main": [], "words": []}

    def search(x: dict, within: frozenset = frozenset()) -> None:
        if x["s"] == "#" or x["d"] or not x["w"]:
            return
        kind = None if x is wrapper else _main_kind(x["s"])
        if kind and kind not in within:
            found[kind].append(x)
        if kind != "article":
            for k in _flat(x["k"]):
                search(k, within | {kind})

    search(wrapper)
    total = max(1, wrapper["w"])
    for kind, share in (("article", 0.0), ("main", 0.2), ("words", 0.5)):
        weight = sum(x["w"] for x in found[kind])
        if found[kind] and weight > share * total:
            chosen = found[kind]  # none lies in another
            break
    else:
        node = wrapper
        while True:  # down while one element holds nearly all
            inner = [k for k in _flat(node["k"]) if k["s"] != "#" and not k["d"]]
            best = max(inner, key=lambda k: k["w"], default=None)
            if best is None or best["r"] or best["w"] < 0.9 * node["w"]:
                break
            node = best
        chosen = [node]
    for x in chosen:
        x["m"] = 1
    return wrapper


def blocks(tree: list, wrapper: dict | None) -> list[str]:
    """The article's blocks in page order, each of the page's elements led by the wrapper's."""
    out: list[str] = []

    def led(child: list, items: list[dict], at: int) -> int | None:
        """The item that a child follows: the next of its name that holds the like, else any of its name, the next first."""
        name = child[0] or "#"
        found = [i for i in (*range(at, len(items)), *range(at)) if items[i]["s"] == name]
        held = None if child[0] is None else {c[0] or "#" for c in child[1]}
        return next((i for i in found if held is None or _alike(held, _inside(items[i]))), found[0] if found else None)

    def walk(node: list, lead: dict | None, taking: bool, inside: bool) -> None:
        here = inside or node[0].split(" ", 1)[0] in ("article", "main")
        items, at = _flat(lead["k"]) if lead else [], 0
        for child in node[1]:
            hit = led(child, items, at)
            item = None if hit is None else items[hit]
            if item:
                at = hit if item["r"] else hit + 1
            if child[0] is None:
                if taking and not (item and item["d"] and _constant(child[1]) == item["c"]):
                    out.append(child[1])
                continue
            if item["d"] if item else _is_boiler(child[0], here):
                continue
            walk(child, item, taking or bool(item and item.get("m")), here)

    walk(tree, wrapper, bool(wrapper and wrapper.get("m")), False)
    return out


def extract(page: str, wrapper: dict | None) -> str:
    """The main text of a page; its own wrapper serves where the host's finds no article in it."""
    tree = parse(page)
    found = blocks(tree, wrapper) if wrapper else []
    if not found:
        found = blocks(tree, judge(_item(tree), several=False))
    return "\n".join(found)


# ---- over a table of pages


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as what is aligned of them: no text, only its length and digest."""
    for b in batches:
        items = [json.dumps(_page(page or "", 1.0), separators=(",", ":")) for page in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(items, pa.string())], ["host", "share", "place", "wrapper"])


def _aligned(pages: bool, last: bool):
    """Rows sorted by host, share and place, each share's aligned one after another as they come."""

    def leave(host, share, wrapper) -> pa.RecordBatch:
        text = json.dumps(judge(wrapper) if last else wrapper, separators=(",", ":"))
        return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([share], pa.int64()), pa.array([text], pa.string())], ["host", "share", "wrapper"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = before = wrapper = None
        for b in batches:
            for host, share, place, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (host, share):
                    if wrapper is not None:
                        yield leave(*key, wrapper)
                    key, before, wrapper = (host, share), None, None
                if pages and place == before:
                    continue  # a copy of the page before it
                one = json.loads(text)
                wrapper, before = _together(wrapper, one if pages else _counted(one, True)), place
        if wrapper is not None:
            yield leave(*key, wrapper)

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) from rows of host and html."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(pages.groupBy("host").agg(F.ceil(F.count("*") / PAGES_TOGETHER).alias("shares")), "hosts")
    most = counts.agg(F.coalesce(F.max("shares"), F.lit(1))).first()[0]
    place = F.unhex(F.md5(F.coalesce("html", F.lit(""))))
    dealt = pages.join(checked_broadcast(counts), "host").select("host", F.pmod(F.xxhash64(place), F.col("shares")).alias("share"), place.alias("place"), "html")
    row = "host string, share long, wrapper string"
    level = dealt.mapInArrow(_items, "host string, share long, place binary, wrapper string")
    first, several = True, int(most)
    while first or several > 1:  # shares of shares, until each host has one
        if not first:
            several = -(-several // SHARES_TOGETHER)
            made = written(found, "shares")
            level = made.select("host", F.expr(f"share div {SHARES_TOGETHER}").alias("share"), F.col("share").alias("place"), "wrapper")
        found = level.repartition(parts, "host", "share").sortWithinPartitions("host", "share", "place").mapInArrow(_aligned(first, several == 1), row)
        first = False
    return found.select("host", "wrapper")


@lru_cache(maxsize=200)
def _loaded(text: str) -> dict:
    return json.loads(text)


def _extract(known):
    """``known``: the wrappers by host, broadcast to workers, or None where they come with the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = known.value if known else None
        for b in batches:
            found = [by_host.get(h) for h in b.column(3).to_pylist()] if known else b.column(3).to_pylist()
            texts = [extract(page or "", _loaded(w) if w else None) for page, w in zip(b.column(2).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def host_of(url):
    """Lower-case host of an address; the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, one row for each row of ``pages`` (page_id, url, html).

    Null and empty html give the empty text. Pages without a host, or with a null url, share the
    empty host's wrapper. Null ids and repeated rows: a row each. Empty table: no rows.
    Pages are read whole, however long and deep; broken markup is read as far as it goes. Other columns
    are neither read nor returned. The result doesn't depend on the order or the partitions of ``pages``.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    found = written(wrappers(rows.select("host", "html")), "wrappers")
    size = found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    kind = "page_id long, url string, text string"
    if size <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast(dict(found.toLocalIterator()))
        return rows.select("page_id", "url", "html", "host").mapInArrow(_extract(known), kind)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    joined = salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(_extract(None), kind)
