"""Main text of web pages by inferred wrappers: union-free regular expressions over token streams, one for each host.

A page is read as a stream of tags and text, nested by HTML's closing rules; inline markup does not count. Its stream is
folded into an expression: equal neighbours (and short tandem repeats) become repeated groups, text becomes slots. Expressions
of one host are aligned one after another: what both have is merged, what one lacks becomes optional, text that differs
becomes a data slot, text that all share stays constant. Every task first merges the pages it reads, so a host sends one expression a
task, however many pages it has. The wrapper's slots, with counts over all pages of the host, decide what is main text: a slot is
boilerplate if it is mostly links, or one text on at least half of the host's distinct pages, three at least (copies of a page
count once; distinct pages are counted by the SKETCH least digests, so exactly up to that many, and by their share from there on). Of a page's
elements that hold blocks of text, the one where the host's pages have most own text, on average, is the region of the main text;
what is around it joins if it adds headings only or much own text too. Tags of HTML count as part of the stream: an article's weighs more, a menu's
nothing. Words of class, id and role are a help only: they raise or lower an element's weight and drop asides inside of the region; they
decide alone where the wrapper shows no region. A page's text is what its slots hold.

Defined cases: null html is empty and gives no text; a null or broken url belongs to the host without a name; a page whose tags never
close is closed at its end; a tag without an end drops the rest of the page; what is nested deeper than DEPTH keeps its text beside that depth; repeated rows give repeated rows; other columns are ignored.
`<br>` is white space inside a block.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._util import chunks, materialize, shuffle_partitions, small_batches, table

_ROLE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+|\d+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea select object audio video canvas title noframes noembed head".split())
#: Content of these is only text for the browser, whatever it looks like.
_OPAQUE = frozenset("script style textarea title iframe noembed noframes".split())
_END_OF = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in _OPAQUE}
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

#: Tags and words of class, id and role that mark what is not main text.
ASIDE_TAGS = frozenset("nav header footer aside form menu button dialog fieldset".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments reply replies discussion disqus breadcrumb breadcrumbs pagination pager toolbar widget copyright".split()
)
#: An article with one of these is a reply, not the article of its page.
REPLY_WORDS = frozenset("comment comments reply replies".split())
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article articlebody main content post entry story".split())


def _label(tag: str, attributes: str) -> str:
    words: set[str] = set()
    if attributes and "=" in attributes:
        for found in _ROLE.findall(attributes):
            value = "".join(found)
            words.update(w for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if not w.isdigit())
    return ".".join([tag, *sorted(words)])


#: Nesting that the tree keeps; what is nested deeper stands beside it, with all of its text.
DEPTH = 100
#: Characters after which a quoted attribute value without its end counts as not quoted.
QUOTED = 1 << 16
_OPENER = re.compile(r"=\s*([\"'])")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag or null for comments and the like, whether it closes, attributes) of all markup, in time that grows with the page.

    A tag ends at the first `>` outside of quoted values; one without an end drops the rest of the page."""
    at, n = page.find("<"), len(page)
    while 0 <= at < n:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, None, False, ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = n if end < 0 else end + 1
            yield at, end, None, False, ""
        elif name := _NAME.match(page, at + 1):
            scan = name.end()
            end = page.find(">", scan)
            while end >= 0 and (opener := _OPENER.search(page, scan, end)):
                close = page.find(opener[1], opener.end(), opener.end() + QUOTED)
                if close < 0:
                    break
                scan = close + 1
                if close > end:
                    end = page.find(">", scan)
            if end < 0:
                yield at, n, None, False, ""
                return
            yield at, end + 1, name[2].lower(), name[1] == "/", page[name.end() : end]
            end += 1
        elif at + 1 < n and page[at + 1] == "/":
            end = page.find(">", at)
            end = n if end < 0 else end + 1
            yield at, end, None, False, ""
        else:
            end = at + 1
        at = page.find("<", end)


def parse(page: str) -> list:
    """The page as nested nodes [label, children]; text is ["#", text, characters inside links]."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    places: dict[str, list[int]] = {}  # of each open tag in the stack
    parts: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                stack[-1][1].append(["#", text, min(linked, len(text))])
            parts.clear()
        linked = 0

    def cut(k: int) -> None:
        """Close what is open from place k of the stack on."""
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def last(names: tuple[str, ...]) -> int:
        return max((places[name][-1] for name in names if places.get(name)), default=0)

    def close(names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        k = last(names)
        if k > last(barrier):
            flush()
            cut(k)

    skip = 0
    for start, stop, tag, closes, attributes in tokens(page):
        if start < skip:  # inside of what only looks like markup
            continue
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = stop
        if tag is None:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closes else 1
            continue
        if closes:
            if places.get(tag):
                flush()
                cut(places[tag][-1])
            elif tag in _P_ENDERS:
                flush()
            continue
        flush()
        if tag in _P_ENDERS:
            close(("p",), ("table", "td", "th", "button", "div", "article", "section", "li"))
        if tag in _ENDS:
            names, barrier = _ENDS[tag]
            close(tuple(names.split()), barrier)
        if tag in _OPAQUE:
            end = _END_OF[tag].search(page, at)
            at = skip = end.end() if end else n
            continue
        if tag == "body" and places.get("head"):  # whatever the head left open
            cut(places["head"][-1])
        if tag in VOID:
            continue
        in_link = 0
        inside = stack[-1][1]
        if len(stack) <= DEPTH:
            node = [_label(tag, attributes), []]
            inside.append(node)
            inside = node[1]
        if not attributes.endswith("/") or tag not in ("svg", "math"):
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, inside))
    if at < n:
        parts.append(page[at:])
    flush()
    return root


# --- expressions: items [label, repeated, optional, items or null, statistics or null] -----------------------------------------


#: Digests of distinct pages that a constant slot and a host keep.
SKETCH = 64


def digest(page: str) -> int:
    return int.from_bytes(hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=8).digest())


def _pages(a: list, b: list) -> list:
    """The least digests of both."""
    return a if a == b else sorted({*a, *b})[:SKETCH]


def fold(nodes: list, page: int | None = None) -> list:
    """A page's nodes as an expression; slots name the page by its digest, if there is one."""
    own = [] if page is None else [[page]]
    out = []
    for node in nodes:
        if node[0] == "#":
            out.append(["#", 0, 0, None, [1, len(node[1]), node[2], node[1], *own]])
        else:
            out.append([node[0], 0, 0, fold(node[1], page), 1])
    return _repeats(out)


def _repeats(items: list, longest: int = 3) -> list:
    """Equal neighbours, and tandem repeats of up to `longest` items, as repeated items and groups."""
    for period in range(1, longest + 1):
        out: list = []
        k = 0
        while k < len(items):
            unit = items[k : k + period]
            labels = [i[0] for i in unit]
            stop = k + period
            merged = unit
            while len(unit) == period and (period == 1 or "()" not in labels) and [i[0] for i in items[stop : stop + period]] == labels:
                merged = [_join(a, b, False) for a, b in zip(merged, items[stop : stop + period], strict=True)]
                stop += period
            if stop == k + period:
                out.append(items[k])
                k += 1
            elif period == 1:
                out.append([*merged[0][:1], 1, *merged[0][2:]])
                k = stop
            else:
                out.append(["()", 1, 0, merged, None])
                k = stop
        items = out
    return items


def _join(a: list, b: list, other_pages: bool = True) -> list:
    """Two items with one label; other_pages: whether they come from different pages, so that these add up."""
    if a[0] == "#":
        x, y = a[4], b[4]
        both = [x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] if x[3] == y[3] else None]
        if both[3] is not None and len(x) > 4:  # where texts differ, pages do not matter
            both.append(_pages(x[4], y[4]))
        return ["#", a[1] | b[1], a[2] | b[2], None, both]
    pages = None if a[0] == "()" else a[4] + b[4] if other_pages else max(a[4], b[4])
    return [a[0], a[1] | b[1], a[2] | b[2], align(a[3], b[3], other_pages), pages]


#: Cells of the table by which two lists of items are aligned best; longer lists are aligned in one pass.
CELLS = 40_000


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal labels in both, rising: a longest common subsequence, or for long lists one found in a single pass."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < n - lo and tail < m - lo and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    out = [(k, k) for k in range(lo)]
    n, m = n - tail, m - tail
    if (n - lo) * (m - lo) <= CELLS:
        best = [[0] * (m - lo + 1) for _ in range(n - lo + 1)]
        for i in range(n - lo - 1, -1, -1):
            for j in range(m - lo - 1, -1, -1):
                best[i][j] = 1 + best[i + 1][j + 1] if a[lo + i] == b[lo + j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n - lo and j < m - lo:
            if a[lo + i] == b[lo + j]:
                out.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        at: dict[str, list[int]] = {}
        for i in range(lo, n):
            at.setdefault(a[i], []).append(i)
        low = lo
        for j in range(lo, m):
            own = at.get(b[j], ())
            k = bisect.bisect_left(own, low)
            if k < len(own) and own[k] - low <= 64:  # a match far ahead would leave all between without a partner
                out.append((own[k], j))
                low = own[k] + 1
    return out + [(n + k, m + k) for k in range(tail)]


def align(a: list, b: list, other_pages: bool = True) -> list:
    """The expression that covers both: common items merged in order, the others optional."""
    first, second = [i[0] for i in a], [i[0] for i in b]
    if first == second:
        return [_join(x, y, other_pages) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in [*_matches(first, second), (len(a), len(b))]:
        out += [[*x[:2], 1, *x[3:]] for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(_join(a[p], b[q], other_pages))
        i, j = p + 1, q + 1
    return _repeats(out)


def slots(wrapper: list, path: tuple = ()) -> Iterator[tuple[tuple, list]]:
    for item in wrapper:
        if item[0] == "#":
            yield path, item[4]
        else:
            yield from slots(item[3], path if item[0] == "()" else (*path, item[0]))


def elements(wrapper: list, path: tuple = ()) -> Iterator[tuple[tuple, int]]:
    """Paths of elements with the number of pages that have them there (several items of one path: each)."""
    for item in wrapper:
        if item[0] == "()":
            yield from elements(item[3], path)
        elif item[0] != "#":
            own = (*path, item[0])
            yield own, item[4]
            yield from elements(item[3], own)


@lru_cache(100_000)
def _kind(label: str) -> tuple[bool, bool, bool, int]:
    """Of a label: whether its tag and whether its words are for menus and the like, whether it is main, and its rank as a region (0: none)."""
    tag, *words = label.split(".")
    main = tag in MAIN_TAGS or not MAIN_WORDS.isdisjoint(words)
    rank = 0 if not main or not REPLY_WORDS.isdisjoint(words) and tag == "article" else 3 if tag in MAIN_TAGS else 1 if tag in ("html", "body") else 2
    return tag in ASIDE_TAGS or tag in RAW, tag not in ("html", "body") and not ASIDE_WORDS.isdisjoint(words), main, rank


def roles(paths: set[tuple]) -> dict[tuple, int]:
    """For each path of a page: 2 in an article region, 0 in a menu or the like, 1 else.

    Regions are articles and mains, or else what a word says is one; of several those with the fewest aside words around them, then on them. Such words
    on these and around them speak of the page as a whole."""
    regions: dict[tuple, tuple] = {}
    for path in paths:
        around = 0
        for k, label in enumerate(path, 1):
            tag, words, _, rank = _kind(label)
            if tag:
                break
            if rank:
                regions[path[:k]] = (-rank, around, words)
            around += words
    best = min(regions.values(), default=None)
    free = {region[:k] for region, order in regions.items() if order == best for k in range(1, len(region) + 1)}
    out = {}
    for path in paths:
        kinds = [_kind(label) for label in path]
        aside = any(tag or words and path[:k] not in free for k, (tag, words, _, _) in enumerate(kinds, 1))
        out[path] = 0 if aside else 2 if any(main for _, _, main, _ in kinds) else 1
    return out


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: How much more the text of an article's tag counts, and how much less that of what words of class, id and role call an aside.
TAGGED, CALLED_ASIDE, CALLED_MAIN = 4.0, 0.25, 1.5
#: Other text under an element, as a share of the region's, from which on both belong together.
TOGETHER = 0.25


def verdicts(wrapper: list, pages: list | None = None) -> tuple[dict[tuple, int], dict[tuple, float]]:
    """What a host's wrapper says: of each slot's path whether its text is a page's own (1) or boilerplate (0), and of each element with
    text blocks right below it how much own text a page has there on average. pages: digests of the host's distinct pages.

    Boilerplate is what is mostly links, and what is the same on many pages; text in tags for menus and the like counts for nothing, and words
    of class, id and role only raise or lower what the slots show."""
    total: dict[tuple, list] = {}
    for path, (_, chars, linked, constant, *own) in slots(wrapper):
        x = total.setdefault(path, [0, 0, constant, []])
        x[0], x[1] = x[0] + chars, x[1] + linked
        x[2] = x[2] if x[2] == constant else None
        x[3] = _pages(x[3], own[0]) if own else x[3]
    of, seen = set(pages or ()), {}
    for path, n in elements(wrapper):
        seen[path] = max(seen.get(path, 1), n)
    seen[()] = max(seen.values(), default=1)
    own_text, density = {}, {}
    for path, (chars, linked, constant, own) in total.items():
        common = len(of.intersection(own))
        own_text[path] = 0 if 2 * linked > chars or constant is not None and common > 2 and 2 * common >= len(of) else 1
        kinds = [_kind(label) for label in path]
        if own_text[path] and not any(tag for tag, _, _, _ in kinds):
            prior = 1.0
            for _, words, _, rank in kinds:
                prior *= TAGGED if rank == 3 else CALLED_MAIN if rank == 2 else CALLED_ASIDE if words and not rank else 1.0
            density[path[:-1]] = density.get(path[:-1], 0.0) + prior * (chars - linked) / seen.get(path[:-1], 1)
    return own_text, density


def leaves(nodes: list, path: tuple = ()) -> Iterator[tuple[tuple, str]]:
    for node in nodes:
        if node[0] == "#":
            yield path, node[1]
        else:
            yield from leaves(node[1], (*path, node[0]))


def region_of(paths: set[tuple], judged: tuple[dict[tuple, int], dict[tuple, float]]) -> tuple | None:
    """The path of the element that holds a page's main text: of those with blocks of text, the one where the host's pages have most own text;
    then what is around it, as long as that adds headings only or another large share of own text."""
    own_text, density = judged
    whole = lambda path: not path or path[-1].split(".")[0] in ("html", "body")
    best = max((x for x in {path[:-1] for path in paths} if density.get(x)), key=lambda x: (density[x], -len(x), x), default=None)
    while best is not None and not whole(best) and _kind(best[-1])[3] != 3:
        around = best[:-1]
        if whole(around) and any(_kind(label)[3] == 3 for label in best):
            break
        inside = sum(v for x, v in density.items() if x[: len(best)] == best)
        beside = [path for path in paths if path[: len(around)] == around and path[: len(best)] != best and own_text.get(path, 0) and not any(_kind(label)[0] or _kind(label)[1] for label in path[len(around) :])]
        if not beside:
            if whole(around):
                break
        elif not all(path and path[-1].split(".")[0] in HEADINGS for path in beside) and sum(v for x, v in density.items() if x[: len(around)] == around and x[: len(best)] != best) < TOGETHER * inside:
            break
        best = around
    return best


def kept_paths(paths: frozenset[tuple], judged: tuple[dict[tuple, int], dict[tuple, float]]) -> frozenset[tuple]:
    """Those of a page's paths whose text is main text; pages with the same paths share them.

    These are the own texts below the region, without what tags or words there call an aside. Where slots show no region, tags and words decide."""
    region = region_of(set(paths), judged)
    if region is None:
        role = roles(set(paths))
        levels = {path: role[path] if role[path] != 1 else judged[0].get(path, 0) for path in paths}
        most = 2 if 2 in levels.values() else 1
        return frozenset(path for path, level in levels.items() if level >= most)
    depth = len(region)
    # what is the same on all pages may still stand in an article's own tag
    tagged = any(_kind(label)[3] == 3 for label in region)
    if any(_kind(label)[0] for label in region):
        return frozenset()
    return frozenset(path for path in paths if path[:depth] == region and (tagged or judged[0].get(path, 1)) and not any(tag or words for tag, words, _, _ in map(_kind, path[depth:])))


def extract(page: str, judged: tuple[dict[tuple, int], dict[tuple, float]], known: dict[frozenset, frozenset] | None = None) -> str:
    """The blocks of a page that it and its host's wrapper show to be main text. known: of the paths of pages met before what is kept."""
    found = list(leaves(parse(page)))
    paths = frozenset(path for path, _ in found)
    kept = known.get(paths) if known is not None else None
    if kept is None:
        kept = kept_paths(paths, judged)
        if known is not None and len(known) < 1000:
            known[paths] = kept
    return "\n".join(text for path, text in found if path in kept)


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"


def _host_rows(pages: DataFrame) -> DataFrame:
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


#: Places where the tasks' expressions of one host are merged, before these are.
SALTS = 32


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): an expression for each host and the least digests of its distinct pages, as JSON."""

    def merge(found: dict[str, list], host: str, expression: list, pages: list) -> None:
        known = found.get(host)
        found[host] = [align(known[0], expression), _pages(known[1], pages)] if known else [expression, pages]

    def rows(found: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(w, separators=(",", ":")) for w in found.values()], pa.string())], ["host", "wrapper"])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for chunk in chunks(batches, "html"):
            for host, page in zip(chunk["host"].to_pylist(), chunk["html"].to_pylist(), strict=True):
                own = digest(page)
                merge(found, host, fold(parse(page), own), [own])
            if len(found) > 20_000:
                yield rows(found)
                found = {}
        if found:
            yield rows(found)

    def per_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for host, wrapper in zip(batch["host"].to_pylist(), batch["wrapper"].to_pylist(), strict=True):
                if found and host not in found:
                    yield rows(found)
                    found = {}
                merge(found, host, *json.loads(wrapper))
        if found:
            yield rows(found)

    shape, n = "host string, wrapper string", shuffle_partitions(pages.sparkSession)
    dealt = _host_rows(pages).mapInArrow(per_task, shape)
    # tasks' expressions of a host meet in SALTS places first, so that no task merges those of all other tasks
    some = dealt.repartition(n, "host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).sortWithinPartitions("host", "wrapper").mapInArrow(per_host, shape)
    return some.repartition(n, "host").sortWithinPartitions("host", "wrapper").mapInArrow(per_host, shape)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = materialize(wrappers(pages), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: dict[str, tuple] = {}
        for chunk in chunks(batches, "html"):
            out = []
            for page, wrapper in zip(chunk["html"].to_pylist(), chunk["wrapper"].to_pylist(), strict=True):
                if wrapper not in judged:
                    if len(judged) > 1000:
                        judged.clear()
                    judged[wrapper] = verdicts(*json.loads(wrapper)) if wrapper else ({}, {}), {}
                out.append(extract(page, *judged[wrapper]))
            yield pa.RecordBatch.from_arrays([chunk["page_id"].combine_chunks(), chunk["url"].combine_chunks(), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = _host_rows(pages).join(known, "host", "left").select("page_id", "url", "html", "wrapper")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
