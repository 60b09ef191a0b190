"""Main text of web pages, by structure and by differencing with the nearest page.

A page becomes an ordered list of text blocks, each with a mark: in an article
element, in one that is likely an article (by its class, id or role), in
boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments), or undecided. Pages are ordered by host and URL path; each is paired
with the neighbour whose path shares the longer beginning. The lines of both are
aligned by longest common subsequence and shared lines are deleted where the
structure leaves a doubt: in likely articles and in undecided text. Inside an
article element a line that a neighbour repeats is kept, because copies and
reprints of an article under other URLs, licence lines and quotations would
otherwise lose it. Where more text is only called an article than article
elements hold, these are teasers: both are kept, and only the former differenced. Two pages whose lines are the same throughout are copies:
they say nothing about each other's menus, and nothing is deleted.

Defined cases: null and empty html give an empty text; unclosed and stray tags
are tolerated; a null URL pairs with nothing; repeated rows are copies; the page
on either side of a partition border is also sent to the other side; very long
pages are taken whole; an empty table gives an empty result; columns other than
page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import bounded_batches, trim

# Tags of HTML.
_BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = set("script style noscript template textarea title svg math iframe object canvas audio video".split())
_BOILERPLATE = set("nav header footer aside form menu dialog head button select fieldset".split())
_CONTAINERS = set("div section ul ol p span table aside details dl blockquote figure li main article".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of a class, id or role that mark boilerplate, and parts that say nothing. A name marks boilerplate if it has one of the first
#: and nothing but the two: cookie-notice, top_ad and newsletter-signup do, ad-free and social-science do not.
_MARKS = re.compile(
    r"(?:ad|ads|adbox|adsbygoogle|advert\w*|alerts?|banner|breadcrumbs?|comments?|commentlist|contentinfo|cookies?|consent|dialog|disqus|footer|gdpr|header|masthead|menu|modal|\w*nav|navbar|"
    r"navigation|newsletter|notices?|overlay|pager|pagination|popup|promos?|promotion|promoted|recommend|recommended|recommendations|related|replies|respond|search|share|sharing|sidebar|signup|social|"
    r"sponsor|sponsored|sponsors|subscribe|toolbar|trending|widget)\d*"
)
_NEUTRAL = set(
    "area aside bar block body bottom box btn button buttons card col column container content form global group icons inner item items js left link links list main message messages middle "
    "module outer page panel posts primary right row secondary section side sign site slot sticky stories strip sub tools top under unit up user widgets wrap wrapper".split()
)
_PARTS = re.compile(r"[_-]+")
# Names that sites give to the element that holds an article.
_ARTICLE_NAMES = set("article article-body articlebody content entry entry-content post post-content post-body story main-content".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")

#: LIKELY: in an element that is called an article by its class, id or role only.
UNDECIDED, LIKELY, ARTICLE, BOILERPLATE = 0, 1, 2, 3


def _marks_boilerplate(name: str) -> bool:
    parts = [x for x in _PARTS.split(name) if x and not x.isdigit()]
    told = [x for x in parts if _MARKS.fullmatch(x)]
    return (bool(told) or "sign-up" in name) and all(x in _NEUTRAL or _MARKS.fullmatch(x) for x in parts)


def _mark(name: str, attributes: str) -> int:
    """What an element says about its content."""
    if name in _BOILERPLATE:
        return BOILERPLATE
    own = ARTICLE if name in ("article", "main") else UNDECIDED
    if not attributes:
        return own
    known = {}
    for m in _ATTRIBUTE.finditer(attributes):
        known.setdefault(m[1].lower(), next((unescape(v) for v in m.groups()[1:] if v is not None), ""))
    if "hidden" in known or known.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(known.get("style", "")):
        return BOILERPLATE
    if own == ARTICLE or name in ("body", "html"):
        return own
    names = " ".join(known.get(k, "") for k in ("class", "id", "role")).lower().split()
    if any(map(_marks_boilerplate, names)):
        return BOILERPLATE
    return LIKELY if any(x in _ARTICLE_NAMES for x in names) else UNDECIDED


def blocks(html: str) -> list[tuple[str, int]]:
    """Text blocks in page order with their marks; white space is one space, references are decoded."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    mark, at, size = UNDECIDED, 0, len(html)

    def end_block() -> None:
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, mark))

    low: str | None = None
    search = _TAG.search
    while at < size:
        m = search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCKS:
            end_block()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    end_block()
                    mark = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name in _RAW:
            low = html.lower() if low is None else low
            close = low.find(f"</{name}", at) if len(low) == size else re.compile(f"</{name}", re.I).search(html, at).start() if re.compile(f"</{name}", re.I).search(html, at) else -1
            end = html.find(">", close) if close >= 0 else -1
            at = end + 1 if end >= 0 else size
            continue
        if name in _VOID or m[3].endswith("/"):
            continue
        if name in _BOILERPLATE or name in _CONTAINERS:
            own = _mark(name, m[3])
            if name == "header" and mark in (LIKELY, ARTICLE):
                own = UNDECIDED  # an article's own heading
            before = mark
            after = BOILERPLATE if BOILERPLATE in (mark, own) else max(mark, own)
            if name == "p":  # left open by the next block; it has no say over what follows
                continue
            if after != before:
                end_block()
            stack.append((name, before))
            mark = after
    end_block()
    return out


#: Pairs of equal lines, as a multiple of the lines, from which on the alignment works on whole rows of bits.
MANY_PAIRS = 20


def longest_common(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, in memory that grows with the lines.

    Lines that only one page has, then the common beginning and end, are set aside. What is left is aligned pair by pair where few lines are
    equal (Hunt-Szymanski), else half by half (Hirschberg) with rows of bits.
    """
    theirs, ours = set(b), set(a)
    mine, other = [k for k, line in enumerate(a) if line in theirs], [line for line in b if line in ours]
    least = min(len(mine), len(other))
    head = next((k for k in range(least) if a[mine[k]] != other[k]), least)
    tail = next((k for k in range(least - head) if a[mine[-1 - k]] != other[-1 - k]), least - head)
    out = {*mine[:head], *mine[len(mine) - tail :]}
    mine, other = mine[head : len(mine) - tail], other[head : len(other) - tail]
    left, counts = [a[k] for k in mine], Counter(other)
    if sum(map(counts.__getitem__, left)) <= MANY_PAIRS * (len(mine) + len(other)):
        return out | {mine[k] for k in _by_pairs(left, other)}
    numbers = {line: k for k, line in enumerate({*left, *other})}
    return out | {mine[k] for k in _by_halves([numbers[x] for x in left], [numbers[x] for x in other])}


def _by_pairs(a: list[str], b: list[str]) -> set[int]:
    places: dict[str, list[int]] = {}
    for k, line in enumerate(b):
        places.setdefault(line, []).append(k)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of longest common subsequences of ``a`` with each beginning of ``b``: a bit per line of b, cleared where the length goes up."""
    width = len(b) // 8 + 1
    places: dict[int, bytearray] = {x: bytearray(width) for x in set(a)}
    for k, x in enumerate(b):
        if x in places:
            places[x][k >> 3] |= 1 << (k & 7)
    masks = {x: int.from_bytes(bits, "little") for x, bits in places.items()}
    whole = row = (1 << len(b)) - 1
    for x in a:
        both = row & masks[x]
        row = ((row + both) | (row - both)) & whole
    up = 1 - np.unpackbits(np.frombuffer(row.to_bytes(width, "little"), np.uint8), bitorder="little")[: len(b)].astype(np.int64)
    return np.append(0, np.cumsum(up))


def _by_halves(a: list[int], b: list[int]) -> set[int]:
    out, todo = set(), [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.add(a0)
            continue
        half = (a0 + a1) // 2
        cut = b0 + int((_lengths(a[a0:half], b[b0:b1]) + _lengths(a[half:a1][::-1], b[b0:b1][::-1])[::-1]).argmax())
        todo += [(a0, half, b0, cut), (half, a1, cut, b1)]
    return out


def _kept_marks(own: list[tuple[str, int]]) -> set[int]:
    """Marks of the blocks that are the main text: the surest there are. Where more text is only called an article than is in article
    elements, these are teasers, and both are kept."""
    best = max((mark for _, mark in own if mark != BOILERPLATE), default=UNDECIDED)
    size = Counter()
    for line, mark in own:
        size[mark] += len(line)
    return {ARTICLE, LIKELY} if best == ARTICLE and size[LIKELY] > size[ARTICLE] else {best}


def main_text(own: list[tuple[str, int]], other: list[tuple[str, int]] | None) -> str:
    """Lines of article elements; without any, those of likely or else of undecided ones that the neighbouring page does not share."""
    kept = _kept_marks(own)
    lines = [(line, mark) for line, mark in own if mark in kept]
    if kept != {ARTICLE} and other and lines:
        mine, theirs = [line for line, _ in lines], [line for line, mark in other if mark != BOILERPLATE]
        if mine != theirs:
            shared = longest_common(mine, theirs)
            lines = [x for k, x in enumerate(lines) if k not in shared or x[1] == ARTICLE]
    return "\n".join(line for line, _ in lines)


def _common_length(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


#: Keys for each range from which its borders are chosen, and the order of pages.
_KEYS, _ORDER = 50, ("host", "path", "page_key")


def _placed(keyed: DataFrame, bounds: list[tuple], also: dict[tuple, list[int]]) -> DataFrame:
    """With the range of each page; the pages in ``also`` once more for other ranges, where they are not ``own``."""
    from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

    names = keyed.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in _ORDER), strict=True))
            rows, parts = list(range(len(keys))), [bisect_right(bounds, k) for k in keys]
            for row, key in enumerate(keys):
                if key in also and key not in sent:
                    sent.add(key)
                    rows += [row] * len(also[key])
                    parts += also[key]
            own = [k < len(keys) for k in range(len(rows))]
            if len(rows) > len(keys):
                batch = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32()), pa.array(own, pa.bool_())], names=[*names, "part", "own"])

    return keyed.mapInArrow(place, StructType([*keyed.schema.fields, StructField("part", IntegerType()), StructField("own", BooleanType())]))


def _dealt(keyed: DataFrame, parts: int) -> DataFrame:
    """Pages in ranges of nearly equal numbers, each with the nearest page before and after it."""
    keys = keyed.select(*_ORDER)
    n = max(1, keys.count())
    # about that many keys in all, chosen where they lie; rows with the same key are one
    sample = sorted(tuple(r) for r in keys.filter(F.pmod(F.xxhash64(*_ORDER), F.lit(n)) < _KEYS * parts).distinct().collect())
    bounds = sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []
    ends = _placed(keys, bounds, {}).groupBy("part").agg(F.min(F.struct(*_ORDER)).alias("first"), F.max(F.struct(*_ORDER)).alias("last")).orderBy("part").collect()
    also: dict[tuple, list[int]] = {}
    for left, right in zip(ends, ends[1:], strict=False):
        if left["last"]["host"] and left["last"]["host"] == right["first"]["host"]:
            also.setdefault(tuple(left["last"]), []).append(right["part"])
            also.setdefault(tuple(right["first"]), []).append(left["part"])
    return _placed(keyed, bounds, also).repartitionById(parts, "part").sortWithinPartitions("part", *_ORDER)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text. Pages are dealt by ranges of (host, path), so that a large host is spread over many tasks."""
    bounded_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    page = F.col("page_id").cast("long")
    keyed = pages.select(page.alias("page_id"), "url", "html", *(F.coalesce(x, F.lit("")).alias(n) for n, x in (("host", host), ("path", path))), F.coalesce(page, F.lit(-(1 << 63))).alias("page_key"))
    dealt = _dealt(keyed, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = here = None

        def settle(page, left, right):
            _, _, host, path, own, _ = page
            near = [n for n in (left, right) if n is not None and host and n[2] == host and _kept_marks(own) != {ARTICLE}]
            # a copy is a neighbour only where there is no other page
            near = [n for n in near if n[4] != own] or near
            best = max(near, key=lambda n: _common_length(path, n[3]), default=None)
            return page[0], page[1], main_text(own, best and best[4])

        for batch in batches:
            out = []
            for page, url, html, host, path, mine in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "host", "path", "own")), strict=True):
                after = (page, url, host, path, blocks(html or ""), mine)
                if here is not None and here[5]:
                    out.append(settle(here, before, after))
                before, here = here, after
            yield _batch(out)
        if here is not None and here[5]:
            yield _batch([settle(here, before, None)])
        del before, here
        trim()

    return dealt.mapInArrow(difference, "page_id long, url string, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["page_id", "url", "text"])
