"""Main text of HTML pages by differencing pages of near URLs.

Different pages of a host are put in the order of their URL paths, where the longest common path prefixes are neighbours,
and numbered through across the cluster; a page meets the two before and the two after it in its host. Copies (pages of
the very same lines) count once, at their first path, so a page never meets its own copy. The text lines of a page
outside its main element are aligned with each neighbour's by a longest common subsequence, and shared lines are deleted:
beside a main element those that any neighbour shares, without one those that over half of them share, as a template's
lines recur on most neighbours, a copied article's on its copies only.

Two things are known beforehand. Lines inside an ``article`` or ``main`` element are never deleted, because copied
articles share lines too. Lines of known regions (navigation, header, footer, form, advert, notice, comments) that differ
from page to page, so that no alignment can tell, are deleted by their region. The alignment decides about all other
lines, also beside an ``article`` or ``main`` element; ``n_shared`` says how many lines outside of it are shared.

Edge cases: a null or empty page has the empty text. A null URL has an empty host and path. A page alone in its host has
no neighbour, and all its lines outside known regions stay; with a single neighbour, what both share is deleted. Unclosed
elements end with the page or with an enclosing element. Repeated rows are alike. Very long pages are read whole. The
result does not depend on how rows are partitioned. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, release
from .url_filter import host_of, path_of

#: Neighbours on each side of a page.
SIDE = 2
#: Numbered pages that are put side by side in one task; the few at either end are given to the next one too.
STRETCH = 4096
# Elements by their part in a page.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title", "head")
REGIONS = frozenset("nav footer aside form menu dialog button select".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAIN = frozenset(("article", "main"))
_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|header|footer|masthead|comments?|replies|disqus|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|share|social|related|recommend\w*|widget|toolbar|pagination|pager)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog form menu menubar alert".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^<>]*>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][\w:-]*)")


@dataclass
class Lines:
    """Text lines of a page with their region: 0 free, 1 main, 2 boilerplate."""

    text: list[str] = field(default_factory=list)
    region: list[int] = field(default_factory=list)


def _is_region(tag: str, name: str, in_main: bool) -> bool:
    if name in REGIONS or (name == "header" and not in_main):
        return True
    if name in ("html", "body", "article", "main"):
        return False
    if " " not in tag:
        return False
    for key, a, b, c in _ATTRIBUTE.findall(tag):
        value = a or b or c
        key = key.lower()
        if key == "role":
            if value.lower() in _ROLES:
                return True
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        elif key in ("class", "id") and _NAMES.search(value):
            return True
    return False


def lines_of(page: str | None) -> Lines:
    """Blocks of text in page order; white space inside a block is one space."""
    out = Lines()
    page = page or ""
    words: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements: name, region before them
    region, at, line_region = 0, 0, 0

    def end_block() -> None:
        nonlocal words
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                out.text.append(text)
                out.region.append(line_region)
            words = []

    def say(text: str) -> None:
        nonlocal line_region
        if text:
            if not words or region != line_region:
                end_block()
                line_region = region
            words.append(text)

    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = m.group()
        found = _NAME.match(tag)
        if not found:
            continue
        name = found[1].lower()
        closing = tag[1] == "/"
        if name in RAW and not closing:
            if not tag.endswith("/>") or name not in ("svg", "object"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if name == "head":
                    end = end or re.compile(r"(?=<body\b)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            say(" ")
            continue
        if name in BLOCKS:
            end_block()
        if name in VOID or tag.endswith("/>"):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    region = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name in BLOCKS or name in REGIONS:
            if name == "p" and stack and stack[-1][0] == "p":
                region = stack.pop()[1]
            stack.append((name, region))
            if region != 2:
                region = 2 if _is_region(tag, name, region == 1) else 1 if name in MAIN or re.search(r"\brole\s*=\s*[\"']?main\b", tag, re.I) else region
    say(page[at:])
    end_block()
    return out


def shared(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``: the longest increasing chain of equal positions."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    ends = set(range(first)) | set(range(len(a) - last, len(a)))
    places = defaultdict(list)
    for j in range(len(b) - last - 1, first - 1, -1):
        places[b[j]].append(j)  # descending, so a line is matched once
    tails: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in range(first, len(a) - last):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k], links[k] = j, node
    node = links[-1] if links else None
    while node:
        ends.add(node[0])
        node = node[1]
    return ends


def decide(lines: list, regions: list[int], neighbours: list[list], main: bool = False) -> tuple[list[bool], int]:
    """Which lines outside the main element (region 0 or 2) are main text all the same, and how many are shared.

    Beside a main element one neighbour is enough; without one most of them must share a line, as an article may be copied.
    """
    votes = [0] * len(lines)
    if lines:
        for other in neighbours:
            for i in shared(lines, other):
                votes[i] += 1
    most = [v > 0 if main else 2 * v > len(neighbours) for v in votes]
    return [r == 0 and not m for r, m in zip(regions, most, strict=True)], sum(most)


def written(lines: list[bytes], regions: bytes, keep: bytes) -> bytes:
    """Lines of the main element, and those outside of it that were kept, in page order."""
    outside = iter(keep)
    return b"\n".join([x for x, r in zip(lines, regions, strict=False) if r == 1 or next(outside)])


def _copy(found: Lines, raw: list[bytes]) -> int:
    """A digest of all lines and their regions."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(b"\n".join([bytes(found.region), *raw])) >> 1


def _raw(found: Lines) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in found.text]


def outlined(rows: DataFrame) -> DataFrame:
    """(host, path, copy, regions, main, digests) of pages (host, path, html): digests of the lines outside the main element."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        from xxhash import xxh3_64_intdigest

        found = [lines_of(p) for p in cols["html"]]
        raw = [_raw(f) for f in found]
        digests = [[xxh3_64_intdigest(x) >> 1 for x, g in zip(r, f.region, strict=True) if g != 1] for f, r in zip(found, raw, strict=True)]
        outside = [bytes(g for g in f.region if g != 1) for f in found]
        return {"host": cols["host"], "path": cols["path"], "copy": [_copy(f, r) for f, r in zip(found, raw, strict=True)], "regions": outside, "main": [1 in f.region for f in found], "digests": digests}

    return map_rows(rows, ["host", "path", "html"], run, "host string, path string, copy long, regions binary, main boolean, digests array<long>")


def packed(rows: DataFrame) -> DataFrame:
    """(page_id, url, host, copy, regions, packed) of pages: their lines, packed for the shuffle; none holds a line break."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        from zstandard import ZstdCompressor

        pack, found = ZstdCompressor(level=6).compress, [lines_of(p) for p in cols["html"]]
        raw = [_raw(f) for f in found]
        return {c: cols[c] for c in ("page_id", "url", "host")} | {"copy": [_copy(f, r) for f, r in zip(found, raw, strict=True)], "regions": [bytes(f.region) for f in found], "packed": [pack(b"\n".join(r)) for r in raw]}

    return map_rows(rows, ["page_id", "url", "host", "html"], run, f"page_id {dict(rows.dtypes)['page_id']}, url string, host string, copy long, regions binary, packed binary")


def numbered(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (host, path, copy, ...) with their ``place`` in that order over the whole table, and the table behind them."""
    order = ["host", "path", "copy"]
    rows = materialize(pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, local = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part).agg((F.max(local) + 1).alias("n"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + local).drop("_at", "_part", "_before"), rows


def neighboured(pages: DataFrame) -> DataFrame:
    """(host, copy, digests, regions, main, others): every page with the lines of its neighbours in the host."""
    rows = pages.withColumn("stretch", F.floor(F.col("place") / STRETCH))
    low, high = F.floor((F.col("place") - SIDE) / STRETCH), F.floor((F.col("place") + SIDE) / STRETCH)
    spread = rows.withColumn("at", F.explode(F.array_distinct(F.array("stretch", low, high)))).repartition("at")
    beside = Window.partitionBy("at").orderBy("place")
    line = F.struct("host", "digests")
    others = F.array(*[F.lag(line, k).over(beside) for k in range(1, SIDE + 1)], *[F.lead(line, k).over(beside) for k in range(1, SIDE + 1)])
    near = spread.withColumn("_o", others).where(F.col("at") == F.col("stretch"))
    same = F.filter("_o", lambda o: o["host"] == F.col("host"))
    return near.select("host", "copy", "digests", "regions", "main", F.transform(same, lambda o: o["digests"]).alias("others"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(page).alias("html"))
    kinds = outlined(rows).groupBy("host", "copy").agg(F.min("path").alias("path"), F.first("digests").alias("digests"), F.first("regions").alias("regions"), F.first("main").alias("main"))

    def choose(cols: dict[str, list]) -> dict[str, list]:
        found = [decide(d, list(r), o, m) for d, r, o, m in zip(cols["digests"], cols["regions"], cols["others"], cols["main"], strict=True)]
        return {"host": cols["host"], "copy": cols["copy"], "keep": [bytes(k) for k, _ in found], "n_shared": [n for _, n in found]}

    def write(cols: dict[str, list]) -> dict[str, list]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        texts = [written(unpack(p).split(b"\n"), r, keep).decode("utf-8", "surrogatepass") for p, r, keep in zip(cols["packed"], cols["regions"], cols["keep"], strict=True)]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_shared": cols["n_shared"]}

    placed, held = numbered(kinds)
    decided = materialize(map_rows(neighboured(placed), ["host", "copy", "digests", "regions", "others", "main"], choose, "host string, copy long, keep binary, n_shared int"))
    release(held)
    # pages are read again in place of a table of their lines; a merge join at every size, as decisions grow with the
    # pages, whose skewed partitions (a page of very many copies) Spark can split
    both = packed(rows).join(decided.hint("merge"), ["host", "copy"])
    return map_rows(both, ["page_id", "url", "packed", "regions", "keep", "n_shared"], write, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long, n_shared int")
