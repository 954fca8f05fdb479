"""HTML extraction by differencing each page with its nearest URL.

The distinct pages of hosts are sorted by host and path over range partitions, so a frequent host is cut into ranges, and the
neighbours of a page in that order are its nearest URLs. Text lines of every page and of the nearer
neighbour are aligned by their longest common subsequence; shared lines are taken for the site's, not the page's.

The markup says of some lines what they are, and where it speaks and the two disagree it decides, by this rule. Lines in menus, headers, footers,
sidebars, notices, adverts, forms and comments go though the neighbour lacks them, as such lines may differ between pages. Lines in an element that
a page declares as its article stay though shared, as articles share passages, and then no other line stays. Lines of which the markup says nothing
stay if differencing finds them in this page alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from html import unescape
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.shared import partitions, written

PLAIN, ARTICLE, SITE, UNSEEN = 0, 1, 2, 3

# Fixed values of HTML: elements by their kind, and words that authors name regions with.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title iframe"
#: Elements whose text is no part of the text around them; their ends are sought like those of any element.
CONTROLS = frozenset("svg canvas select button".split())
#: A block inside one of these that lacks its end tag ends it, but for the blocks that may stand there.
ENDED = {"svg": frozenset(), "button": frozenset(["div"]), "select": frozenset(["option", "hr", "legend"])}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
SITE_TAGS = frozenset("nav footer aside form menu dialog".split())
SITE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
SITE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond share sharing social related recommended footer masthead toolbar pagination pager widget widgets copyright legal disclaimer".split()
)
#: Elements of running text: inside an article their ids are anchors named by what they say.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
WRAPPING = frozenset("wrap wrapper container layout page has with no without".split())
#: Words that stand beside those in the name of a region, and those that name what a page is about.
BESIDE = frozenset("area areas bar bars block blocks bottom box boxes button buttons inner item items left link links list lists main outer panel post posts primary right secondary section sections site slot slots top unit units".split())
CONTENT = frozenset("article body content entry main post story text".split())
#: Elements that say something without attributes; attributes so short are remembered, as pages repeat them.
TELLING, SHORT = CONTROLS | SITE_TAGS | {"header", "article", "main"}, 200
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())

TAG = re.compile(r"</?([a-z][^\s/>]*+)", re.IGNORECASE)
PLAINLY = re.compile(r"[^<>\"']*+")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW.split()}
ATTRIBUTE = re.compile(r"(?<![a-z-])([a-z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
EMPTY_ATTRIBUTE = re.compile(r"(?:^|\s)hidden(?:\s|/|$)", re.IGNORECASE)


def named_site(names: str, words: frozenset[str] = SITE_WORDS) -> bool:
    """Whether a whole class or id names a region of the site: of these words, and perhaps of words that stand beside them; and none a wrapping one, or what the page is about."""
    if set(WORD.findall(names)) & WRAPPING:
        return False
    parts = [set(re.split("[-_]+", x)) - {""} for x in names.split()]
    return not any(x and CONTENT | BESIDE >= x and x & CONTENT for x in parts) and any(x & words and words | BESIDE >= x for x in parts)


def kind_of(tag: str, attrs: str, kind: int, nested: bool = False, around: bool = False, banner: bool = False) -> int:
    """The kind of region an element opens inside one of ``kind``. What a page declares as its article is one by any name but that of a comment, and but for one ``nested`` in another, as comments are.

    A form ``around`` an article is the page's own; a header in an article is a ``banner`` if it stands in the main part before the article.
    """
    if kind in (SITE, UNSEEN):
        return kind
    if tag in CONTROLS:
        return UNSEEN
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)} if attrs else {}
    role = named.get("role", "").lower()
    if (role in SITE_ROLES or tag in SITE_TAGS) and not (around and tag == "form") or (tag == "header" and (kind != ARTICLE or banner)):
        return SITE
    if named.get("aria-hidden") == "true" or HIDDEN.search(named.get("style", "")) or (attrs and EMPTY_ATTRIBUTE.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs))):
        return SITE
    declared = tag in ("article", "main") or role in ("main", "article") or named.get("itemprop") == "articleBody"
    names = f"{named.get('class', '')} {'' if kind == ARTICLE and tag in ANCHORED else named.get('id', '')}".lower()
    if tag == "article" and named_site(names, COMMENTS):
        return SITE
    if declared and not nested:
        return ARTICLE
    # a table in an article is one of its own, whatever it lists
    if tag not in ("html", "body") and not (around and tag == "form") and not (kind == ARTICLE and tag == "table") and named_site(names):
        return SITE
    return ARTICLE if declared else kind


known_kind = lru_cache(maxsize=4096)(kind_of)


def ends_of(parts: list[tuple[str, str, str]]) -> dict[int, int]:
    """Where each element that has an end tag of its own ends, by the places of tags; the innermost open one of a name ends first."""
    opened: dict[str, list[int]] = {}
    ends = {}
    for i, (_, tag, _) in enumerate(parts):
        if tag.startswith("/"):
            if opened.get(tag[1:]):
                ends[opened[tag[1:]].pop()] = i
        elif tag and tag not in VOID:
            opened.setdefault(tag, []).append(i)
    return ends


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(text before it, tag, attributes) of every tag in one forward scan; a tag of "" is a comment, a declaration or a raw element, "/p" an end.

    A tag runs to the next ">" outside quotes. One that meets a "<" before is text up to there. A quote that isn't closed quotes nothing. A comment or raw
    element that isn't closed takes the rest of the page.
    """
    at = begin = 0
    last, quotes = html.rfind(">"), {q: html.rfind(q) for q in "\"'"}
    vector = 0  # open svg and math elements, in which raw names may close themselves
    while (start := html.find("<", at)) >= 0 and start <= last:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            yield html[begin:start], "", ""
            if end < 0:
                return
            at = begin = end + 3
            continue
        if html.startswith(("<!", "<?"), start):
            yield html[begin:start], "", ""
            at = begin = html.find(">", start) + 1
            continue
        named = TAG.match(html, start)
        if not named:
            at = start + 1
            continue
        here = named.end()
        while True:
            here = PLAINLY.match(html, here).end()
            c = html[here : here + 1]
            if c not in ("\"", "'"):
                break
            here = html.find(c, here + 1) + 1 if quotes[c] > here else here + 1
        if c != ">":
            at = max(here, start + 1)
            if not c:
                break
            continue
        name, attrs = named[1].lower(), html[named.end() : here]
        tag = "/" + name if html[start + 1] == "/" else name
        at = here + 1
        if name in ("svg", "math"):
            vector = max(vector + (1 if tag == name and not attrs.endswith("/") else -1 if tag != name else 0), 0)
        if tag in CLOSING and not (vector and attrs.endswith("/")):
            yield html[begin:start], "", ""
            end = CLOSING[tag].search(html, at)
            at = begin = html.find(">", end.end()) + 1 if end else 0
            if not at:
                return
            continue
        yield html[begin:start], "" if tag in CLOSING else tag, attrs
        begin = at
    yield html[begin:], "", ""


class Elements:
    """The open elements: their kinds, the region each belongs to, and where those of a name stand, so that no look-up walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []
        self.places: dict[str, list[int]] = {}
        self.unseen: list[int] = []
        self.site: list[int] = []

    def __len__(self) -> int:
        return len(self.stack)

    def kind(self, place: int = -1) -> int:
        return self.stack[place][1] if self.stack and place >= -1 else PLAIN

    def region(self) -> int:
        return self.stack[-1][2] if self.stack else PLAIN

    def push(self, name: str, kind: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if kind == UNSEEN:
            self.unseen.append(len(self.stack))
        if kind == SITE != self.kind():
            self.site.append(len(self.stack))
        self.stack.append((name, kind, self.region() if kind == UNSEEN else kind))

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            name, kind, _ = self.stack.pop()
            self.places[name].pop()
            if kind == UNSEEN:
                self.unseen.pop()
        while self.site and self.site[-1] >= place:
            self.site.pop()

    def last(self, *names: str) -> int:
        """Where the innermost element of these names stands, or -1."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def first(self, *names: str) -> int:
        """Where the outermost element of these names stands, or -1."""
        return min((self.places[x][0] for x in names if self.places.get(x)), default=-1)


def lines_of(html: str) -> list[tuple[str, int]]:
    """(text, kind) of every block of text, in page order; white space is one space, character references are decoded."""
    lines: list[tuple[str, int]] = []
    part: list[str] = []
    elements = Elements()
    parts = list(tokens(html))
    opened: list[int] = []  # where the open elements' tags stand

    @lru_cache(maxsize=1)
    def ends() -> dict[int, int]:
        return ends_of(parts)

    @lru_cache(maxsize=2)
    def places(*names: str) -> list[int]:
        return [i for i, (_, tag, _) in enumerate(parts) if tag in names]

    def holds(place: int, after: int, *names: str) -> bool:
        """Whether an element holds any tag of these names behind a place."""
        among = places(*names)
        at = bisect_right(among, after)
        return at < len(among) and among[at] < ends().get(place, len(parts))

    def flush() -> None:
        text = " ".join(unescape("".join(part)).split())
        part.clear()
        if text:
            lines.append((text, elements.region()))

    def close(place: int) -> None:
        below = elements.kind(place - 1) if place else PLAIN
        if below not in (UNSEEN, elements.region()):
            flush()
        elements.cut(place)
        del opened[place:]

    for i, (text, tag, attrs) in enumerate(parts):
        if elements.kind() != UNSEEN:
            part.append(text)
        if not tag:
            part.append(" ")
            continue
        end, tag = tag[0] == "/", tag.removeprefix("/")
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            part.append(" ")
        if end:
            if (place := elements.last(tag)) >= 0:
                close(place)
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        if elements.kind() == UNSEEN and tag in BLOCKS:
            place = elements.first(*(name for name, inside in ENDED.items() if tag not in inside))
            if place >= 0 and elements.last("foreignobject") <= place:
                close(place)
        if tag in ("article", "main"):
            found = [x for x in (elements.first("nav", "header"), elements.unseen[0] if elements.unseen else -1) if x >= 0]
            if found:
                close(min(found))
            # a region of the site that has no end of its own ends where the page's article begins
            if elements.site and opened[elements.site[0]] not in ends():
                close(elements.site[0])
        elif tag in BLOCKS:
            place = elements.last("p", "li") if tag == "li" else elements.last("p")
            if place >= 0 and elements.last("ul", "ol", "div", "section", "article") <= place:
                close(place)
        kind = elements.kind()
        if attrs or tag in TELLING:
            around = tag == "form" and holds(i, i, "article", "main")
            banner = tag == "header" and bool(elements) and elements.stack[-1][0] == "main" and holds(opened[-1], i, "article")
            new = (known_kind if len(attrs) < SHORT else kind_of)(tag, attrs, kind, tag == "article" and elements.last(tag) >= 0, around, banner)
        else:
            new = kind
        if new == UNSEEN != kind:
            part.append(" ")
        elif new != kind:
            flush()
        elements.push(tag, new)
        opened.append(i)
    flush()
    return lines


def hashed(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Of every prefix of ``b``, the empty one first, the length of its longest common subsequence with ``a``: row by row in the bits of one number."""
    bits: dict[int, int] = {}
    for j, x in enumerate(b):
        bits[x] = bits.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & bits.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    packed = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(packed, bitorder="little")[: len(b)].astype(np.int64))])


def common(a: list[int], b: list[int]) -> np.ndarray:
    """Which places of ``a`` a longest common subsequence with ``b`` uses.

    Lines that the other lacks and equal ends are set aside; the rest is halved again and again where the best subsequences of both halves meet, so
    memory grows with the lines, not with their product.
    """
    used = np.zeros(len(a), bool)
    both = set(a) & set(b)
    work = [([i for i, x in enumerate(a) if x in both], [x for x in b if x in both])]
    while work:
        places, other = work.pop()
        low, high = 0, min(len(places), len(other))
        while low < high and a[places[low]] == other[low]:
            low += 1
        tail = 0
        while tail < high - low and a[places[-1 - tail]] == other[-1 - tail]:
            tail += 1
        used[places[:low]] = True
        used[places[len(places) - tail :]] = True
        places, other = places[low : len(places) - tail], other[low : len(other) - tail]
        if not places or not other:
            continue
        if len(places) == 1:
            used[places[0]] = a[places[0]] in other
            continue
        half = len(places) // 2
        ahead = prefix_lengths([a[i] for i in places[:half]], other)
        behind = prefix_lengths([a[i] for i in places[:half - 1:-1]], other[::-1])[::-1]
        cut = int(np.argmax(ahead + behind))
        work += [(places[:half], other[:cut]), (places[half:], other[cut:])]
    return used


PARSED = T.StructType([T.StructField("key", T.StringType()), T.StructField("kinds", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("texts", T.BinaryType())])
ARROW_PARSED = pa.struct([("key", pa.string()), ("kinds", pa.binary()), ("hashes", pa.binary()), ("texts", pa.binary())])


def parsed(html: Column, texts: bool) -> Column:
    """The kinds (a byte each) and hashes (eight) of the lines of each page, and a key that equal lists of them share; with ``texts`` also the lines that may stay, those of the declared article or else those of which the markup says nothing, compressed."""

    @F.arrow_udf(returnType=PARSED)
    def parse(column: pa.Array) -> pa.Array:
        codec, out = pa.Codec("zstd"), []
        for x in column:
            lines = lines_of(x.as_py() or "")
            kinds, hashes = bytes(k for _, k in lines), np.array([hashed(t) for t, _ in lines], "<i8").tobytes()
            may = "\n".join(t for t, k in lines if k == wanted(kinds)).encode() if texts else b""
            out.append({"key": md5(hashes).hexdigest(), "kinds": kinds, "hashes": hashes, "texts": len(may).to_bytes(8, "little") + codec.compress(may, asbytes=True) if texts else None})
        return pa.array(out, ARROW_PARSED)

    return parse(html)


def wanted(kinds: bytes) -> int:
    """The kind of lines that may stay: the article's where there is one."""
    return ARTICLE if ARTICLE in kinds else PLAIN


def shared_with(hashes: bytes, path: str, near: list[dict] | None) -> np.ndarray:
    """Which lines are shared with the page, of those in ``near``, whose path has the longest common start; none without such a page."""
    others = [x for x in near or [] if x]
    partner = max(others, key=lambda x: len(commonprefix([x["_path"], path])))["hashes"] if others else b""
    return common(*(np.frombuffer(x, "<i8").tolist() for x in (hashes, partner)))


def shared_lines(hashes: Column, path: Column, near: Column) -> Column:
    """Which lines the nearest URL shares."""

    @F.arrow_udf(returnType=T.ArrayType(T.BooleanType()))
    def align(hashes: pa.Array, path: pa.Array, near: pa.Array) -> pa.Array:
        return pa.array([shared_with(*x) for x in zip(hashes.to_pylist(), path.to_pylist(), near.to_pylist(), strict=True)], pa.list_(pa.bool_()))

    return align(hashes, path, near)


def decided(page: Column, path: Column, near: Column) -> Column:
    """The text of a parsed page: of the lines that may stay those that are the article's, or that the nearest URL doesn't share."""

    @F.arrow_udf(returnType=T.StringType())
    def decide(page: pa.Array, path: pa.Array, near: pa.Array) -> pa.Array:
        codec, out = pa.Codec("zstd"), []
        for p, at, n in zip(page.to_pylist(), path.to_pylist(), near.to_pylist(), strict=True):
            shared, kinds = shared_with(p["hashes"], at, n), np.frombuffer(p["kinds"], np.uint8)
            may = np.flatnonzero(kinds == wanted(p["kinds"]))
            size = int.from_bytes(p["texts"][:8], "little")
            lines = codec.decompress(p["texts"][8:], size, asbytes=True).decode().split("\n") if size else []
            out.append("\n\n".join(t for t, i in zip(lines, may, strict=True) if kinds[i] == ARTICLE or not shared[i]))
        return pa.array(out, pa.string())

    return decide(page, path, near)


ORDER = ("_host", "_path", "key")


def beside(pages: DataFrame) -> DataFrame:
    """``(_host, key, near)`` of distinct pages ``(_host, _path, key, hashes, _part)``: the path and hashes of the two next to each in the order of its host's paths.

    ``_part`` is the range partition. The first and last rows of each range are copied to the ranges next to it, so neighbours across
    its ends count too; what is collected is the list of ranges.
    """
    spark = pages.sparkSession
    parts = sorted(r[0] for r in pages.select("_part").distinct().collect())
    within = Window.partitionBy("_part").orderBy(*ORDER)
    back = Window.partitionBy("_part").orderBy(*(F.desc(c) for c in ORDER))
    edge = pages.withColumn("_up", F.row_number().over(within)).withColumn("_down", F.row_number().over(back))
    pairs = spark.createDataFrame(list(zip(parts[:-1], parts[1:], strict=True)) or [(-1, -1)], "_before int, _after int")
    heads = edge.where("_up = 1").join(pairs, F.col("_part") == F.col("_after")).withColumn("_part", F.col("_before"))
    tails = edge.where("_down = 1").join(pairs, F.col("_part") == F.col("_before")).withColumn("_part", F.col("_after"))
    guests = heads.union(tails).select(*pages.columns, F.lit(True).alias("_guest"))
    page = F.struct("_path", "hashes")
    near = [F.when(shift("_host").over(within) == F.col("_host"), shift(page).over(within)) for shift in (F.lag, F.lead)]
    return pages.withColumn("_guest", F.lit(False)).union(guests).withColumn("near", F.array(*near)).where("not _guest").select("_host", "key", "near")


def beside_each(pages: DataFrame, texts: bool) -> DataFrame:
    """``(page_id, url, _path, page, near)`` of every page: what ``parsed`` gives, and the path and hashes of its nearest URLs.

    Pages are parsed once for the order of URLs, without texts, and again for what goes on with their neighbours: cheaper than keeping or moving more than is needed.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^#]*)", 1)
    placed = pages.select("page_id", "url", "html", host.alias("_host"), path.alias("_path"))
    lines = placed.select("_host", "_path", parsed(F.col("html"), False).alias("_p")).select("_host", "_path", "_p.key", "_p.hashes")
    distinct = lines.where(F.length("hashes") > 0).groupBy("_host", "key").agg(F.min(F.struct("_path", "hashes")).alias("_page"))
    distinct = distinct.select("_host", "_page._path", "key", "_page.hashes").repartitionByRange(partitions(pages), *ORDER)
    near = beside(written(distinct.withColumn("_part", F.spark_partition_id()), "distinct"))
    whole = placed.select("page_id", "url", "_host", "_path", parsed(F.col("html"), texts).alias("page")).withColumn("key", F.col("page.key"))
    return whole.join(near, ["_host", "key"], "left").select("page_id", "url", "_path", "page", "near")


def aligned(pages: DataFrame) -> DataFrame:
    """``(page_id, url, kinds, shared)`` of every page: of all its lines their kinds by the markup, a byte each, and whether the nearest URL shares them."""
    return beside_each(pages, False).select("page_id", "url", F.col("page.kinds").alias("kinds"), shared_lines(F.col("page.hashes"), F.col("_path"), F.col("near")).alias("shared"))


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page.

    A null or empty html, and a page without text of its own, give the empty text. Pages of a host with the same lines are one page
    when neighbours are sought, that of the least path, so copies are not differenced with each other, nor any page with one without text. A page whose host has no other page that
    differs loses no line by differencing; pages without a URL have the empty host. Repeated rows get a row each.
    """
    texts = beside_each(pages, True).select("page_id", "url", decided(F.col("page"), F.col("_path"), F.col("near")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
