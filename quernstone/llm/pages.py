"""Main text of web pages by removal of site templates."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import buckets as count_buckets
from ..staging import is_small, stage
from .hashing import mix
from .urls import url_host

# Names of HTML elements and words of class names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
CHROME = frozenset("nav footer form head script style noscript template iframe object svg math canvas button select textarea title dialog menu audio video".split())
#: Chrome unless an article or main element holds them.
OUTER_CHROME = frozenset("header aside".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo banner cookie cookies consent notice notices gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer "
    "comment comments commentlist disqus share sharing social related newsletter subscribe subscription popup modal widget pagination pager masthead toolbar".split()
)
#: Of these, words that may name a part of an article.
MAY_BE_TEXT = frozenset("social menu widget modal masthead header".split())
#: Words of what readers wrote.
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
#: Words that say nothing beside these.
FILLERS = frozenset(
    "area bar block bottom box buttons container content group inner item left link links list main outer page panel posts reader readers right row section site slot thread top unit user users "
    "wrap wrapper".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</?\Z",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[-_:]+")
#: Templates that are sent to all tasks at most: 9 bytes each.
SMALL = 1_000_000
#: Hosts whose pages are split over several groups at most, where templates are more than that.
SPLIT = 1_000_000


class Element:
    """An element with text blocks in it. drop: is marked as chrome; soft: only by a name, which the main part clears; inside: a main element holds it."""

    __slots__ = ("tag", "parent", "depth", "drop", "soft", "hard", "main", "inside", "parts", "hash", "recurs", "gone")

    def __init__(self, tag: str, parent: Element | None, drop: bool = False, soft: bool = False, main: bool = False):
        self.tag, self.parent, self.drop, self.soft, self.main = tag, parent, drop, soft, main
        self.depth = parent.depth + 1 if parent else 0
        self.hard = parent is not None and parent.hard or drop and not soft
        self.inside = main or parent is not None and parent.inside
        self.parts: list[str] = []
        self.hash, self.recurs, self.gone = 0, False, False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if "=" in raw or "hidden" in raw else {}


def _names(said: str, inside: bool) -> tuple[bool, bool]:
    """Whether a class name or id, taken whole, is of chrome, and whether it is of readers' comments.

    A name counts if all its words are of chrome or say nothing beside such, and one is of chrome: ``cookie-notice``, ``site-footer`` and
    ``ad-slot`` do, ``social-history``, ``menu-planning``, ``has-sidebar`` and ``comments-open`` don't. Inside an article, words that may be of its text need another.
    """
    chrome = False
    for name in said.lower().split():
        words = [w for w in PARTS.split(name) if w and not w[0].isdigit()]
        own = [w for w in words if w in CHROME_WORDS]
        if not own or any(w not in CHROME_WORDS and w not in FILLERS for w in words):
            continue
        if COMMENT_WORDS.intersection(own):
            return True, True
        chrome |= not inside or len(own) > 1 or own[0] not in MAY_BE_TEXT
    return chrome, False


def _is_chrome(tag: str, raw: str, inside: bool) -> tuple[bool, bool, bool]:
    """(is chrome, is chrome by its name alone and no comments, is marked as the main part)."""
    if tag in CHROME or tag in OUTER_CHROME and not inside:
        return True, False, False
    if not raw.strip(" /"):
        return False, False, tag in ("article", "main")
    at = _attributes(raw)
    role = at.get("role", "").lower()
    main = tag in ("article", "main") or role == "main" or at.get("itemprop", "").lower() == "articlebody"
    if role in CHROME_ROLES or "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", ""):
        return True, False, False
    named, comments = _names(at.get("class", "") + " " + at.get("id", ""), inside)
    if comments and tag not in ("html", "body", "main"):
        return True, False, False
    soft = named and not main and tag not in ("html", "body")
    return soft, soft, main


def parse(page: str) -> tuple[list[tuple[str, Element]], list[Element]]:
    """The blocks of text of a page, in order, each with the element it stands in; and its elements, parents first, with their subtrees' hashes.

    Time grows with the page, however deep its elements are: names that are open are kept with their depths.
    """
    root = Element("", None)
    elements, stack, opened = [root], [root], {}
    at, text, found, any_main = 0, [], [], False

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                found.append((joined, stack[-1]))
                stack[-1].parts.append(joined)

    def close() -> None:
        e = stack.pop()
        opened[e.tag].pop()
        own = blake2b("\x00".join([e.tag, *e.parts]).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        e.hash = int.from_bytes(own, "little", signed=True)
        e.parent.parts.append(own.hex())

    def shut(names: set[str], stop: set[str]) -> None:
        """Close the innermost open element of one of ``names``, and what is in it, if no element of ``stop`` lies between."""
        depth = max((opened[x][-1] for x in names if opened.get(x)), default=0)
        if depth and depth >= max((opened[x][-1] for x in stop if opened.get(x)), default=0):
            flush()
            while len(stack) > depth:
                close()

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        to = m.start() if m else size
        if to > at:
            piece = page[at:to]
            text.append(html.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, raw = name.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if name in BLOCKS or name in CHROME:
                shut({name}, set())
            continue
        if name in ("br", "hr", "img", "wbr"):
            if name != "wbr":
                flush() if name == "hr" else text.append(" " if name == "br" else "")
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if name in BLOCKS or name in CHROME:
            flush()
            if name in BLOCKS:
                shut({"p"}, {"table", "td", "th", "button", "object"})
            if name in CLOSES:
                shut(CLOSES[name], SCOPES[name])
            top = stack[-1]
            e = Element(name, top, *_is_chrome(name, raw, top.inside))
            # what holds the page's first main element is no chrome, whatever its class says; one in comments or other chrome is not meant
            if e.main and not any_main and not top.hard:
                any_main = True
                for x in stack:
                    x.drop = False
            stack.append(e)
            elements.append(e)
            opened.setdefault(name, []).append(e.depth)
    flush()
    while len(stack) > 1:
        close()
    return found, elements


def _may_recur(e: Element) -> bool:
    return not (e.main or e.tag in ("", "html", "body"))


def template_hashes(page: str) -> set[int]:
    """Hashes of the subtrees of a page that may be its site's: block elements with text, but the page and its main part."""
    return {e.hash for e in parse(page)[1] if e.parts and _may_recur(e)}


def main_text(page: str, levels: Callable[[list[int]], Sequence[int]]) -> str:
    """The main text of a page. ``levels`` of subtrees' hashes: 1 if it goes outside the main element, 2 if inside too, else 0.

    Subtrees that recur go first; then what is marked as chrome. If nothing of the main part (without one, of the page) recurs not, that
    is the page's own text, and is kept.
    """
    blocks, elements = parse(page)
    for e, level in zip(elements, levels([e.hash for e in elements]), strict=True):
        above = e.parent
        e.gone = e.drop or above is not None and above.gone
        e.recurs = above is not None and above.recurs or bool(e.parts) and _may_recur(e) and level >= (2 if e.inside else 1)
    shown = [(said, e) for said, e in blocks if not e.gone]
    main = [(said, e) for said, e in shown if e.inside] or shown
    spared = all(e.recurs for _, e in main)
    own = {id(e) for _, e in main} if spared else ()
    return "\n".join(said for said, e in shown if not e.recurs or id(e) in own)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(template_hashes(page)) if page else [] for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["host", "page", "hashes"])


def _host_key(host: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def _keys(host: str, hashes: np.ndarray) -> np.ndarray:
    """64 bits for a host and each subtree's hash."""
    return mix(hashes.view(np.uint64) + mix(np.array([_host_key(host)]))[0])


class Templates:
    """Sorted keys of hosts' templates, with their levels."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.levels = keys[order], levels[order]

    def text(self, host: str, page: str | None) -> str:
        if not page:
            return ""

        def levels(hashes: list[int]) -> np.ndarray:
            if not len(self.keys):
                return np.zeros(len(hashes), np.int8)
            own = _keys(host, np.array(hashes, np.int64))
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            return np.where(self.keys[at] == own, self.levels[at], 0)

        return main_text(page, levels)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, level of rows of host, hash, level."""
    for batch in batches:
        hosts, hashes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        keys = np.concatenate([_keys(h, hashes[i : i + 1]) for i, h in enumerate(hosts)] or [np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(2)], ["key", "level"])


def _texts(templates: Templates, docs: pa.Table | pa.RecordBatch) -> list[str]:
    return [templates.text(host, page) for host, page in zip(docs.column("host").to_pylist(), docs.column("html").to_pylist(), strict=True)]


def _extract_with(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(*sent.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(_texts(templates, batch), pa.string())], ["id", "url", "text"])

    return run


def _extract(docs: pa.Table, templates: pa.Table) -> pa.Table:
    known = Templates(templates.column("key").to_numpy().view(np.uint64), templates.column("level").to_numpy())
    return pa.table([docs.column("id"), docs.column("url"), pa.array(_texts(known, docs), pa.string())], ["id", "url", "text"])


def _hosted(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    return pages.select(url_host(F.col(url_col)).alias("host"), F.xxhash64(F.col(html_col)).alias("page"), F.col(html_col).alias("html"))


def site_templates(
    pages: DataFrame, *, url_col: str = "url", html_col: str = "html", share: float = 0.01, least: int = 5, inner_share: float = 0.5, inner_least: int = 10
) -> DataFrame:
    """Subtrees that recur on a host: host, hash, level.

    Level 1 is for those on at least ``least`` pages of the host and ``share`` of them, which go outside a page's main element; 2 for
    those on ``inner_least`` and ``inner_share``, which go inside it too. Pages of one html are one page, each counts once for a subtree,
    and counts are added up in the tasks before they meet. A host has at most 1 / share times a page's subtrees of them.
    """
    hosted = _hosted(pages, url_col, html_col)
    pages_once = hosted.mapInArrow(_hashes, "host string, page long, hashes array<long>").groupBy("host", "page").agg(F.first("hashes").alias("hashes"))
    pages_once = pages_once.select("host", F.explode("hashes").alias("hash"))
    counts = pages_once.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min(least, inner_least))
    sizes = hosted.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    level = F.when((F.col("n") >= inner_least) & (F.col("n") >= F.col("pages") * inner_share), 2).when((F.col("n") >= least) & (F.col("n") >= F.col("pages") * share), 1)
    return counts.join(sizes, "host").select("host", "hash", level.cast("int").alias("level")).where("level is not null")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Main text of every page: id_col, url, text.

    A first pass hashes each page's element subtrees and counts them per host (``site_templates``); a second deletes the subtrees that
    recur, then elements whose tag, role or whole class name marks them as chrome (menus, footers, notices, adverts, forms, comments, ...).
    Both hold inside and outside an article or main element; inside, a subtree must recur on more pages, fewer class names count, and
    header and aside elements are text. An article that is a reader's comment is no main part and goes. If all of a page's main part
    recurs, it stays: a page that many copies have keeps its text. Blocks are joined by a line break; inside one, character references
    are decoded and white space is one space.

    Up to a million templates go to all tasks as 9 bytes each, and pages stay where they are. With more, pages and templates
    meet by host, a host of many pages in several groups, dealt by a hash of the whole row. Null and empty html give an empty text; a
    null url is a host of its own (empty). Broken and unclosed markup is read on, as browsers do. Repeated rows each have a result, and
    count as one page. An empty table gives an empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    templates = stage(site_templates(pages, url_col=url_col, html_col=html_col, **options), "templates")
    docs = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host"))
    schema = f"id {docs.schema['id'].dataType.simpleString()}, url string, text string"
    if is_small(templates, SMALL):
        keyed = templates.select("host", "hash", "level").mapInArrow(_keyed, "key long, level int").toArrow()
        sent = spark.sparkContext.broadcast((keyed.column("key").to_numpy().view(np.uint64), keyed.column("level").to_numpy().astype(np.int8)))
        out = docs.mapInArrow(_extract_with(sent), schema)
    else:
        buckets = count_buckets(pages)
        sizes = stage(docs.groupBy("host").agg(F.count("*").alias("pages")), "sizes")
        total = sizes.agg(F.sum("pages")).first()[0] or 0
        share = max(1, total // buckets)
        large = sizes.where(F.col("pages") > max(share, total // SPLIT)).select("host", F.ceil(F.col("pages") / share).alias("salts"))
        large = F.broadcast(large)  # SPLIT hosts at most, whatever the size
        salts = F.coalesce("salts", F.lit(1))
        bucket = F.pmod(F.xxhash64("host", "salt"), F.lit(buckets)).cast("int").alias("bucket")
        salt = F.pmod(F.xxhash64("id", "url", "html"), salts)
        dealt = docs.join(large, "host", "left").withColumn("salt", salt).select(bucket, "id", "url", "html", "host")
        spread = templates.join(large, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        spread = spread.select(bucket, "host", "hash", "level").distinct()
        keyed = spread.select("host", "hash", "level", "bucket").mapInArrow(_keyed_buckets, "bucket int, key long, level int")
        out = dealt.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInArrow(_extract, schema)
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def _keyed_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (keyed,) = _keyed(iter([batch]))
        yield pa.RecordBatch.from_arrays([batch.column(3), *keyed.columns], ["bucket", "key", "level"])
