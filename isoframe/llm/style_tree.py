"""HTML extraction with a site style tree.

The pages of a host are merged into one tree of styles. A node of it is the path of a page's block elements (tag, class
and id, without digits). Over the pages that have the node:

- presentation: the entropy of the sequences of child elements below it, to the base of the number of pages (a menu is
  built the same on every page, an article is not);
- content: one less the mean, over its texts, of log(pages with the text) / log(pages) (a text of its own on every page
  counts 1, one that every page repeats counts 0).

importance = (1 - GAMMA) * presentation + GAMMA * content, with both 1 on a host's single page. What the markup itself
declares shifts it: within an article or main element it gains LIFT, in elements that are declared to be something
else (menus, headers, footers, sidebars, notices, adverts, forms, comments, by tag, role, class or id) it loses all.

LIFT is less than LEAST, so what a host repeats goes from its articles too. On a page with an article, a node below LEAST
loses its own texts only and the branches in it are judged for themselves, so the words around an article never cost it,
nor those around a paragraph; text outside the article goes. If nothing of an article were left, the page is a
copy rather than a frame, and its article stays whole. A class name or id declares something only as a whole name
("sidebar", "site-header", not "has-sidebar"), and those of the body or of an article declare nothing. Without an article, branches below LEAST go with all below them,
and a branch must also not be mostly links. The blocks that stay are joined in page order.

Pages of a host with the same markup count once, so that copies of a page don't look like what all pages repeat.

The tree is counted, not collected: each page gives its nodes and texts once, as 64-bit keys that hold the host, so a host
with a third of all pages is spread over the keys of its styles and texts and summed before each shuffle. Only the nodes
of low importance that a page has travel to it. Null html is empty; null urls are one host; repeated pages each give
a row; broken markup is read as browsers do (implied ends, tags that nothing closes dropped).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, small, stored

GAMMA = 0.8
LEAST = 0.3
LIFT = 0.2
LINKS = 0.6
FILTER_BITS = 1 << 26

# Quotes count only where a value begins; what an attribute holds is never tried twice (possessive).
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)|[^<>=]|=)*+)>"
    r"|<[!?/][^>]*>?|<(?=[a-zA-Z])[^<>]*(?=<|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|itemprop)(?![^\s=/>])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Elements without text of the page; those of the first kind run to the end of the page if nothing closes them.
RAW = frozenset("script style textarea title iframe noscript".split())
DROPPED = RAW | frozenset("template svg math select object button".split())
# Element kinds of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "legend", "figcaption", "summary"}
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
SCOPES = frozenset("table ul ol dl body html".split())
# Elements, roles and class words that declare something else than the article.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog fieldset head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs"
    " header masthead footer sidebar side aside widget widgets notice notices cookie cookies consent gdpr popup modal overlay alert"
    " comment comments commentlist reply replies respond disqus discussion share sharing social related recommended newsletter"
    " subscribe signup login search form pagination pager toolbar skip topbar bottombar copyright tracking".split()
)
MAIN_WORDS = frozenset("article main".split())
# Words that a class name may have beside those: it names the same thing. Any other word (has-, no-, -enabled) makes it another name.
BESIDE = frozenset(
    "site page global top bottom left right primary secondary main box block list item items link links bar wrapper wrap container inner"
    " outer area section panel slot unit module group region zone col column content body text title row strip button buttons icon icons".split()
)
SALTS = 16


CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in DROPPED}


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


class Node:
    __slots__ = ("name", "tag", "path", "role", "parent", "children", "links", "size")

    def __init__(self, name: str, path: int, role: int, parent: Node | None, tag: str = ""):
        self.name, self.tag, self.path, self.role, self.parent = name, tag, path, role, parent
        self.children: list = []  # nodes and texts in page order
        self.links = self.size = 0


@lru_cache(maxsize=10_000)
def names_aside(name: str) -> bool:
    """Whether a whole class name or id is one of ASIDE_WORDS, with nothing beside it but BESIDE."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    return any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in BESIDE for w in words)


def declared(tag: str, attrs: dict[str, str]) -> int:
    """-1: something else than the article; 1: the article; 0: neither. The names of a page's body or article only style it."""
    names, role = (attrs.get("class", "") + " " + attrs.get("id", "")).split(), attrs.get("role", "").lower()
    if tag in ASIDE_TAGS or role in ASIDE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return -1
    if tag in ("article", "main") or role in ("article", "main") or attrs.get("itemprop", "").lower() == "articlebody":
        return 1
    if tag != "body" and any(map(names_aside, names)):
        return -1
    return 1 if tag != "body" and any(x.lower() in MAIN_WORDS for x in names) else 0


def parse(html: str, host: str) -> Node:
    """The tree of block elements; inline markup melts into the texts of its block."""
    root = Node("root", xxhash.xxh3_64_intdigest(host.encode()), 0, None)
    here, buffer, link, at = root, [], 0, 0

    def closed(node, last):
        """The parent of the node above (or at) this one that is the last to be closed."""
        while True:
            opened[node.tag] -= 1
            if last(node):
                return node.parent
            node = node.parent

    def flush():
        text = " ".join("".join(buffer).split())
        if text:
            here.children.append(text)
            here.size += len(text)
        buffer.clear()

    opened: Counter = Counter()  # open blocks by tag, so that a stray end costs no walk
    endless: set[str] = set()  # elements that nothing closes any more
    place = 0
    while m := TOKEN.search(html, place):
        if m.start() > at:
            text = entities.unescape(html[at : m.start()])
            buffer.append(text)
            if link:
                here.links += len(text.strip())
        at = place = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in DROPPED:
            if not m["end"] and tag not in endless and not (tag in ("svg", "math") and m["attrs"].endswith("/")):
                end = CLOSING[tag].search(html, at)
                if end:
                    at = place = end.end()
                elif tag in RAW:
                    at = place = len(html)
                else:
                    endless.add(tag)
            continue
        if tag == "br":
            buffer.append(" ")
        elif tag == "a":
            link = 0 if m["end"] else 1
        elif tag == "head" or tag == "html":
            continue
        elif tag in BLOCKS:
            flush()
            if m["end"]:
                if opened[tag]:
                    here = closed(here, lambda node: node.tag == tag)
                continue
            kinds = OWN_KIND.get(tag, ())
            node, back = here, None
            while node is not None:
                if node.tag == "p" and tag in CLOSES_P or node.tag in kinds:
                    back = node
                if node.tag in SCOPES or (node.tag != "p" and node.tag not in kinds and not kinds):
                    break
                node = node.parent
            if back is not None:
                here = closed(here, lambda node: node is back)
            if tag in VOID:
                continue
            attrs = {k.lower(): (a or b or c).strip() for k, a, b, c in ATTRIBUTE.findall(m["attrs"])} if m["attrs"] else {}
            sort = ".".join([tag, *sorted(set(re.sub(r"\d+", "", attrs.get("class", "")).lower().split())), *re.sub(r"\d+", "", attrs.get("id", "")).split()])
            path = xxhash.xxh3_64_intdigest(sort.encode(), seed=here.path)
            node = Node(sort, path, declared(tag, attrs), here, tag)
            here.children.append(node)
            here = node
            opened[tag] += 1
    if at < len(html):
        buffer.append(entities.unescape(html[at:]))
    flush()
    return root


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def below(root: Node) -> Iterator[Node]:
    """A node and all nodes below it; pages may be nested deeper than calls can be."""
    left = [root]
    while left:
        node = left.pop()
        yield node
        left.extend(c for c in node.children if not isinstance(c, str))


def styles(root: Node, out: dict) -> None:
    """For each path of the page: its child sequences and its texts."""
    for node in below(root):
        seen = out.setdefault(node.path, (set(), set()))
        seen[0].add(xxhash.xxh3_64_intdigest("|".join("#" if isinstance(c, str) else c.name for c in node.children).encode()))
        seen[1].update(xxhash.xxh3_64_intdigest(c.encode()) for c in node.children if isinstance(c, str))


def blocks(root: Node, importance, main: bool, found: list[str]) -> None:
    """The texts that stay, in page order."""
    left = [(iter(root.children), False, True)]  # what is left of each open node, whether it's inside an article, whether its own texts stay
    while left:
        children, inside, own = left[-1]
        c = next(children, None)
        if c is None:
            left.pop()
        elif isinstance(c, str):
            if own and (inside or not main):
                found.append(c)
        elif c.role >= 0:
            within = inside or c.role > 0
            low = importance(c.path) + LIFT * within < LEAST
            if main or not (low or (c.size and c.links > LINKS * c.size)):
                left.append((iter(c.children), within, not low))


def has_main(root: Node) -> bool:
    """Whether an article lies in no element that is declared to be something else."""
    left = [root]
    while left:
        for c in left.pop().children:
            if not isinstance(c, str) and c.role >= 0:
                if c.role > 0:
                    return True
                left.append(c)
    return False


def text_of(html: str, host: str, low: dict[int, float]) -> str:
    root = parse(html, host)
    main = has_main(root)
    found: list[str] = []
    blocks(root, lambda path: low.get(signed(path), 1.0), main, found)
    if main and low and not found:
        blocks(root, lambda path: 1.0, main, found)
    return "\n\n".join(found)


def node_importance(pages: DataFrame, url: str, html: str) -> tuple[DataFrame, DataFrame]:
    """(page key, node) of all pages, and (node, importance)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches, "html"):
            rows: list[tuple] = []
            for key, u, h in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html")), strict=True):
                out: dict = {}
                styles(parse(h or "", host_of(u)), out)
                page = signed(xxhash.xxh3_64_intdigest((h or "").encode()))
                for path, (shapes, texts) in out.items():
                    shape = 0
                    for x in shapes:
                        shape ^= x
                    rows.append((key, signed(path), signed(shape), [signed(x) for x in texts], page))
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array([r[0] for r in rows], pa.int64()), "node": pa.array([r[1] for r in rows], pa.int64()),
                 "shape": pa.array([r[2] for r in rows], pa.int64()), "texts": pa.array([r[3] for r in rows], pa.list_(pa.int64())), "page": pa.array([r[4] for r in rows], pa.int64())}
            )

    nodes = stored(pages.transform(in_arrow, run, "key bigint, node bigint, shape bigint, texts array<bigint>, page bigint"), "style-nodes")
    n_log_n = lambda n: F.sum(n * F.log(n.cast("double")))
    shapes = nodes.select("node", "shape", "page").distinct().groupBy("node", "shape").agg(F.count("*").alias("n")).groupBy("node").agg(F.sum("n").alias("m"), n_log_n(F.col("n")).alias("s"))
    texts = nodes.select("node", F.explode("texts").alias("t"), "page").distinct().groupBy("node", "t").agg(F.count("*").alias("n"))
    texts = texts.groupBy("node").agg(F.sum("n").alias("k"), n_log_n(F.col("n")).alias("r"))
    m = F.col("m").cast("double")
    presentation = F.when(F.col("m") > 1, 1 - F.col("s") / (m * F.log(m))).otherwise(1.0)
    content = F.when((F.col("m") > 1) & (F.col("k") > 0), 1 - F.col("r") / (F.col("k") * F.log(m))).otherwise(1.0)
    found = shapes.join(texts, "node", "left").select("node", ((1 - GAMMA) * presentation + GAMMA * content).alias("importance"))
    return nodes.select("key", "node"), found


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of pages."""
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    keyed = named.withColumn("key", F.xxhash64("page_id", "url"))
    nodes, importance = node_importance(keyed.select("key", "url", "html"), "url", "html")
    low = importance.where(F.col("importance") < LEAST)
    # A template's node is on every page of its host: its pages are dealt to SALTS tasks.
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    lows = stored(nodes.join(low, ["node", "salt"]).groupBy("key").agg(F.collect_set(F.struct("node", "importance")).alias("low")), "low-nodes")  # of one page
    # A bitmap of the keys with such nodes (FILTER_BITS bits at most, as 64-bit words) spares all other pages the shuffle.
    place = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    word, bit = F.floor(place / 64).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    bits = lows.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    tagged = keyed.withColumn("word", word).join(F.broadcast(bits), "word", "left").withColumn("some", F.coalesce(F.getbit("bits", bit) == 1, F.lit(False)))
    columns = ["page_id", "url", "html", "low"]
    plain = tagged.where(~F.col("some")).withColumn("low", F.lit(None).cast(dict(lows.dtypes)["low"])).select(columns)
    joined = plain.unionByName(tagged.where("some").join(lows, "key", "left").select(columns))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches, "html"):
            texts = [
                text_of(h or "", host_of(u), {x["node"]: x["importance"] for x in low or ()})
                for u, h, low in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "low")), strict=True)
            ]
            yield pa.RecordBatch.from_pydict(
                {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                 "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )

    kind = dict(named.dtypes)["page_id"]
    return joined.transform(in_arrow, run, f"page_id {kind}, url string, text string, n_chars bigint")
