"""Main text of web pages by consensus of the pages of a host.

Each page's containers are scored by the text that stands in them outside links and outside menus, forms, adverts
and the like. A container is named by its generalised path, the tags and classes from the root with digits taken
out, so that pages of one template share names; paths are told apart by 128-bit keys, each made from its parent's. Each page shares its vote among
its paths by their scores; votes are summed per host and path in Spark, and every page is read again with its host's winning path. A page
without that path uses its own best one. Text that stands beside the winning containers, such as a title, a lead or a last
paragraph, is the article's too, unless it is mostly links or a mere label.

What is outside is told by tags, roles and whole class names. A name or a form around most of the page's free text
describes the page and takes nothing out, unless it is one of reader comments; inside an article element, a compound name that may also be a heading's
takes out lists of links only. Parsing and scoring take time in proportion to the page, however deep its elements lie.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, workers_import_us

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|annotation|annotation-xml|select|audio|video|canvas|title)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")

_CONTAINERS = frozenset("html body main article section div table tbody tr td th ul ol li dl dd nav header footer aside form figure blockquote center details fieldset dialog menu head address hgroup".split())
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre dt summary figcaption caption legend button label".split())
_BLOCKS = _CONTAINERS | _TEXT_BLOCKS
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements and roles that hold no article text.
_OUT_TAGS = frozenset("head nav footer aside menu dialog button".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_OUT_NAME = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|sidebar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|popup|modal|newsletter|subscri\w+|shar(?:e|ing)|social"
    r"|comments?|commentlist|replies|reply|respond|disqus|footer|masthead|login|signup|toolbar|pagination|pager|hidden"
)
#: Words that also name sections of articles when they stand in a compound: related-work, notice-board, search-methods.
_MAYBE_NAME = re.compile(r"banner\w*|notices?|overlay|related|recommend\w*|search|widgets?|skip")
_COMMENT_NAME = re.compile(r"comments?|commentlist|replies|reply|respond|disqus")
_HEADER_NAME = re.compile(r"header|topbar")
_GOOD_NAME = re.compile(r"article|content|post|entry|story|main|text|body")
#: Elements whose text is prose or its heading, and what tells other text from a mere label: its length or the end of a sentence.
_PROSE = frozenset("p pre h1 h2 h3 h4 h5 h6 figcaption blockquote".split())
LABEL = 80
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)]*$")
#: A class name that begins or ends so tells what the page has, not what the element is.
_TELLS_FIRST = frozenset("has no with without is not show hide".split())
_TELLS_LAST = frozenset("open closed on off enabled disabled".split())


@lru_cache(maxsize=1 << 14)
def _meaning(names: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether class names and id, separated by spaces, are ones of outside parts, of what may be such, of reader comments, of headers and of articles."""
    found = [False] * 5
    for name in names.lower().split():
        parts = [x for x in re.split(r"[_-]+", name) if x]
        if not parts or parts[0] in _TELLS_FIRST or parts[-1] in _TELLS_LAST:
            continue
        found[0] |= any(_OUT_NAME.fullmatch(x) for x in parts) or (len(parts) == 1 and bool(_MAYBE_NAME.fullmatch(parts[0])))
        found[1] |= any(_MAYBE_NAME.fullmatch(x) for x in parts)
        found[2] |= bool(_COMMENT_NAME.fullmatch(parts[0]))
        found[3] |= any(_HEADER_NAME.fullmatch(x) for x in parts)
        found[4] |= any(_GOOD_NAME.fullmatch(x) for x in parts)
    return tuple(found)


@dataclass(slots=True)
class _Node:
    tag: str
    parent: int
    name: str  # tag and classes of a container, else empty
    key: bytes  # of the path of names from the root
    out: bool  # by its tag or role, or as comments
    told: bool  # out by its names, or a form: unless it holds most of the page
    maybe: bool  # out by its names if it is mostly links
    article: bool
    weight: float


@dataclass
class Page:
    """Containers of a page and its blocks of text: (container, text, share of it outside links)."""

    nodes: list = field(default_factory=list)
    blocks: list = field(default_factory=list)


def _names(attributes: str) -> dict[str, str]:
    found = {}
    for k, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        found.setdefault((k or hidden).lower(), a or b or c)
    return found


def parse(source: str) -> Page:
    page = Page()
    nodes = page.nodes
    nodes.append(_Node("", -1, "", b"", False, False, False, False, 0.0))
    stack, here, link, text, linked = [0], 0, False, [], 0
    still_open: Counter = Counter()  # tags on the stack

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                page.blocks.append((here, words, 1 - min(1.0, linked / max(1, sum(map(len, text))))))
            text.clear()
        linked = 0

    def close() -> None:
        still_open[nodes[stack.pop()].tag] -= 1

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
            linked += link * (m.start() - at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] is None and not m[0].startswith(("<!", "<?")):
                text.append(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            link = not m["end"]
        elif tag in ("br", "img"):
            text.append(" ")
        elif tag == "hr":
            flush()
        if tag not in _BLOCKS:
            continue
        flush()
        link = False
        if m["end"]:
            if still_open[tag] > 0:
                while nodes[stack[-1]].tag != tag:
                    close()
                close()
            here = stack[-1]
            continue
        if nodes[here].tag in _TEXT_BLOCKS and len(stack) > 1:
            close()
        elif tag in ("li", "td", "th", "tr", "dd", "dt") and nodes[stack[-1]].tag == tag:
            close()
        up = nodes[stack[-1]]
        own = _names(m["attributes"]) if m["attributes"].strip() else {}
        name = f"{own.get('class', '')} {own.get('id', '')}".strip()
        inside = up.article or tag in ("article", "main")
        named, maybe, comments, header, good = _meaning(name) if name and tag not in ("html", "body") else (False,) * 5
        out = comments or tag in _OUT_TAGS or own.get("role", "") in _OUT_ROLES or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
        out = up.out or out or (not up.article and tag == "header")
        told = named or (maybe and not up.article) or tag == "form" or (not up.article and header)
        container = tag in _CONTAINERS
        classes = ".".join(sorted(re.sub(r"\d+", "#", c) for c in own.get("class", "").lower().split()))
        path = f"{tag}{'.' + classes if classes else ''}" if container else ""
        weight = 1.5 if tag in ("article", "main") else 1.3 if good else 0.5 if tag in ("html", "body", "") else 1.0
        key = hashlib.blake2b(up.key + path.encode("utf-8", "surrogatepass"), digest_size=16).digest() if container else up.key
        nodes.append(_Node(tag, stack[-1], path, key, out, told, maybe, inside, weight if container else 0.0))
        here = len(nodes) - 1
        if tag not in _VOID:
            stack.append(here)
            still_open[tag] += 1
    if at < len(source):
        text.append(source[at:])
        linked += link * (len(source) - at)
    flush()
    _drop_outside(page)
    return page


def _drop_outside(page: Page) -> None:
    """Leave only the blocks of page that aren't outside."""
    nodes = page.nodes
    held, free_of = [0] * len(nodes), [0.0] * len(nodes)
    for node, text, free in page.blocks:
        if not nodes[node].out:
            held[node] += len(text)
            free_of[node] += len(text) * free
    for k in range(len(nodes) - 1, 0, -1):  # children stand after their parents
        held[nodes[k].parent] += held[k]
        free_of[nodes[k].parent] += free_of[k]
    for k, n in enumerate(nodes[1:], 1):
        n.out = n.out or nodes[n.parent].out or (n.told and 2 * free_of[k] <= free_of[0]) or (n.maybe and 2 * free_of[k] < held[k])
    page.blocks = [b for b in page.blocks if not nodes[b[0]].out]


def path_scores(page: Page) -> dict[bytes, float]:
    """Each container path's score by its key: its text outside links, a tenth less for each level between, by the kind of container."""
    held = [0.0] * len(page.nodes)
    for node, text, free in page.blocks:
        held[node] += len(text) * free
    found: dict[bytes, float] = {}
    for k in range(len(page.nodes) - 1, 0, -1):
        n = page.nodes[k]
        if held[k] and n.weight:
            found[n.key] = found.get(n.key, 0.0) + held[k] * n.weight
        held[n.parent] += held[k] * (0.9 if n.weight else 1.0)
    return found


def path_of(page: Page, key: bytes) -> str | None:
    """The path of that key, as far as page has it: its containers' names from the root."""
    node = next((k for k, n in enumerate(page.nodes) if n.weight and n.key == key), -1)
    names = []
    while node >= 0:
        names.append(page.nodes[node].name)
        node = page.nodes[node].parent
    return ">" + ">".join(x for x in names[::-1] if x) if names else None


def text_under(page: Page, key: bytes | None) -> str:
    """The blocks below containers of that path and those beside them that belong to the article, one a line; of the whole page for None. Empty if there is no such container with text."""
    nodes = page.nodes
    inside, around = [key is None] * len(nodes), [False] * len(nodes)
    for k, n in enumerate(nodes[1:], 1):
        inside[k] = inside[n.parent] or (n.weight > 0 and n.key == key)
    for k in range(len(nodes) - 1, 0, -1):
        around[nodes[k].parent] |= around[k] or inside[k]
    if not any(inside[node] for node, _, _ in page.blocks):
        return ""
    # A block beside belongs to a part: the largest element around it that holds no winner, or the block alone.
    part = list(range(len(nodes)))
    named = [False] * len(nodes)  # a name of outside parts that holds no winner takes its element out, however much it holds
    for k, n in enumerate(nodes[1:], 1):
        named[k] = not around[k] and (n.told or named[n.parent])
        if not around[k] and not around[n.parent]:
            part[k] = part[n.parent]
    size, free_of, told = Counter(), Counter(), set()
    for i, (node, text, free) in enumerate(page.blocks):
        own = ("block", i) if around[node] else part[node]
        size[own] += len(text)
        free_of[own] += len(text) * free
        if nodes[node].tag in _PROSE or len(text) >= LABEL or _SENTENCE.search(text):
            told.add(own)
    # A container that outweighs the winners is their rival, and lost.
    most = sum(len(text) * free for node, text, free in page.blocks if inside[node])
    rival = lambda own: isinstance(own, int) and nodes[own].weight > 0 and free_of[own] > most
    belongs = lambda own: own in told and 2 * free_of[own] >= size[own] and not rival(own)
    return "\n".join(text for i, (node, text, _) in enumerate(page.blocks) if inside[node] or not named[node] and belongs(("block", i) if around[node] else part[node]))


def _shares(scores: dict[bytes, float]) -> list[tuple[bytes, float]]:
    """Path keys with their shares of the score, the best first; ties by key."""
    total = sum(scores.values())
    return [(p, s / total) for p, s in sorted(scores.items(), key=lambda x: (-x[1], x[0])) if s > 0]


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, path): per host the key of the path with the most votes, the smallest of equals; each page shares its vote among its paths."""

    def vote(batches):
        for b in batches:
            hosts, paths, shares = [], [], []
            for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for path, share in _shares(path_scores(parse(source.as_py() or ""))):
                    hosts.append(host)
                    paths.append(path)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.binary()), pa.array(shares, pa.float64())], names=["host", "path", "share"])

    votes = pages.select(host_of(url).alias("host"), F.col(html)).mapInArrow(vote, "host string, path binary, share double")
    summed = votes.groupBy("host", "path").agg(F.sum("share").alias("votes"))
    # Rounded, so that the order in which shares were added can't decide.
    return summed.groupBy("host").agg(F.min(F.struct((-F.round("votes", 6)).alias("against"), "path")).alias("top")).select("host", "top.path")


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html") -> DataFrame:
    """keep columns, text (blocks by line ends; empty if there is none), path (the container path used, if any) and by_host.

    Null and empty pages have an empty text. Pages without a host vote together as the host ''. Pages of any length are
    read whole. Every row votes and gives a row, repeated ones too. Other columns of pages, whatever their names, don't matter; keep may not name
    text, path or by_host. Winners go to every task where Spark finds their written table below its broadcast threshold.
    """
    from pyspark.sql import types as T

    workers_import_us(pages.sparkSession)
    winners = materialize(winning_paths(pages, url, html))
    names = list(keep)
    rows = pages.select(*names, host_of(url).alias("af_host"), F.col(html).alias("af_html"))
    joined = rows.join(winners.select(F.col("host").alias("af_host"), F.col("path").alias("af_path")), "af_host", "left").select(*names, "af_path", "af_html")
    schema = T.StructType([*joined.select(*names).schema.fields, *T.StructType.fromDDL("text string, path string, by_host boolean").fields])

    def read(batches):
        for b in batches:
            texts, used, ours = [], [], []
            for key, source in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1), strict=True):
                page = parse(source.as_py() or "")
                text = text_under(page, key) if key else ""
                ours.append(bool(text))
                if not text:
                    own = _shares(path_scores(page))
                    key = own[0][0] if own else None
                    text = text_under(page, key)
                texts.append(text)
                used.append(key and path_of(page, key))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array(used, pa.string()), pa.array(ours, pa.bool_())], names=schema.names)

    return joined.mapInArrow(read, schema)
