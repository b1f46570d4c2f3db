"""Main text of HTML pages by wrapper induction.

1. Every page becomes a tree; its skeleton keeps block elements with their
   classes, and equal neighbouring leaves count as one repeated slot.
2. Per host the commonest skeleton is the wrapper. All other skeletons of the
   host are aligned with it by simple tree matching, once per skeleton.
3. Slot texts of all pages are counted along that alignment: a slot with one and
   the same text on ``CONSTANT`` of a host's pages is template, the others vary.
4. Varying slots are content unless they are page furniture by element or class
   (menus, adverts, forms, comments, ...); of what is left the article element,
   or else the densest container, gives the text.

Counts are combined per task and by Spark, one row per slot text; the wrapper of
a host is one row. Pages of one host are spread over salted keys, so a host with
a third of all pages does not meet in one task.

Defined cases: null, empty or text-free HTML gives an empty text; text without
any element is one block; a null or malformed URL is a host of its own; unclosed
and crossed elements are closed where their parent ends; elements nested deeper
than ``DEEPEST`` end a block around each text of theirs; equal rows are kept
each; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: Share of a host's pages that makes a slot text template, and pages a host needs for it.
CONSTANT, FEWEST_PAGES = 0.9, 10
#: Hosts whose wrappers may be broadcast (a wrapper has a few kB), and salts of a host otherwise.
BROADCAST_HOSTS, SALTS = 2_000, 16
#: Worths of pairs of subtrees, or of one list of siblings, that are remembered at once; others are found again.
REMEMBERED = 1_000_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("nav footer aside form script style noscript iframe svg button select textarea template dialog head object canvas audio video map title xmp noembed noframes input label datalist menu".split())
#: Class, id and role words of page furniture.
_FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside widget widgets footer copyright comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations recirculation pagination pager toolbar search searchform skip complementary contentinfo tags taglist".split())
_HEADING = frozenset("header masthead topbar".split())
#: Elements that end when one of the others starts.
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_BOUND = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|<[!?][^>]*>|</?[a-zA-Z][^>]*>", re.S)
#: Depth of the element tree; text in deeper elements hangs on the element of this depth, in page order.
DEEPEST = 150
_ATTR = re.compile(r"\b(class|id|role|itemprop|style|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "names", "inside", "hidden", "slot")

    def __init__(self, tag: str, names: tuple[str, ...] = (), hidden: bool = False) -> None:
        self.tag, self.names, self.hidden, self.inside, self.slot = tag, names, hidden, [], -1


@lru_cache(maxsize=20_000)
def _attributes(text: str) -> tuple[tuple[str, ...], bool]:
    names, hidden = set(), False
    for name, a, b, c in _ATTR.findall(text):
        value, name = (a or b or c).lower(), name.lower()
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value == "true"
        else:
            names.update(_WORDS.findall(value))
    return tuple(sorted(names)), hidden


def parse(html: str | None) -> Node:
    """The element tree of a page; text as it stands, scripts and comments gone."""
    root = Node("html")
    stack = [root]
    html, at, raw = html or "", 0, ""

    def add(text: str) -> None:
        if len(stack) <= DEEPEST:
            stack[-1].inside.append(text)
        else:  # a copy of the element around every text of it
            last = stack[-1]
            chunk = Node(last.tag, last.names, last.hidden)
            chunk.inside.append(text)
            stack[DEEPEST - 1].inside.append(chunk)

    # nothing behind the last > is a tag, but a comment may start there
    tags_end = html.rfind(">") + 1
    comment = html.find("<!--", tags_end)
    html = html[:comment] if comment >= 0 else html
    for m in _TOKEN.finditer(html, 0, tags_end):
        start, end = m.span()
        close, tag = m[1], (m[2] or "").lower()
        if raw:
            if not (close and tag == raw):
                continue
            if raw not in ("script", "style"):
                add(html[at:start])
            raw = ""
        elif start > at:
            add(html[at:start])
        at = end
        if not tag:
            if end == tags_end and m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(html)  # a comment that is never closed
            continue
        if close:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag == "html":
            continue
        if tag in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _BOUND[tag]:
                    break
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
                    break
        names, hidden = _attributes(m[3]) if m[3] else ((), False)
        node = Node(tag, names, hidden)
        if len(stack) <= DEEPEST:
            stack[-1].inside.append(node)
        else:  # what a dropped element holds is dropped with it
            node.hidden |= _furniture(stack[-1], True)
        if tag in _RAW:
            raw = tag
            stack.append(node)
        elif tag not in _VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
    if at < len(html) and raw not in ("script", "style"):
        add(html[at:])
    return root


def _text(parts: list[str]) -> str:
    joined = "".join(parts)
    return " ".join((unescape(joined) if "&" in joined else joined).split())


def skeleton(root: Node) -> tuple[str, list[str]]:
    """Shape of the block tree and the text of each of its slots, in preorder; sets ``slot`` of the nodes."""
    texts: list[list[str]] = []

    def own(node: Node, into: list[str], blocks: list[Node]) -> None:
        for x in node.inside:
            if isinstance(x, str):
                into.append(x)
            elif x.tag in _BLOCK:
                blocks.append(x)
                into.append(" ")
            elif x.tag == "br":
                into.append(" ")
            elif x.tag not in ("script", "style"):
                x.slot = slot_of[-1]
                own(x, into, blocks)

    slot_of = [-1]

    def visit(node: Node) -> str:
        slot = len(texts)
        texts.append([])
        node.slot = slot
        slot_of.append(slot)
        blocks: list[Node] = []
        own(node, texts[slot], blocks)
        shapes, last = [], None
        for b in blocks:
            label = ".".join((b.tag, *b.names))
            leaf = not any(isinstance(x, Node) and x.tag in _BLOCK for x in b.inside)
            if leaf and last == label:
                b.slot = slot_of[-1] = here
                held: list[Node] = []
                own(b, texts[here], held)
                for h in held:  # blocks under inline elements of a repeated leaf stay in its slot
                    h.slot = here
                texts[here].append("\n")
                slot_of[-1] = slot
                continue
            here = len(texts)
            shapes.append(visit(b))
            texts[here].append("\n")
            last = label if leaf else None
        slot_of.pop()
        label = ".".join((node.tag, *node.names))
        return f"{label}({' '.join(shapes)})" if shapes else label

    return visit(root), [_text(t) for t in texts]


@lru_cache(maxsize=4_000)
def _tree(shape: str) -> list[tuple[str, list[int]]]:
    """Label and children of every node of a shape, in preorder."""
    nodes: list[tuple[str, list[int]]] = []
    stack: list[int] = []
    for m in re.finditer(r"[^() ]+|[()]", shape):
        if m[0] == "(":
            stack.append(len(nodes) - 1)
        elif m[0] == ")":
            stack.pop()
        else:
            if stack:
                nodes[stack[-1]][1].append(len(nodes))
            nodes.append((m[0], []))
    return nodes


@lru_cache(maxsize=4_000)
def first_alike(shape: str) -> tuple[int, ...]:
    """For every slot the first one with the same labels from the root down: equal siblings are one kind."""
    nodes, seen, out = _tree(shape), {}, [0] * len(_tree(shape))
    for i, (label, _) in enumerate(nodes[:1]):
        seen[-1, label] = out[i] = i
    for i, (_, children) in enumerate(nodes):
        for c in children:
            out[c] = seen.setdefault((out[i], nodes[c][0]), c)
    return tuple(out)


class _Matcher:
    """Simple tree matching of two shapes, for siblings of any number.

    Equal subtrees are one ``kind``, so a pair of kinds is matched once. A row of
    the table of sibling scores is a few array operations; of the table only
    every ``step``-th row is kept, and the rows between two of them are made again
    on the way back, so siblings need memory by their number times its root.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[str, tuple[int, ...]], int] = {}
        self.labels: list[str] = []
        self.inner: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.worths: dict[tuple[int, int], int] = {}

    def kinds(self, nodes: list[tuple[str, list[int]]]) -> list[int]:
        """The kind of the subtree below every node."""
        out = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            label, inner = nodes[i][0], tuple(out[c] for c in nodes[i][1])
            out[i] = self.known.setdefault((label, inner), len(self.labels))
            if out[i] == len(self.labels):
                self.labels.append(label)
                self.inner.append(inner)
                self.sizes.append(1 + sum(self.sizes[k] for k in inner))
        return out

    def worth(self, u: int, v: int) -> int:
        """Nodes that a matching of two kinds pairs at most; 0 where their labels differ."""
        if u == v:
            return self.sizes[u]
        if self.labels[u] != self.labels[v]:
            return 0
        if not self.inner[u] or not self.inner[v]:
            return 1
        if (u, v) not in self.worths:
            found = 1 + self.siblings(self.inner[u], self.inner[v], False)[0]
            if len(self.worths) >= REMEMBERED:
                self.worths.clear()
            self.worths[u, v] = found
        return self.worths[u, v]

    def siblings(self, left: tuple[int, ...], right: tuple[int, ...], wanted: bool = True) -> tuple[int, list[tuple[int, int]]]:
        """Best score of two lists of siblings and, if wanted, the pairs of places that reach it, last ones first."""
        start = 0  # equal beginnings are always paired
        while start < min(len(left), len(right)) and left[start] == right[start]:
            start += 1
        same = sum(self.sizes[k] for k in left[:start])
        pairs = [(x, x) for x in range(start - 1, -1, -1)] if wanted else []
        left, right = left[start:], right[start:]
        if not left or not right:
            return same, pairs
        others, place = np.unique(np.array(right), return_inverse=True)
        rows: dict[int, np.ndarray] = {}

        def following(before: np.ndarray, u: int) -> np.ndarray:
            if u not in rows:
                if len(rows) * len(others) > REMEMBERED:
                    rows.clear()
                rows[u] = np.array([self.worth(u, int(v)) for v in others], np.int32)
            row = np.zeros_like(before)
            np.maximum.accumulate(np.maximum(before[1:], before[:-1] + rows[u][place]), out=row[1:])
            return row

        step = math.isqrt(len(left)) + 1
        kept, row = [], np.zeros(len(right) + 1, np.int32)
        for x, u in enumerate(left):
            if wanted and x % step == 0:
                kept.append(row)
            row = following(row, u)
        best = same + int(row[-1])
        found, y = [], len(right)
        for strip in range(len(kept) - 1, -1, -1):
            first = strip * step
            table = [kept.pop()]
            for u in left[first : first + step]:
                table.append(following(table[-1], u))
            x = len(table) - 1
            while x and y:
                if table[x][y] == table[x - 1][y]:
                    x -= 1
                elif table[x][y] == table[x][y - 1]:
                    y -= 1
                else:
                    found.append((start + first + x - 1, start + y - 1))
                    x, y = x - 1, y - 1
        return best, found + pairs


@lru_cache(maxsize=20_000)
def align(shape: str, wrapper: str) -> tuple[int, ...]:
    """Simple tree matching: the wrapper's slot for every slot of ``shape``, -1 where none.

    More siblings of a kind than the wrapper has go to the first of that kind.
    """
    a, b = _tree(shape), _tree(wrapper)
    if shape == wrapper:
        return tuple(range(len(a)))
    matcher = _Matcher()
    of_a, of_b = matcher.kinds(a), matcher.kinds(b)
    out = [-1] * len(a)
    work = [(0, 0)] if a[0][0] == b[0][0] else []
    while work:
        i, j = work.pop()
        out[i] = j
        pairs = matcher.siblings(matcher.inner[of_a[i]], matcher.inner[of_b[j]])[1]
        met = {x for x, _ in pairs}
        kinds = {b[v][0]: v for v in reversed(b[j][1])}
        work.extend((a[i][1][x], b[j][1][y]) for x, y in pairs)
        work.extend((u, kinds[a[u][0]]) for x, u in enumerate(a[i][1]) if x not in met and a[u][0] in kinds)
    return tuple(out)


def _furniture(node: Node, in_article: bool) -> bool:
    if node.tag in _DROP or node.hidden or not _FURNITURE.isdisjoint(node.names):
        return True
    return not in_article and (node.tag == "header" or not _HEADING.isdisjoint(node.names))


def _blocks(node: Node, dropped: frozenset[int]) -> list[str]:
    """Texts of the blocks below ``node`` in page order, furniture and template slots left out."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line and (text := _text(line)):
            out.append(text)
        line.clear()

    def walk(n: Node) -> None:
        keep = n.slot not in dropped
        for x in n.inside:
            if isinstance(x, str):
                if keep:
                    line.append(x)
            elif x.tag == "br" or x.tag == "hr":
                end()
            elif not _furniture(x, True):
                block = x.tag in _BLOCK
                if block:
                    end()
                walk(x)
                if block:
                    end()

    walk(node)
    end()
    return out


def _mass(node: Node, in_article: bool = False, in_link: bool = False) -> int:
    """Characters below ``node`` outside furniture and links."""
    total = 0
    for x in node.inside:
        if isinstance(x, str):
            total += 0 if in_link else len(x.strip())
        elif not _furniture(x, in_article):
            total += _mass(x, in_article, in_link or x.tag == "a")
    return total


def _container(root: Node) -> Node:
    """The article, or the smallest element with most of the page's text."""
    articles: list[Node] = []

    def find(n: Node) -> None:
        for x in n.inside:
            if isinstance(x, Node) and not _furniture(x, False):
                if x.tag == "article" or x.tag == "main" or "articlebody" in x.names or "main" in x.names and x.tag in _BLOCK:
                    articles.append(x)
                else:
                    find(x)

    find(root)
    best = max(articles, key=lambda n: _mass(n, True), default=None)
    if best is not None and _mass(best, True):
        inner = [x for x in best.inside if isinstance(x, Node) and x.tag == "article" and not _furniture(x, True)]
        return inner[0] if len(inner) == 1 and best.tag != "article" else best
    node = root
    while True:
        whole = _mass(node)
        inner = [x for x in node.inside if isinstance(x, Node) and x.tag in _BLOCK and x.tag not in ("p", "li", "td", "th", "tr", "tbody", "dd", "dt") and not _furniture(x, False)]
        best = max(inner, key=_mass, default=None)
        if best is None or _mass(best) < 0.8 * whole or not whole:
            return node
        node = best


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(html: str | None, wrapper: str | None = None, constants: frozenset[tuple[int, int]] = frozenset()) -> str:
    """Main text of one page, given its host's wrapper and constant (slot, text hash) pairs."""
    root = parse(html)
    dropped: frozenset[int] = frozenset()
    if wrapper and constants:
        shape, texts = skeleton(root)
        to = _kinds(shape, wrapper)
        dropped = frozenset(s for s, t in enumerate(texts) if t and to[s] >= 0 and (to[s], _hash(t)) in constants)
    home = _container(root)
    found = _blocks(home, dropped)
    # a page that is template throughout still says what it says
    return "\n".join(found or (_blocks(home, frozenset()) if dropped else []))


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), url, F.lit("")))


def _kinds(shape: str, wrapper: str) -> list[int]:
    """The wrapper's kind of slot for every slot of ``shape``, -1 where none."""
    alike = first_alike(wrapper)
    return [alike[t] if t >= 0 else -1 for t in align(shape, wrapper)]


def slot_counts(pages: DataFrame) -> DataFrame:
    """``host, shape, slot, text_hash, n``: pages of each slot text; slot -1 counts the pages."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str, int, int]] = Counter()
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shape, texts = skeleton(parse(html))
                seen[host, shape, -1, 0] += 1
                alike = first_alike(shape)  # a text counts once a page, however often its kind of slot holds it
                seen.update({(host, shape, alike[s], _hash(t)) for s, t in enumerate(texts) if t})
            keys = list(zip(*seen)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(keys[2], pa.int32()), pa.array(keys[3], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["host", "shape", "slot", "text_hash", "n"])

    made = pages.select("host", "html").mapInArrow(count, "host string, shape string, slot int, text_hash long, n long")
    return made.groupBy("host", "shape", "slot", "text_hash").agg(F.sum("n").alias("n"))


def induce(pages: DataFrame) -> DataFrame:
    """``host, wrapper, n_pages, constants``: one wrapper per host; constants are (slot, text_hash)."""
    counts = cut(slot_counts(pages), "slot-counts")
    shapes = counts.where("slot = -1").select("host", "shape", "n")
    hosts = shapes.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape")).alias("wrapper"), F.sum("n").alias("n_pages"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [_kinds(s, w) for s, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to, pa.list_(pa.int32()))], names=["host", "shape", "to"])

    ways = shapes.join(hosts, "host").select("host", "shape", "wrapper").mapInArrow(aligned, "host string, shape string, to array<int>")
    # only texts that many pages of one host share can become constant
    placed = counts.where("slot >= 0").join(ways, ["host", "shape"]).select("host", F.get("to", F.col("slot")).alias("slot"), "text_hash", "n").where("slot >= 0")
    shared = placed.groupBy("host", "slot", "text_hash").agg(F.sum("n").alias("n")).join(hosts.select("host", "n_pages"), "host")
    fixed = shared.where((F.col("n_pages") >= FEWEST_PAGES) & (F.col("n") >= CONSTANT * F.col("n_pages")))
    listed = fixed.groupBy("host").agg(F.collect_list(F.struct("slot", "text_hash")).alias("constants"))  # at most one text per slot
    return hosts.join(listed, "host", "left")


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row ``page_id, url, text``."""
    ship(pages.sparkSession)
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), _host(F.col(url)).alias("host"), F.col(html).alias("html"))
    wrappers = cut(induce(own), "wrappers").select(F.col("host").alias("at"), "wrapper", "constants")
    if wrappers.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = own.join(F.broadcast(wrappers), F.col("host") == F.col("at"), "left")
    else:
        salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
        copies = wrappers.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, (F.col("host") == F.col("at")) & (F.col("salt") == F.col("other")), "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, wrapper, constants in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                out.append(extract(body, wrapper, frozenset((c["slot"], c["text_hash"]) for c in constants or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kind = own.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "wrapper", "constants").mapInArrow(texts, f"page_id {kind}, url string, text string")
