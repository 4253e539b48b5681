"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page's DOM tree is reduced to its
skeleton, in which equal siblings are one repeated node; the most frequent
skeleton of a host is its reference. All skeletons of the host are
aligned with it by simple tree matching, so that every page votes, for each
slot of the reference, which texts stand there. A text that nearly all pages
with the slot have is constant: template. What varies is content. Pages with
the same text are one page and vote once. What an
element says of itself (a menu, a footer, an advert, a comment) holds besides,
also on hosts with too few pages to compare.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import prepare
from colloquy.llm.dom import INLINE, Node, parse
from colloquy.session import settle

#: A text is constant if at least this share of the pages with its slot have it ...
CONSTANT_SHARE = 0.9
#: ... and at least so many different pages of the host have the slot.
LEAST_PAGES = 8

NEVER_TEXT = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video select option button "
    "input textarea datalist title noembed noframes xmp plaintext meta link".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search".split())
CONTAINERS = frozenset(("article", "main"))
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog status".split()
)
#: Whole words of class and id that name what is not the article.
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr "
    "notice newsletter subscribe signup login share sharing social related recommended comment comments reply "
    "replies disqus popup modal overlay toolbar widget pagination pager skip copyright disclaimer".split()
)
_WORD = re.compile(r"[a-z]+")


def is_boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element says that it is no part of the article; ``inside`` an article or main."""
    if node.tag in BOILERPLATE_TAGS or (node.tag == "header" and not inside):
        return True
    attrs = node.attrs
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    if node.tag in ("body", "html", "main"):
        return False
    names = _WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    if any(n in BOILERPLATE_NAMES for n in names):
        return True
    return "header" in names and not inside


class Page:
    """A parsed page: text blocks with the skeleton node each stands at."""

    def __init__(self, source: str | None):
        self.labels: list[str] = []  # of skeleton nodes, in preorder
        self.parents: list[int] = []
        self.blocks: list[list] = []  # [node, text, inside a container, boilerplate]
        self._open = False
        self._walk(parse(source), -1, {}, False, False)
        for block in self.blocks:
            block[1] = " ".join("".join(block[1]).split())
        self.blocks = [b for b in self.blocks if b[1]]

    def _node(self, label: str, parent: int, known: dict) -> int:
        """The skeleton node for a child; one for all equal children of a parent."""
        if (parent, label) not in known:
            self.labels.append(label)
            self.parents.append(parent)
            known[parent, label] = len(self.labels) - 1
        return known[parent, label]

    def _walk(self, top: Node, parent: int, known: dict, inside: bool, boilerplate: bool) -> None:
        stack = [(top, parent, inside, boilerplate, False)]
        while stack:
            element, parent, inside, boilerplate, leaving = stack.pop()
            if leaving:
                self._open = False
                continue
            if element.tag == "#":
                if not self._open or not self.blocks or self.blocks[-1][0] != parent:
                    self.blocks.append([parent, [], inside, boilerplate])
                    self._open = True
                self.blocks[-1][1].append(element.text)
                continue
            if element.tag in ("br", "hr"):
                if self._open:
                    self.blocks[-1][1].append(" ")
                self._open = self._open and element.tag == "br"
                continue
            if element.tag in NEVER_TEXT:
                continue
            off = boilerplate or is_boilerplate(element, inside)
            if element.tag in INLINE and off == boilerplate:
                stack += [(c, parent, inside, off, False) for c in reversed(element.children)]
                continue
            self._open = False
            kind = element.attrs.get("class", "")
            node = self._node(f"{element.tag}.{kind}" if kind else element.tag, parent, known)
            inside = inside or element.tag in CONTAINERS or element.attrs.get("role", "").lower() in CONTAINERS
            stack.append((element, parent, inside, off, True))
            stack += [(c, node, inside, off, False) for c in reversed(element.children)]

    def skeleton(self) -> str:
        return json.dumps([self.labels, self.parents], separators=(",", ":"))

    def text(self, constant: set[tuple[int, int]]) -> str:
        """The blocks that are content, one to a line."""
        own = [b for b in self.blocks if not b[3] and (b[0], text_hash(b[1])) not in constant]
        within = [b for b in own if b[2]]
        return "\n".join(b[1] for b in within or own)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; null and odd URLs have the empty host."""
    found = re.match(r"[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.IGNORECASE)
    return found[1].lower() if found else ""


@lru_cache(maxsize=4096)
def match_trees(reference: str, other: str) -> dict[int, int]:
    """Node of ``other`` -> node of ``reference`` in the largest simple tree matching."""
    labels_a, parents_a = json.loads(reference)
    if reference == other:
        return {k: k for k in range(len(labels_a))}
    labels_b, parents_b = json.loads(other)
    kids_a: list[list[int]] = [[] for _ in labels_a]
    kids_b: list[list[int]] = [[] for _ in labels_b]
    for kids, parents in ((kids_a, parents_a), (kids_b, parents_b)):
        for k, p in enumerate(parents):
            if p >= 0:
                kids[p].append(k)
    depth_a, depth_b = ([0] * len(labels_a)), ([0] * len(labels_b))
    for depth, parents in ((depth_a, parents_a), (depth_b, parents_b)):
        for k, p in enumerate(parents):
            depth[k] = depth[p] + 1 if p >= 0 else 0
    size: dict[tuple[int, int], int] = {}

    def table(x: int, y: int) -> list[list[int]]:
        a, b = kids_a[x], kids_b[y]
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, u in enumerate(a, 1):
            for j, v in enumerate(b, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + size.get((u, v), 0))
        return m

    by_depth: dict[tuple[int, str], tuple[list[int], list[int]]] = {}
    for which, labels, depth in ((0, labels_a, depth_a), (1, labels_b, depth_b)):
        for k, label in enumerate(labels):
            by_depth.setdefault((depth[k], label), ([], []))[which].append(k)
    for (_, _), (a, b) in sorted(by_depth.items(), key=lambda x: -x[0][0]):  # the deepest first
        for x in a:
            for y in b:
                size[x, y] = 1 + table(x, y)[-1][-1]
    out: dict[int, int] = {}
    todo = [(0, 0)] if labels_a and labels_b and labels_a[0] == labels_b[0] else []
    while todo:
        x, y = todo.pop()
        out[y] = x
        m = table(x, y)
        i, j = len(kids_a[x]), len(kids_b[y])
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((kids_a[x][i], kids_b[y][j]))
    return out


def _votes(pages: DataFrame) -> DataFrame:
    """(host, skeleton, node, block, n): on how many different pages a node has a text; block null counts the node.

    Pages of a host whose whole text is the same are one page, whatever stands
    around it; the least of them votes.
    """

    def read(batches):
        for batch in batches:
            least: dict[tuple, tuple] = {}
            for url, source in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
                page = Page(source)
                # (node, whether it is a text, the text's hash)
                keys = {(b[0], False, 0) for b in page.blocks}
                keys |= {(b[0], True, text_hash(b[1])) for b in page.blocks if not b[3]}
                vote = (page.skeleton(), sorted(keys))
                key = (host_of(url), text_hash(page.text(set())))
                if key not in least or vote < least[key]:
                    least[key] = vote
            rows = [
                (host, text, skeleton, [{"node": n, "own": o, "block": h} for n, o, h in keys])
                for (host, text), (skeleton, keys) in least.items()
            ]
            columns = list(zip(*rows)) or [()] * 4
            key_kind = pa.struct([("node", pa.int32()), ("own", pa.bool_()), ("block", pa.int64())])
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(key_kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "page", "skeleton", "keys"]
            )

    shape = "host string, page long, skeleton string, keys array<struct<node:int,own:boolean,block:long>>"
    different = (
        pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
        .mapInArrow(read, shape)
        .groupBy("host", "page")
        .agg(F.min(F.struct("skeleton", "keys")).alias("vote"))
        .select("host", "vote.skeleton", "vote.keys")
    )
    page = F.struct(F.lit(-1).alias("node"), F.lit(False).alias("own"), F.lit(0).cast("long").alias("block"))
    return (
        different.select("host", "skeleton", F.explode(F.concat(F.array(page), "keys")).alias("k"))
        .groupBy("host", "skeleton", "k")
        .agg(F.count("*").alias("n"))
        .select("host", "skeleton", "k.node", F.when(F.col("k.own"), F.col("k.block")).alias("block"), "n")
    )


def induce(pages: DataFrame) -> DataFrame:
    """(host, reference, constant): each host's reference skeleton and the [slot, block] that are template."""
    votes = settle(_votes(pages), "votes")
    references = votes.filter("node = -1").groupBy("host").agg(F.max(F.struct("n", "skeleton")).alias("r"))
    skeletons = votes.filter("node = -1").select("host", "skeleton").join(
        references.select("host", F.col("r.skeleton").alias("reference")), "host"
    )

    def align(batches):
        for batch in batches:
            rows = [
                (host, skeleton, mine, theirs)
                for host, skeleton, reference in zip(*(batch[n].to_pylist() for n in ("host", "skeleton", "reference")))
                for mine, theirs in match_trees(reference, skeleton).items()
            ]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "skeleton", "node", "slot"]
            )

    aligned = skeletons.mapInArrow(align, "host string, skeleton string, node int, slot int")
    by_slot = votes.join(aligned, ["host", "skeleton", "node"]).groupBy("host", "slot", "block").agg(F.sum("n").alias("n"))
    slots = settle(by_slot, "slots")
    constant = (
        slots.filter("block is not null")
        .join(slots.filter("block is null").select("host", "slot", F.col("n").alias("pages")), ["host", "slot"])
        .filter((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= F.col("pages") * CONSTANT_SHARE))
        .groupBy("host")
        .agg(F.collect_list(F.struct("slot", "block")).alias("constant"))  # at most one page's blocks
    )
    return references.select("host", F.col("r.skeleton").alias("reference")).join(constant, "host").select(
        "host", "reference", F.to_json("constant").alias("constant")
    )


@lru_cache(maxsize=256)
def _constants(constant: str) -> frozenset[tuple[int, int]]:
    return frozenset((c["slot"], c["block"]) for c in json.loads(constant))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty html has the empty text. Null URLs are one host. Repeated
    rows are returned each, and vote once. Extra columns are ignored. An empty
    table gives no rows. Pages without an article or main element are read as
    a whole.
    """
    prepare(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    wrappers = settle(induce(own), "wrappers")  # of known size: small, it is broadcast
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    joined = own.withColumn("host", host).join(wrappers, "host", "left").drop("host")

    def read(batches):
        for batch in batches:
            texts = []
            for source, reference, constant in zip(*(batch[n].to_pylist() for n in ("html", "reference", "constant"))):
                page = Page(source)
                known: set[tuple[int, int]] = set()
                if constant:
                    slots = match_trees(reference, page.skeleton())
                    template = _constants(constant)
                    known = {
                        (b[0], h)
                        for b in page.blocks
                        if b[0] in slots and (slots[b[0]], h := text_hash(b[1])) in template
                    }
                texts.append(page.text(known))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
