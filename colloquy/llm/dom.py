"""A small tolerant HTML tree: what wrapper induction needs and no more."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that do not break a line; all others, and br, do.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
#: An open p ends where one of these begins.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Opening one of the first ends an open one of the second, up to the third.
ENDS_PEER = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "optgroup")),
}
BLOCK_ENDS = frozenset("article section div main body header footer aside nav table td th li blockquote form".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_KEPT_ATTRS = ("class", "id", "role", "hidden", "aria-hidden", "style")


class Node:
    """An element, or, with the tag "#", a block of text with its break before."""

    __slots__ = ("tag", "attrs", "children", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.children, self.text = tag, attrs or {}, [], text


def parse(source: str | None) -> Node:
    """The tree of a page. Unclosed, stray and misplaced tags are put right as browsers do, roughly."""
    root = Node("html")
    stack = [root]
    source = source or ""
    at, end = 0, len(source)

    def close(tags, until=()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    def put_text(raw: str):
        if raw:
            stack[-1].children.append(Node("#", text=html.unescape(raw)))

    while at < end:
        found = _TOKEN.search(source, at)
        if not found:
            put_text(source[at:])
            break
        put_text(source[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in VOID:
                close((tag,), BLOCK_ENDS if tag in INLINE or tag == "p" else ())
            continue
        attrs = {}
        if found["attrs"].strip(" \t\n\r\f/"):
            for name, a, b, c in _ATTR.findall(found["attrs"]):
                name = name.lower()
                if name in _KEPT_ATTRS:
                    attrs.setdefault(name, html.unescape(a or b or c))
        if tag == "html":
            root.attrs.update(attrs)
            continue
        if tag in ENDS_P:
            close(("p",), BLOCK_ENDS)
        if tag in ENDS_PEER:
            close(*ENDS_PEER[tag])
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
            node.text = source[at : stop.start() if stop else end]
            at = stop.end() if stop else end
        elif tag not in VOID:
            stack.append(node)
    return root
