"""Token streams of web pages: nested elements with their blocks of text.

A stream keeps block elements and runs of text; inline elements belong to the run around them. Markup
that authors leave open is closed where the next element ends it, as browsers do.
"""

from __future__ import annotations

import html
import re

# --- fixed values: element names of HTML, by how a page's text reads them ---
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var".split())
#: Elements that hold no part of an article.
OUTSIDE = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form header head menu nav noscript object "
    "optgroup option select svg template video".split())
OUTSIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "status toolbar".split())
#: Words of class and id names that mark such parts ...
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs consent cookie cookies "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promotion related share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget".split())
#: ... and the parts that readers write.
READERS_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
#: A new one of these ends an open one of these (within the elements that bound the search).
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = "#"


class Node:
    """An element, or with tag TEXT a run of text. ``key`` names it in wrappers."""

    __slots__ = ("name", "tag", "key", "parent", "outside", "children", "parts", "linked", "items")

    def __init__(self, name: str, parent: Node | None):
        self.name = self.tag = self.key = name
        self.parent = parent
        self.outside = ""  # why it is no part of an article: tag, class, readers
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.linked = 0  # characters within links
        if parent is not None:
            parent.children.append(self)

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def element(name: str, rest: str, parent: Node) -> Node:
    """A new element; its key is the tag with the first word of its class or id."""
    node, first = Node(name, parent), ""
    if name in OUTSIDE:
        node.outside = "tag"
    if rest and not rest.isspace():
        for attribute, *values in ATTRIBUTE.findall(rest):
            words = [w.lower() for w in WORD.findall(html.unescape("".join(values)))]
            if attribute.lower() == "role":
                if "main" in words:
                    node.tag = node.key = "main"
                elif not OUTSIDE_ROLES.isdisjoint(words):
                    node.outside = "tag"
                continue
            if not READERS_WORDS.isdisjoint(words):
                node.outside = "readers"
            elif not OUTSIDE_WORDS.isdisjoint(words):
                node.outside = node.outside or "class"
            first = first or (words[0] if words else "")
    if first:
        node.key = f"{node.tag}.{first}"
    return node


def parse(page: str) -> list[Node]:
    """The nodes of a page in order, the root of its body first; any depth."""
    root = Node("", None)
    nodes, here, run, links = [root], root, None, 0
    at, end = 0, len(page)

    def say(text: str) -> None:
        nonlocal run, here
        if run is None:
            if text.isspace():
                return
            if here.name == "head":
                here = here.parent
            run = Node(TEXT, here)
            nodes.append(run)
        run.parts.append(text)
        if links:
            run.linked += len(text)

    while at < end:
        start = page.find("<", at)
        if start != at:
            say(page[at:start if start > 0 else end])
            if start < 0:
                break
        token = TOKEN.match(page, start)
        if token is None:
            say("<")
            at = start + 1
            continue
        at = token.end()
        name = token["name"]
        if name is None:  # a comment or declaration
            continue
        name = name.lower()
        if token["end"]:
            if name in INLINE:
                links = max(0, links - (name == "a"))
            elif name not in RAW:
                run, links, node = None, 0, here
                while node is not root and node.name != name:
                    node = node.parent
                if node is not root:
                    here = node.parent
        elif name in RAW:
            close = RAW_END[name].search(page, at)
            at = close.end() if close else end
            at = page.find(">", at) + 1 or end
        elif name == "br":
            say("\n")
        elif name in INLINE:
            links += name == "a"
        elif name in VOID:
            run = None if name == "hr" else run
        else:
            run, links = None, 0
            here = implied(name, here)
            if name not in ("html", "body"):
                here = element(name, token["rest"], here)
                nodes.append(here)
    return nodes


def implied(name: str, node: Node) -> Node:
    """Where a new block element belongs, after the open elements that it ends."""
    while node.name == "p" or node.name == "head" and name not in ("noscript", "template") or (
            name in HEADINGS and node.name in HEADINGS):
        node = node.parent
    if name in ENDS:
        ended, bounds = ENDS[name]
        up = node
        while up.parent is not None and up.name not in bounds:
            if up.name in ended:
                node = up.parent
            up = up.parent
    return node


def article_nodes(nodes: list[Node], deepest: int = 64) -> list[Node]:
    """Text runs that may be part of an article, in page order, in a tree cut down to them.

    Parts outside of articles and elements without text leave the tree; an element deeper than
    ``deepest`` gives its runs to the one that deep. Names in classes don't count against an element
    that holds the article itself, nor a heading's frame within it.
    """
    main, one, paragraphs = ({} for _ in range(3))
    for node in reversed(nodes):  # children before parents
        up = node.parent
        if up is not None:
            own = node.tag in ("main", "article") and node.outside != "readers"
            main[up] = main.get(up) or main.get(node) or (own and node.tag)
            if node.tag == "main":
                main[up] = "main"
            one[up] = one.get(up, False) or one.get(node, False) or node.tag == "h1"
            paragraphs[up] = paragraphs.get(up, 0) + paragraphs.get(node, 0) + (node.tag == "p")
    depth, gone, inside, kept = {nodes[0]: 0}, set(), set(), []
    for node in nodes[1:]:
        up = node.parent
        if up in inside or node.tag in ("main", "article"):
            inside.add(node)
        outside = node.outside
        if outside == "readers":
            outside = main.get(node) != "main" and not one.get(node)
        elif outside and (outside == "class" or node.name in ("form", "header")):
            heading = "header" in (node.name, node.key.partition(".")[2]) and up in inside
            outside = not (main.get(node) or one.get(node) and paragraphs.get(node, 0) > 1 or heading)
        if up in gone or outside:
            gone.add(node)
            continue
        depth[node] = depth[up] + 1
        while depth[up] >= deepest:
            up = up.parent
        if up is not node.parent:
            node.parent, depth[node] = up, depth[up] + 1
        if node.name == TEXT:
            kept.append(node)
    for node in nodes:
        node.children = []
    placed = {nodes[0]}
    for node in kept:
        line = []
        while node not in placed:
            placed.add(node)
            line.append(node)
            node = node.parent
        for node in line:
            node.parent.children.append(node)
    return kept
