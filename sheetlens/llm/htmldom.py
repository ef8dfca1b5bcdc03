"""A small tolerant HTML reader for the page operator: blocks of text under a tree of
block elements, and the tree's folded outline."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

DEPTH = 200           # levels of nesting that are told apart; the text of a deeper element is its ancestor's, if no noise
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg textarea select title head canvas audio video "
                "annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr output meter progress "
                   "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle mpadded mphantom menclose mfenced msub msup "
                   "msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
#: A start tag of the key closes an open element of the value, up to the nearest list or table.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
          "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section main body div aside nav header footer form".split())

NOISE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words of class or id names that mark what is no article text.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar "
    "comment comments reply replies respond discussion disqus notice notices cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe signup login menu navbar nav navigation breadcrumb breadcrumbs pagination pager "
    "toolbar masthead topbar header footer share sharing social related recommended recommendations copyright "
    "legal disclaimer tracking alert announcement".split())
HEADER = frozenset(("header", "masthead"))
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@lru_cache(None)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def noise_names(names: list[str], tag: str, inside_main: bool) -> bool:
    """Whether class names (``.name``) or ids (``#name``) mark what is no article text.  A header inside the article
    is part of it, and so is a heading whatever its names; an id there, often made of a heading's words, counts only
    if all its words are marks."""
    if inside_main and tag in HEADINGS:
        return False
    marks = NOISE_WORDS - HEADER if inside_main else NOISE_WORDS
    for name in names:
        words = {p.lower() for p in _PART.findall(name)}
        if words and (words <= marks if inside_main and name[0] == "#" else not words.isdisjoint(marks)):
            return True
    return False


class Node:
    __slots__ = ("tag", "label", "noise", "children", "text", "index", "kids", "sig")

    def __init__(self, tag: str, label: str, noise: bool):
        self.tag, self.label, self.noise = tag, label, noise
        self.children: list[Node] = []


def _node(tag: str, attrs: str, inside_main: bool) -> Node:
    label, names, role, hidden = tag, [], "", False
    if attrs and attrs != "/":
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                role = value.strip().lower()
            elif key == "hidden":
                hidden = True
            elif key == "aria-hidden":
                hidden |= value.strip().lower() == "true"
            else:
                names += [("." if key == "class" else "#") + re.sub(r"[\d()|,]+", "", w) for w in value.split()]
    if role == "main":
        tag = "main"
    noise = hidden or tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not inside_main)
    if names and not noise and tag not in ("html", "body", *MAIN):
        noise = noise_names(names, tag, inside_main)
    if names:
        label += "".join(sorted(set(names)))
    if tag == "main" and label[:4] != "main":
        label = "main~" + label
    return Node(tag, label, noise)


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree, and its blocks of text in page order: (element, text with references decoded and white space
    as single blanks)."""
    root = Node("#root", "#root", False)
    stack, mains = [root], 0
    open_: Counter[str] = Counter()
    into: list[Node | None] = [root]  # for each open element that of the tree which has its text
    blocks: list[tuple[Node, str]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text and into[-1] is not None:
                blocks.append((into[-1], text))
            held.clear()

    def close_to(k: int) -> None:
        nonlocal mains
        flush()
        while len(stack) > k:
            node = stack.pop()
            into.pop()
            open_[node.tag] -= 1
            mains -= node.tag in MAIN

    pos, end = 0, len(html)
    while pos < end:
        m = _TOKEN.match(html, pos)
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                held.append(unescape(piece) if "&" in piece else piece)
            continue
        tag = name.lower()
        closing, attrs = (m[1], m[3]) if m[2] else (m[4], m[6])
        if closing:
            if tag in INLINE and not open_[tag]:
                continue
            if tag == "br":
                held.append(" ")
                continue
            for k in range(len(stack) - 1 if open_[tag] else 0, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in RAW and not (tag == "head" or attrs.endswith("/")):
            close = _closing(tag).search(html, pos)
            flush()
            pos = close.end() if close else end
            continue
        if tag == "head":
            close = re.compile(r"</head\s*>|<body\b", re.I).search(html, pos)
            pos = (close.end() if close[0][1] == "/" else close.start()) if close else pos
            continue
        if tag in VOID:
            if tag not in ("img", "wbr", "input"):
                flush()
            continue
        if tag in INLINE:
            if not attrs or ("class" not in attrs and "id" not in attrs and "hidden" not in attrs):
                continue
            node = _node(tag, attrs, mains > 0)
            if not node.noise:
                continue
        else:
            node = None
            if tag in CLOSES:
                for k in range(len(stack) - 1 if any(open_[t] for t in CLOSES[tag]) else 0, 0, -1):
                    if stack[k].tag in CLOSES[tag]:
                        close_to(k)
                        if tag in ("li", "option", "dt", "dd", "td", "th"):
                            break
                    elif stack[k].tag in SCOPE:
                        break
            else:  # a block closes an open paragraph
                for k in range(len(stack) - 1 if open_["p"] else 0, 0, -1):
                    if stack[k].tag == "p":
                        close_to(k)
                        break
                    if stack[k].tag in SCOPE:
                        break
            node = _node(tag, attrs, mains > 0)
        flush()
        if tag in ("html", "body") and open_[tag]:
            continue
        if len(stack) > DEPTH:
            into.append(None if node.noise else into[-1])
        else:
            stack[-1].children.append(node)
            into.append(node)
        stack.append(node)
        open_[node.tag] += 1
        mains += node.tag in MAIN
    close_to(1)
    return root, blocks


def outline(root: Node) -> tuple[str, list[Node]]:
    """The folded outline: siblings alike in label and outline become one.  Gives its text and its nodes in
    preorder; every element of the tree gets ``index``, the number of the outline node it is folded into."""
    order = [root]
    for n in order:
        order.extend(n.children)
    for n in reversed(order):
        kids: dict[str, list[Node]] = {}
        for c in n.children:
            kids.setdefault(c.sig, []).append(c)
        n.kids = kids
        n.sig = n.label + ("(" + ",".join(kids) + ")" if kids else "")
    nodes: list[Node] = []
    work = [[root]]
    while work:
        group = work.pop()
        for n in group:
            n.index = len(nodes)
        nodes.append(group[0])
        merged = [[c for n in group for c in n.kids[s]] for s in group[0].kids]
        work.extend(reversed(merged))
    return root.sig, nodes
