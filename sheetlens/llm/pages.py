"""Main text of pages by wrapper induction.

Pages of one host come from few templates.  The outline of a page is its tree of block
elements with siblings alike folded into one.  Over all pages of a host, every outline
node gets counts that add up: pages, text length, and the least and greatest hash of its
text, which are equal only if the text is the same on every page.  The outlines of a
host are aligned by simple tree matching (the largest order-keeping match of two trees
whose matched nodes have equal labels and matched parents) and merged into the host's
wrapper.  Constant nodes are template, varying slots are content: the content is the
smallest part of the wrapper that holds most of the varying text outside menus, adverts
and the like, and a page's text is what it has in the slots of that part.

Counts leave a task as one row for each outline, so a host with a third of all pages
crosses the shuffle as few rows; outlines are merged in groups of at most ``GROUP``, the
results again, until one wrapper a host is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.common import bytes_of, own_names, slices, written
from sheetlens.llm.htmldom import HEADINGS, MAIN, NOISE_TAGS, noise_names, outline, parse

GROUP = 400
_NAME = re.compile(r"[.#][^.#]*")
CONSTANT = 5          # pages on which a text must stand to be taken for template


class Tree:
    """An outline node with counts: pages, text length, least and greatest hash."""

    __slots__ = ("label", "kids", "pages", "length", "low", "high", "index", "mass", "noise", "fixed", "tag")

    def __init__(self, label: str):
        self.label, self.kids = label, []
        self.pages = self.length = 0
        self.low, self.high = (1 << 63) - 1, -(1 << 63)
        self.tag = "main" if label.startswith("main~") else label.split(".")[0].split("#")[0] if label != "#root" else "#root"

    def add(self, other: "Tree") -> None:
        self.pages += other.pages
        self.length += other.length
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)


def read_outline(text: str) -> tuple[Tree, list[Tree]]:
    """The tree of an outline's text and its nodes in preorder."""
    nodes: list[Tree] = []
    stack: list[Tree] = []
    at, n = 0, len(text)
    while at < n:
        end = at
        while end < n and text[end] not in "(),":
            end += 1
        if end > at:
            node = Tree(text[at:end])
            node.index = len(nodes)
            nodes.append(node)
            if stack:
                stack[-1].kids.append(node)
        if end < n and text[end] == "(":
            stack.append(nodes[-1])
        elif end < n and text[end] == ")":
            stack.pop()
        at = end + 1
    return nodes[0], nodes


def write_outline(root: Tree) -> tuple[str, list[Tree]]:
    nodes: list[Tree] = []

    def walk(t: Tree) -> str:
        nodes.append(t)
        return t.label + ("(" + ",".join(walk(k) for k in t.kids) + ")" if t.kids else "")

    return walk(root), nodes


def simple_tree_matching(a: Tree, b: Tree, memo: dict) -> tuple[int, list[tuple[Tree, Tree]]]:
    """Size of the largest match of two trees, and the matched children of the roots."""
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    if a.label != b.label:
        memo[key] = (0, [])
        return memo[key]
    n, m = len(a.kids), len(b.kids)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            w = simple_tree_matching(a.kids[i], b.kids[j], memo)[0] if a.kids[i].label == b.kids[j].label else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
    pairs, i, j = [], n, m
    while i and j:
        w = memo.get((id(a.kids[i - 1]), id(b.kids[j - 1])), (0,))[0]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            pairs.append((a.kids[i - 1], b.kids[j - 1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    memo[key] = (best[n][m] + 1, pairs[::-1])
    return memo[key]


def align(a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
    """Matched nodes of two outlines."""
    memo: dict = {}
    if not simple_tree_matching(a, b, memo)[0]:
        return []
    out, work = [], [(a, b)]
    while work:
        x, y = work.pop()
        out.append((x, y))
        work += memo[id(x), id(y)][1]
    return out


def merge(wrapper: Tree, page: Tree) -> None:
    """Adds an outline to a wrapper: counts of matched nodes, and unmatched nodes beside their left neighbour."""
    memo: dict = {}
    simple_tree_matching(wrapper, page, memo)
    work = [(wrapper, page)]
    while work:
        w, p = work.pop()
        w.add(p)
        pairs = memo[id(w), id(p)][1]
        to = {id(y): x for x, y in pairs}
        at = 0
        for k in p.kids:
            if id(k) in to:
                at = next(i for i, x in enumerate(w.kids) if x is to[id(k)]) + 1
            else:
                w.kids.insert(at, k)
                at += 1
        work += pairs


def _noisy(label: str, tag: str, in_main: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not in_main):
        return True
    names = _NAME.findall(label[len(tag):]) if label.startswith(tag) else []
    return tag not in ("html", "body", *MAIN) and noise_names(names, tag, in_main)


def slots(root: Tree) -> tuple[Tree, bool]:
    """The part of a wrapper that is content, and whether the page itself marks it as such."""

    def weigh(t: Tree, noise: bool, in_main: bool, all_: bool) -> int:
        t.noise = noise or _noisy(t.label, t.tag, in_main)
        t.fixed = not all_ and t.pages >= CONSTANT and t.low == t.high
        t.mass = 0 if t.noise or t.fixed else t.length
        t.mass += sum(weigh(k, t.noise, in_main or t.tag in MAIN, all_) for k in t.kids)
        return t.mass

    if not weigh(root, False, False, False):
        weigh(root, False, False, True)  # nothing varies (copies of one page): no evidence of a template
    marked, work = [], [root]
    while work:
        t = work.pop()
        if t.tag in MAIN and not t.noise:
            marked.append(t)
        work += t.kids
    best = max((t for t in marked if t.tag == "article"), key=lambda t: t.mass, default=None)
    main = max((t for t in marked if t.tag == "main"), key=lambda t: t.mass, default=None)
    if main is not None and main.mass and (best is None or best.mass < 0.5 * main.mass):
        return main, True
    if best is not None and best.mass >= 0.3 * root.mass:
        return best, True
    t = root
    while True:
        k = max(t.kids, key=lambda x: x.mass, default=None)
        if k is None or k.mass < 0.75 * t.mass or not k.kids or not k.mass:
            return t, False
        t = k


def content_nodes(page: Tree, nodes: list[Tree], wrapper: Tree) -> list[int]:
    """Outline nodes of a page that are content by its host's wrapper."""
    part, marked = slots(wrapper)
    inside, work = set(), [(part, part, False)]
    while work:
        t, above, in_block = work.pop()
        # a part marked as content has template too: what stands on every page of it, but for headings of varying
        # text and parts of a varying block
        kept = marked and (t.pages < part.pages or in_block or (t.tag in HEADINGS and above.mass > 0))
        if not t.noise and (kept or not t.fixed):
            inside.add(id(t))
        in_block = in_block or (t is not part and t.tag not in MAIN and t.length > 0 and not t.fixed)
        work += [(k, t, in_block) for k in t.kids if not k.noise]
    of = {id(p): w for w, p in align(wrapper, page)}
    keep = [p.index for p in nodes if id(p) in of and id(of[id(p)]) in inside]
    if not keep and wrapper is not page:
        return content_nodes(page, nodes, page)
    return keep


def _host(url: str | None) -> str:
    rest = (url or "").split("://", 1)[-1]
    for c in "/?#":
        rest = rest.split(c, 1)[0]
    return rest.rsplit("@", 1)[-1].split(":", 1)[0].lower()


def _outlines(df: DataFrame, url: str, html: str) -> DataFrame:
    """(host, outline, pages, length[], low[], high[]): a task's pages of one outline as one row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            kinds = (pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                              names=["host", "outline", "pages", "length", "low", "high"])

        for b in slices(batches, 128):
            for u, v in zip(b.column(0).to_pylist(), bytes_of(b.column(1))):
                root, blocks = parse(bytes(v).decode("utf-8", "replace") if v is not None else "")
                text, nodes = outline(root)
                own: list[list[str]] = [[] for _ in nodes]
                for node, t in blocks:
                    own[node.index].append(t)
                h = [xxhash.xxh3_64_intdigest("\n".join(o).encode()) - (1 << 63) for o in own]
                size = [sum(map(len, o)) for o in own]
                row = held.get((_host(u), text))
                if row is None:
                    held[_host(u), text] = [1, size, h, h]
                else:
                    row[0] += 1
                    row[1] = [x + y for x, y in zip(row[1], size)]
                    row[2] = [min(x, y) for x, y in zip(row[2], h)]
                    row[3] = [max(x, y) for x, y in zip(row[3], h)]
            if len(held) > 10_000:
                yield out()
        yield out()

    rows = df.select(url, html).mapInArrow(
        scan, "host string, outline string, pages long, length array<long>, low array<long>, high array<long>")
    per = (rows.select("host", "outline", "pages", F.posexplode(F.arrays_zip("length", "low", "high")).alias("k", "x"))
               .groupBy("host", "outline", "k").agg(F.sum("pages").alias("pages"), F.sum("x.length").alias("length"),
                                                    F.min("x.low").alias("low"), F.max("x.high").alias("high")))
    return (per.groupBy("host", "outline").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(
        F.struct("k", "length", "low", "high"))).alias("x"))
        .select("host", "outline", "pages", F.col("x.length").alias("length"), F.col("x.low").alias("low"),
                F.col("x.high").alias("high")))


_OUTLINE = "host string, outline string, pages array<long>, length array<long>, low array<long>, high array<long>"


def _load(text: str, pages, length, low, high) -> tuple[Tree, list[Tree]]:
    root, nodes = read_outline(text)
    for k, t in enumerate(nodes):
        t.pages, t.length, t.low, t.high = int(pages[k]), int(length[k]), int(low[k]), int(high[k])
    return root, nodes


def _wrappers(outlines: DataFrame, group: int) -> DataFrame:
    """One merged outline a host."""

    def fold(pdf):
        import pandas as pd
        pdf = pdf.assign(most=[max(p) for p in pdf["pages"]]).sort_values(["most", "outline"], ascending=[False, True])
        root = None
        for r in pdf.itertuples():
            t, _ = _load(r.outline, r.pages, r.length, r.low, r.high)
            if root is None:
                root = t
            else:
                merge(root, t)
        text, nodes = write_outline(root)
        return pd.DataFrame([(pdf["host"].iloc[0], text, *[[getattr(t, a) for t in nodes]
                                                         for a in ("pages", "length", "low", "high")])],
                            columns=["host", "outline", "pages", "length", "low", "high"])

    cur = outlines.withColumn("pages", F.transform("length", lambda _: F.col("pages")))
    while True:
        many = cur.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = many.agg(F.max("n")).first()[0] or 0
        salted = cur.join(many, "host").withColumn("g", F.pmod(F.xxhash64("outline"), F.ceil(F.col("n") / group)))
        cur = written(salted.drop("n").groupBy("host", "g").applyInPandas(lambda p: fold(p), _OUTLINE), "wrappers")
        if most <= group:
            return cur


def extract_main(df: DataFrame, html: str = "html", url: str = "url", group: int = GROUP) -> DataFrame:
    """``df`` with ``text`` (main text: blocks in page order joined by one blank) and ``n_chars``.

    A null or empty page has the text ''.  A null url is a host of its own.  A page whose
    host has no other page, or only copies of it, is judged by its own tree.  Repeated rows
    get the same text; an empty table gives an empty result.  Input columns named ``text``
    or ``n_chars`` are replaced."""
    base = df.drop("text", "n_chars")
    n = own_names(base, ["_p", "_host", "_key", "_keep"])
    found = written(_outlines(base, url, html), "outlines")
    wrapper = _wrappers(found, group).select("host", F.struct("outline", "pages", "length", "low", "high").alias("w"))

    def judge(batches):
        import pandas as pd
        cache: dict[str, Tree] = {}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                page, nodes = _load(r.outline, r.pages, r.length, r.low, r.high)
                w = r.w
                if r.host not in cache:
                    if len(cache) > 200:
                        cache.clear()
                    cache[r.host] = _load(w["outline"], w["pages"], w["length"], w["low"], w["high"])[0]
                rows.append((r.host, xxhash.xxh3_64_intdigest(r.outline.encode()) - (1 << 63),
                             content_nodes(page, nodes, cache[r.host])))
            yield pd.DataFrame(rows, columns=["host", "key", "keep"])

    same = found.withColumn("pages", F.transform("length", lambda _: F.col("pages")))
    keep = written(same.join(wrapper, "host").mapInPandas(judge, "host string, key long, keep array<int>"), "content")

    @F.pandas_udf("host string, key long, node array<int>, block array<string>")
    def blocks_of(urls, pages):
        import pandas as pd
        rows = []
        for u, p in zip(urls, pages):
            root, blocks = parse(p or "")
            text, _ = outline(root)
            rows.append((_host(u), xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63),
                         [x.index for x, _ in blocks], [t for _, t in blocks]))
        return pd.DataFrame(rows, columns=["host", "key", "node", "block"])

    p = n["_p"]
    right = keep.select(F.col("host").alias(n["_host"]), F.col("key").alias(n["_key"]), F.col("keep").alias(n["_keep"]))
    d = base.withColumn(p, blocks_of(F.col(url), F.col(html)))
    d = d.join(right, (F.col(f"{p}.host") == F.col(n["_host"])) & (F.col(f"{p}.key") == F.col(n["_key"])), "left")
    kept = F.filter(F.arrays_zip(F.col(f"{p}.node").alias("node"), F.col(f"{p}.block").alias("block")),
                    lambda x: F.array_contains(F.col(n["_keep"]), x["node"]))
    d = d.withColumn("text", F.coalesce(F.array_join(F.transform(kept, lambda x: x["block"]), " "), F.lit("")))
    return (d.withColumn("n_chars", F.length("text").cast("long")).drop(*n.values()))
