"""Main text of web pages by wrapper induction.

Pages are parsed into element trees in which neighbouring elements of one kind (tag, class and id words) are one node. The trees of a host's pages are aligned by simple tree matching: two nodes match if they are of one kind, and their children are matched in order with the largest total. Aligned trees are merged into the host's template tree, first within each partition, then in groups of partitions, then for the host; each node keeps the few smallest hashes of the texts it has had, so a template is the same in whatever order pages come.
A node that has had one text in at least MIN_PAGES different pages is constant: it is template. Varying nodes are slots. Slots are content unless their kind says otherwise (navigation, headers and footers of pages, asides, forms, adverts, notices, comments) or they consist of links. If a page has an article or main element with text, only slots inside it are content.

Kinds go by whole names of classes, ids and roles. A part of a compound name (site-nav) counts outside articles, inside them only for adverts, comments and the like; has-, no- and with- deny what follows. No name drops an element around the article or main element with most text, or, on a page without one, an element with most of the text.

Every page is then aligned with its host's tree, and the blocks of its content slots are joined. Inline elements do not part words; block elements and line breaks do.
Edge cases: null or empty html gives an empty text; a missing url is a host of its own; unclosed elements, comments and scripts end where a browser ends them; a host with few pages is judged by kinds alone; equal pages count as one page where constants are told; a template grows with the different element paths of its host; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages with different texts that a constant must stand in, and hashes that tell constant from varying.
MIN_PAGES, HASHES = 4, 6
#: Matching goes as deep as pages are nested; it calls Python functions alone, whose frames are on the heap.
RECURSION = 10_000_000
LINK_SHARE = 0.7

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

#: Fixed values of HTML: elements without content, elements whose content is not markup, elements that part text, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br", "button", "option", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html", "head", "title"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div body html nav aside main header footer form".split())
#: Elements that never hold main text, and words of classes, ids and roles that say so.
NEVER = frozenset("nav footer aside form button select input script style noscript template iframe head title menu dialog textarea svg canvas object label".split())
NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay subscribe subscription newsletter signup share sharing social related recommended sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer pagination pager comment comments commentlist respond disqus reply replies widget login search toolbar masthead skip tracking contentinfo complementary".split())
HOLDS = frozenset("article main".split())
#: First words of a compound name that deny the rest, what is noise inside an article even as a part of a name, and elements of kinds that pages wrap themselves in.
DENIED = frozenset("has no not with without".split())
STRICT = frozenset("ad ads advert adverts advertisement advertising sponsored comment comments commentlist disqus respond reply replies share sharing related recommended cookie newsletter subscribe".split())
WRAPS = frozenset("form object label".split())


class Node:
    __slots__ = ("kind", "tag", "parts", "children", "decision", "names", "keeps")

    def __init__(self, kind: str, tag: str, names: tuple[str, ...] = ()):
        self.kind, self.tag, self.parts, self.children, self.decision, self.names, self.keeps = kind, tag, [], [], "", names, False


def kind_of(tag: str, attributes: str) -> tuple[str, tuple[str, ...]]:
    """A node's kind (tag and the words of its names) and its names as they are."""
    if not attributes.strip():
        return tag, ()
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        names.update(["hidden"] if m[1].lower() == "hidden" else (m[2] or m[3] or m[4] or "").lower().split())
    words = {w for n in names for w in WORDS.findall(n)}
    return ".".join([tag, *sorted(words)]), tuple(sorted(names))


def parse(page: str) -> Node:
    """The element tree; a node's parts are texts and nodes in page order. Every element is kept, whatever its depth."""
    root = Node("#", "#")
    stack, at, n = [root], 0, len(page)
    depth: Counter[str] = Counter()  # open elements of each tag

    def close_from(i: int) -> None:
        for x in stack[i:]:
            depth[x.tag] -= 1
        del stack[i:]

    last = page.rfind(">")
    while at < n:
        # Behind the last ">" no tag ends: there is only text, up to an open comment. Before it every tag does, so none is scanned twice.
        m = TOKEN.search(page, at) if at <= last else re.compile("<!--").search(page, at)
        end = m.start() if m else n
        if end > at:
            stack[-1].parts.append(page[at:end])
        if not m or at > last:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if not depth[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close_from(i)
                    break
                if tag in ("p", "li", "a", "b") and stack[i].tag in SCOPE:
                    break
            continue
        closes = {"p"} if tag in CLOSES_P else SIBLINGS.get(tag)
        if tag in SIBLINGS and tag in CLOSES_P:
            closes = SIBLINGS[tag] | {"p"}
        if closes and any(depth[c] for c in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    close_from(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        kind, names = kind_of(tag, m[3])
        node = Node(kind, tag, names)
        stack[-1].parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = n if close is None else page.find(">", close.start()) + 1 or n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            depth[tag] += 1
    return root


def collapse(nodes: list[Node], kind: str, tag: str) -> dict:
    """Nodes of one kind as one: kind, children by kind, length of texts and of those in links, hash of all text. Children first, without recursion."""
    top = {"kind": kind, "tag": tag, "nodes": nodes}
    order, todo = [], [top]
    while todo:
        x = todo.pop()
        order.append(x)
        groups: dict[str, list[Node]] = {}
        own: list[str] = []
        for node in x["nodes"]:
            for p in node.parts:
                if isinstance(p, str):
                    own.append(p)
                else:
                    groups.setdefault(p.kind, []).append(p)
        x["text"] = SPACE.sub(" ", "".join(own)).strip() if own else ""
        x["kids"] = {k: {"kind": k, "tag": g[0].tag, "nodes": g, "i": i} for i, (k, g) in enumerate(groups.items())}
        todo += x["kids"].values()
    for x in reversed(order):
        kids = x["kids"].values()
        text = x.pop("text")
        x["size"] = len(text) + sum(c["size"] for c in kids)
        x["links"] = x["size"] if x["tag"] == "a" else sum(c["links"] for c in kids)
        x["hash"] = hash_of([text, *(c["hash"] for c in kids)])
    return top


def hash_of(parts: list) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


def match(x: dict, y: dict, memo: dict) -> tuple[int, list[str]]:
    """Simple tree matching of the children of two nodes of one kind: the number of matched nodes below them, and the kinds of the matched children. Kinds are unique among siblings, so only those that both have come into question."""
    both = x["kids"].keys() & y["kids"].keys()
    if len(both) < 2:
        kinds = [*both]
        return weight(x["kids"][kinds[0]], y["kids"][kinds[0]], memo) if kinds else 0, kinds
    a, b = (sorted((t["kids"][k] for k in both), key=lambda c: c["i"]) for t in (x, y))
    w = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a):
        row, above = w[i + 1], w[i]
        for j, q in enumerate(b):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            if p["kind"] == q["kind"]:
                best = max(best, above[j] + weight(p, q, memo))
            row[j + 1] = best
    i, j, kinds = len(a), len(b), []
    while i and j:
        if w[i][j] == w[i - 1][j]:
            i -= 1
        elif w[i][j] == w[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            kinds.append(a[i]["kind"])
    return w[len(a)][len(b)], kinds[::-1]


def weight(x: dict, y: dict, memo: dict) -> int:
    k = (id(x), id(y))
    if k not in memo:
        memo[k] = 1 + match(x, y, memo)[0]
    return memo[k]


def _template(kind: str, i: int) -> dict:
    return {"kind": kind, "i": i, "pages": [], "texts": [], "n": 0, "size": 0, "links": 0, "kids": {}}


def as_template(x: dict, page: int) -> dict:
    top = _template(x["kind"], 0)
    todo = [(x, top)]
    while todo:
        x, t = todo.pop()
        t |= {"pages": [page], "texts": [x["hash"]] if x["size"] else [], "n": 1, "size": x["size"], "links": x["links"]}
        for k, c in x["kids"].items():
            t["kids"][k] = _template(k, c["i"])
            todo.append((c, t["kids"][k]))
    return top


def _few(a: list[int], b: list[int]) -> list[int]:
    return sorted({*a, *b})[: HASHES + MIN_PAGES]


def merge(t: dict, o: dict) -> dict:
    """Adds template tree o to t, whose roots are of one kind. Children that match are merged, and so are those of a kind seen in another order, which are the same slot; others are new. What a node keeps are sums and smallest hashes, so the result is the same in whatever order trees come."""
    memo: dict = {}
    todo = [(t, o)]
    while todo:
        x, y = todo.pop()
        matched = match(x, y, memo)[1]
        for k in ("n", "size", "links"):
            x[k] += y[k]
        x["pages"], x["texts"] = _few(x["pages"], y["pages"]), _few(x["texts"], y["texts"])
        for k in (*matched, *(y["kids"].keys() - set(matched))):
            if k in x["kids"]:
                todo.append((x["kids"][k], y["kids"][k]))
            else:
                x["kids"][k] = y["kids"][k]
    return t


def decide(t: dict) -> dict:
    """The wrapper: kinds with T (template), L (links), or nothing for slots; nothing is kept below template. Inline elements belong to the text around them and are never judged alone."""
    top = {"kind": t["kind"], "i": t["i"], "d": "", "kids": {}}
    todo = [(t, top)]
    while todo:
        t, w = todo.pop()
        if t["kind"] != "#" and t["kind"].split(".")[0] not in BLOCK:
            continue
        constant = len(t["pages"]) >= MIN_PAGES and len(t["texts"]) == 1
        w["d"] = "T" if constant else "L" if t["size"] and t["links"] >= LINK_SHARE * t["size"] else ""
        if not w["d"]:
            for k, c in t["kids"].items():
                w["kids"][k] = {"kind": k, "i": c["i"], "d": "", "kids": {}}
                todo.append((c, w["kids"][k]))
    return top


def dumps(t: dict) -> str:
    """A tree as a flat list in preorder, each node with the number of its children, since deep nesting is not for JSON."""
    flat, todo = [], [t]
    while todo:
        x = todo.pop()
        kids = sorted(x["kids"].values(), key=lambda c: c["kind"])
        flat.append([x[k] for k in x if k != "kids"] + [len(kids)])
        todo += reversed(kids)
    return json.dumps([[k for k in t if k != "kids"], flat], ensure_ascii=False)


def loads(s: str) -> dict:
    names, flat = json.loads(s)
    top: dict = {"kids": {}}
    open_ = [[top, 1]]
    for *values, n in flat:
        while not open_[-1][1]:
            open_.pop()
        node = dict(zip(names, values, strict=True)) | {"kids": {}}
        open_[-1][0]["kids"][node["kind"]] = node
        open_[-1][1] -= 1
        open_.append([node, n])
    return next(iter(top["kids"].values()))


def apply(x: dict, wrapper: dict, memo: dict) -> None:
    """Marks the page's nodes with the decisions of the aligned wrapper nodes."""
    todo = [(x, wrapper)]
    while todo:
        x, w = todo.pop()
        if w["d"]:
            for node in x["nodes"]:
                node.decision = w["d"]
            continue
        matched = match(x, w, memo)[1]
        for k in (*matched, *(x["kids"].keys() - set(matched))):
            if k in w["kids"]:
                todo.append((x["kids"][k], w["kids"][k]))


@functools.lru_cache(100_000)
def _named(name: str) -> int:
    """Whether a class, id or role is noise: 2 as a whole, 1 by a part of it that is noise anywhere, -1 by a part that is noise outside articles only, 0 not at all."""
    if name in NOISE:
        return 2
    words = WORDS.findall(name)
    if not words or words[0] in DENIED:
        return 0
    return 1 if any(w in STRICT for w in words) else -1 if any(w in NOISE for w in words) else 0


def _noise(node: Node, inside: bool) -> bool:
    if node.decision or "hidden" in node.names:
        return True
    if node.tag in NEVER or (node.tag == "header" and not inside):
        return not (node.keeps and node.tag in WRAPS)
    if node.keeps or node.tag in ("html", "body", "article", "main", "p"):
        return False
    return any(says == 2 or says == 1 or (says == -1 and not inside) for says in map(_named, node.names))


def mark_kept(root: Node) -> None:
    """Marks what no kind may drop: the elements around the article or main element with most text outside links; on a page without one, those that hold more than half of that text and are not noise by a whole name."""
    order: list[tuple[Node, Node | None, bool]] = []
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while todo:
        node, parent, off = todo.pop()
        order.append((node, parent, off))
        off = off or (node.tag in NEVER and node.tag not in WRAPS) or node.tag == "a"
        todo += [(p, node, off) for p in node.parts if isinstance(p, Node)]
    text: Counter[int] = Counter()
    for node, parent, off in reversed(order):
        if not off and node.tag != "a" and (node.tag not in NEVER or node.tag in WRAPS):
            text[id(node)] += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if parent is not None:
            text[id(parent)] += text[id(node)]
    above = {id(node): parent for node, parent, _ in order}
    holders = [node for node, _, off in order if not off and node.tag in HOLDS and text[id(node)] and not any(_named(n) > 0 for n in node.names)]
    if holders:
        node: Node | None = max(holders, key=lambda x: text[id(x)])
        while node is not None:
            node.keeps = True
            node = above[id(node)]
        return
    for node, _, _ in order:
        node.keeps = 2 * text[id(node)] > text[id(root)] and not any(_named(n) == 2 for n in node.names)


def _has_text(node: Node, inside: bool) -> bool:
    todo = [(node, inside)]
    while todo:
        x, within = todo.pop()
        if _noise(x, within):
            continue
        for p in x.parts:
            if isinstance(p, str):
                if p.strip():
                    return True
            else:
                todo.append((p, within or p.tag in HOLDS))
    return False


def _holders(root: Node) -> list[Node]:
    """The outermost article or main elements with text, outside noise."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x is not root and (x.tag in HOLDS or "main" in x.kind.split(".")[1:]):
            if _has_text(x, True):
                out.append(x)
            continue
        todo += [p for p in reversed(x.parts) if isinstance(p, Node) and not _noise(p, False)]
    return out


def _blocks(node: Node, inside: bool, out: list[list[str]]) -> None:
    todo: list = [*reversed(node.parts)]
    while todo:
        p = todo.pop()
        if p is None:
            out.append([])
        elif isinstance(p, str):
            out[-1].append(p)
        else:
            if p.tag in BLOCK:
                out.append([])
                todo.append(None)
            if not _noise(p, inside):
                todo += reversed(p.parts)


def main_text(page: str, wrapper: dict | None) -> str:
    root = parse(page)
    if wrapper:
        apply(collapse([root], "#", "#"), wrapper, {})
    mark_kept(root)
    held = _holders(root)
    out: list[list[str]] = [[]]
    for x in held or [root]:
        _blocks(x, bool(held), out)
        out.append([])
    texts = (SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in out if b)
    return " ".join(t for t in texts if t)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A template for each host of a partition."""
    sys.setrecursionlimit(RECURSION)
    found: dict[str, dict] = {}
    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if page:
                x = collapse([parse(page)], "#", "#")
                t = as_template(x, x["hash"])
                found[host] = merge(found[host], t) if host in found else t
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([dumps(t) for t in found.values()], pa.string())], ["host", "tree"])


def _merged(last: bool):
    def run(t: pa.Table) -> pa.Table:
        sys.setrecursionlimit(RECURSION)
        whole = None
        for x in sorted(t.column("tree").to_pylist()):
            whole = loads(x) if whole is None else merge(whole, loads(x))
        return pa.table({"host": t.column("host")[:1], "tree": pa.array([dumps(decide(whole) if last else whole)], pa.string())})

    return run


def host_of() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def induce(pages: DataFrame) -> DataFrame:
    """host, tree: the wrapper of each host. Templates meet in groups of partitions first, so that no task reads more than a share of a host's."""
    trees = pages.select(host_of().alias("host"), "html").mapInArrow(_trees, "host string, tree string").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    partial = trees.groupBy("host", "part").applyInArrow(_merged(False), "host string, tree string")
    return partial.groupBy("host").applyInArrow(_merged(True), "host string, tree string")


#: Characters of wrappers up to which they are sent to every task; beyond it, pages and wrappers meet by host and one of SALTS parts.
SENT, SALTS = 32_000_000, 32


def _with_wrappers(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    size = wrappers.agg(F.sum(F.length("tree"))).first()[0] or 0
    if size <= SENT:
        return rows.join(F.broadcast(wrappers), "host", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)))
    return salted.join(wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    from factloom.llm.common import cut

    wrappers = cut(induce(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(RECURSION)
        kept: dict[str, dict] = {}
        for b in batches:
            texts = []
            for page, tree in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if tree is not None and tree not in kept:
                    if len(kept) > 500:
                        kept.clear()
                    kept[tree] = loads(tree)
                texts.append(main_text(page, kept.get(tree)) if page else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    return _with_wrappers(rows, wrappers).select("page_id", "url", "html", "tree").mapInArrow(run, "page_id long, url string, text string, n_chars long")
