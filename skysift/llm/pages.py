"""Main text of web pages by wrapper induction per host.

Every page becomes a small tree of its containers, in which a run of text
blocks is one node. The commonest unlike trees of a host are its references; all
pages of the host are aligned with the nearest of them by simple tree matching. Over
all aligned pages, a reference node whose text hardly varies is template; the main
slot is where most varying text stands. A page's article is the node aligned with the
main slot without template; an own article or main element around it, or the only one
in it, gives its bounds. Pages that are not aligned and hosts with fewer than
TEMPLATE_PAGES pages give what their article or main elements hold, else their body
without template nodes; parts that are never article are left out everywhere.

Statistics are one narrow row per aligned node, combined before they are shuffled;
references are skeletons of hashes, and how they meet the pages is left to Spark's
size checks. A page is parsed where it is read.

Defined results: null or empty html gives an empty text; a page without url belongs to
the host ''; broken and cut off markup is read as far as it goes; repeated rows give
equal rows; an empty table gives no rows. An element that only its class or id names
as a part beside the article is left out, but not where it holds the page's article. Markup
may nest to any depth. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as html_entities
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.session import TableStore

# A node is template when so many aligned pages, and this share of them, have the same text.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
# The main slot goes down to a container while it holds this share of the varying text.
SLOT_SHARE = 0.6
# Layouts of a host: of so many commonest skeletons the first, and those that share less than this of their nodes with the ones before.
CANDIDATES, LAYOUTS, SAME_LAYOUT = 16, 4, 0.8

# Fixed values of HTML: elements without end, with raw text, that end a paragraph, and that are never article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
            "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
            "tbody td tfoot th thead tr ul caption".split())
CONTAINER = set("html body div section main article td center table tbody tr header footer nav aside form head".split())
NEVER = set("head nav footer aside form script style noscript template iframe textarea title button select option svg math canvas audio video "
            "object embed menu dialog input label fieldset search noembed noframes xmp".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status".split())
MARKS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
            "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead topbar comment comments discussion disqus replies "
            "reply share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager".split())
# Ends implied by a start tag: closed elements, and the elements at which the search for them stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(?:/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parts", "skip", "number", "main", "marked")

    def __init__(self, tag: str, skip: bool = False, main: bool = False, marked: bool = False):
        self.tag, self.parts, self.skip, self.main, self.number = tag, [], skip, main, -1  # parts: texts and nodes in order
        self.marked = marked  # named by its class or id as no part of the article


def settle_marks(root: Node) -> None:
    """Leave out what is marked; where all articles of a page stand in marked elements, these stay."""
    order: list[tuple[Node, Node | None, bool]] = [(root, None, False)]  # node, parent, below a marked one
    for node, _, below in order:
        order += [(part, node, below or node.marked) for part in node.parts if isinstance(part, Node) and not node.skip]
    free = any(node.main and not node.skip and not below for node, _, below in order)
    holding: set[int] = set()
    if not free:
        for node, parent, _ in reversed(order):
            if not node.skip and (node.main or id(node) in holding) and parent is not None:
                holding.add(id(parent))
    for node, _, _ in order:
        node.skip = node.skip or node.marked and id(node) not in holding


def parse(text: str) -> Node:
    """Tree of a page; a start tag ends open elements as HTML implies, an end tag without start is passed over."""
    root = Node("root")
    stack, pos, depth = [root], 0, 0
    for m in TOKEN.finditer(text):
        if m.start() < pos:
            continue  # inside raw text
        if m.start() > pos:
            stack[-1].parts.append(text[pos : m.start()])
        pos = m.end()
        name = m.group(2)
        if not name:
            if m.group(0).startswith("<![CDATA["):
                stack[-1].parts.append(html_entities.escape(m.group(0)[9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if not m.group(4):
            continue  # cut off inside a tag
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        closed, limits = IMPLIED.get(tag, ((), ()))
        if closed:
            last = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in limits:
                    break
                if stack[k].tag in closed:
                    last = k
            if last:
                del stack[last:]
        skip, main, marked = tag in NEVER, tag in ("article", "main"), False
        if m.group(3) and tag not in ("html", "body"):
            attrs = {a.lower(): b or c or d or "" for a, b, c, d in ATTR.findall(m.group(3))}
            role = attrs.get("role", "").lower()
            main = main or role in ("main", "article")
            marks = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", attrs.get("class", "") + " " + attrs.get("id", "")).lower()))
            skip = skip or role in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""))) or (tag == "article" and bool(marks & {"comment", "comments", "reply"}))
            marked = not main and bool(marks & MARKS)
        node = Node(tag, skip, main, marked)
        stack[-1].parts.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(text, pos)
            node.parts.append(text[pos : end.start()])
            pos = end.end()
            continue
        stack.append(node)
        depth = max(depth, len(stack))
    if pos < len(text):
        stack[-1].parts.append(text[pos:])
    # The walks below call themselves for each level; Python functions do so on the heap, bounded by this number alone.
    if 4 * depth + 1000 > sys.getrecursionlimit():
        sys.setrecursionlimit(4 * depth + 10_000)
    settle_marks(root)
    return root


def blocks_of(node: Node, dropped: set[int], out: list[str], line: list[str], in_article: bool) -> None:
    """Append the texts of the blocks below a node; `line` holds the open block."""
    for part in node.parts:
        if isinstance(part, str):
            line.append(part)
            continue
        if part.skip or (part.tag == "header" and not in_article) or part.number in dropped:
            if part.tag in BLOCK:
                flush(out, line)
            continue
        if part.tag == "br" or part.tag in BLOCK:
            flush(out, line)
            blocks_of(part, dropped, out, line, in_article or part.main)
            flush(out, line)
        else:
            blocks_of(part, dropped, out, line, in_article)


def flush(out: list[str], line: list[str]) -> None:
    if line:
        text = SPACE.sub(" ", html_entities.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()


def articles(node: Node) -> list[Node]:
    """Outermost article and main elements that are not left out; a main that holds articles gives way to them."""
    found = []
    for part in node.parts:
        if isinstance(part, Node) and not part.skip:
            inner = articles(part)
            if part.main:
                found += inner if inner and part.tag != "article" else [part]
            else:
                found += inner
    return found


def plain_blocks(node: Node, known: dict[int, list[str]]) -> list[str]:
    """Texts of the blocks below a node, each made once for all nodes above it; `known` serves one page."""
    if id(node) in known:
        return known[id(node)]
    out: list[str] = []
    line: list[str] = []

    def walk(inner: Node) -> None:
        for part in inner.parts:
            if isinstance(part, str):
                line.append(part)
            elif part.tag == "br" or part.tag in BLOCK:
                flush(out, line)
                if not part.skip:
                    out.extend(plain_blocks(part, known))
            elif not part.skip:
                walk(part)

    walk(node)
    flush(out, line)
    known[id(node)] = out
    return out


# A skeleton is a list of [tag, number of the parent]; node numbers are places in that list.
def skeleton(root: Node) -> tuple[list[list], list[list[Node]]]:
    """Containers of a page in page order, a run of other blocks being one node 'text', and the page's nodes of each."""
    shape: list[list] = []
    nodes: list[list[Node]] = []

    def walk(node: Node, above: int) -> None:
        run = False
        for part in node.parts:
            if isinstance(part, str) or part.tag not in BLOCK and part.tag not in NEVER:
                continue
            if part.tag in CONTAINER or part.skip:
                shape.append([part.tag, above])
                nodes.append([part])
                part.number = len(shape) - 1
                run = False
                if not part.skip:
                    walk(part, part.number)
            elif part.tag == "h1":
                shape.append(["h1", above])
                nodes.append([part])
                part.number, run = len(shape) - 1, False
            else:
                if not run:
                    shape.append(["text", above])
                    nodes.append([])
                    run = True
                part.number = len(shape) - 1
                nodes[-1].append(part)

    walk(root, -1)
    return shape, nodes


def matched(a: list[list], b: list[list]) -> dict[int, int]:
    """Simple tree matching: numbers of a's nodes to numbers of b's in a largest top-down match that keeps order.

    Children that are alike from the first or the last on, as whole trees, are matched with each other at once: no
    match is larger. So long tables of like rows take a step a row.
    """
    kids: list[dict[int, list[int]]] = []
    kinds: list[list[int]] = []  # equal numbers for equal trees
    names: dict[tuple, int] = {}
    for shape in (a, b):
        below: dict[int, list[int]] = {}
        for i, (_, above) in enumerate(shape):
            below.setdefault(above, []).append(i)
        kids.append(below)
        kind = [0] * len(shape)
        for i in range(len(shape) - 1, -1, -1):
            kind[i] = names.setdefault((shape[i][0], *[kind[k] for k in below.get(i, [])]), len(names))
        kinds.append(kind)
    n_nodes = [1] * len(a)
    for i in range(len(a) - 1, -1, -1):
        if a[i][1] >= 0:
            n_nodes[a[i][1]] += n_nodes[i]
    best: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def size(i: int, j: int) -> int:
        if i >= 0 and a[i][0] != b[j][0]:
            return 0
        if (i, j) not in best:
            xs, ys = kids[0].get(i, []), kids[1].get(j, [])
            head, tail, most = 0, 0, min(len(xs), len(ys))
            while head < most and kinds[0][xs[head]] == kinds[1][ys[head]]:
                head += 1
            while tail < most - head and kinds[0][xs[-1 - tail]] == kinds[1][ys[-1 - tail]]:
                tail += 1
            alike = [*zip(xs[:head], ys[:head], strict=True), *zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)]
            xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
            table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
            for r, x in enumerate(xs, 1):
                row, up = table[r], table[r - 1]
                for c, y in enumerate(ys, 1):
                    row[c] = max(up[c], row[c - 1], up[c - 1] + size(x, y))
            pairs, r, c = list(alike), len(xs), len(ys)
            while r and c:
                if table[r][c] == table[r - 1][c]:
                    r -= 1
                elif table[r][c] == table[r][c - 1]:
                    c -= 1
                else:
                    r, c = r - 1, c - 1
                    pairs.append((xs[r], ys[c]))
            best[i, j] = (table[-1][-1] + 1 + sum(n_nodes[x] for x, _ in alike), pairs)
        return best[i, j][0]

    size(-1, -1)
    out: dict[int, int] = {}
    todo = [(-1, -1)]
    while todo:
        pair = todo.pop()
        if pair not in best:
            size(*pair)  # inside trees that are alike
        for x, y in best[pair][1]:
            out[x] = y
            todo.append((x, y))
    return out


def holds(node: Node, other: Node) -> bool:
    """Whether `other` is the node or stands below it."""
    todo = [node]
    while todo:
        one = todo.pop()
        if one is other:
            return True
        todo += [part for part in one.parts if isinstance(part, Node)]
    return False


def plain(nodes: list[Node], known: dict[int, list[str]]) -> str:
    return "" if not nodes or nodes[0].skip else "\n".join(x for n in nodes for x in plain_blocks(n, known))


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def text_of(tops: list[Node], dropped: set[int]) -> str:
    out: list[str] = []
    for top in tops:
        line: list[str] = []
        blocks_of(top, dropped, out, line, top.main)
        flush(out, line)
    return "\n".join(out)


def main_text(root: Node, wrapper: list[dict] | None) -> str:
    """Text of the article of a parsed page, given its host's wrapper.

    The node aligned with the main slot decides, without what is template. An own
    article element that holds it, or the only one in it, gives its bounds. Only
    nodes with the template's very text are left out, so that what is a page's own stays.
    """
    own = articles(root)
    if not wrapper:
        return text_of(own or [root], set())
    shape, nodes = skeleton(root)
    k, found = nearest(shape, [layout["shape"] for layout in wrapper])
    layout, pairs = wrapper[k], {y: x for x, y in found.items()}
    known: dict[int, list[str]] = {}
    dropped = {pairs[y] for y, same in layout["template"] if y in pairs and hash_of(plain(nodes[pairs[y]], known)) == same}
    if layout["pages"] >= TEMPLATE_PAGES and layout["slot"] in pairs:
        tops = nodes[pairs[layout["slot"]]]
        around = [a for a in own if holds(a, tops[0])] or [a for a in own if holds(tops[0], a)]
        text = text_of(around if len(around) == 1 else tops, dropped)
        if text:
            return text
    return text_of(own, set()) if own else text_of([root], dropped)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def hosted(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    return pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].alias("html"), F.xxhash64(pages[url_col], pages[html_col]).alias("page_key"))


def likeness(pairs: dict[int, int], a: list[list], b: list[list]) -> float:
    return 2 * len(pairs) / max(len(a) + len(b), 1)


def nearest(shape: list[list], references: list[list[list]]) -> tuple[int, dict[int, int]]:
    """Number of the reference most like the shape, the first of equals, and the match of the shape's nodes with its nodes."""
    for k, reference in enumerate(references):
        if reference == shape:
            return k, {i: i for i in range(len(shape))}
    found = [matched(shape, reference) for reference in references]
    k = max(range(len(found)), key=lambda i: likeness(found[i], shape, references[i]))
    return k, found[k]


def wrappers(pages: DataFrame, store: TableStore) -> DataFrame:
    """host and wrapper (JSON list, one per layout: shape, template, slot, pages) from the alignment of all pages of each host."""
    rows = hosted(pages)

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, shapes, wholes = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page or "")
                shape = skeleton(root)[0]
                text = plain([root], {})
                if shape and text:
                    hosts.append(host)
                    shapes.append(json.dumps(shape, separators=(",", ":")))
                    wholes.append(hash_of(text))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), pa.array(wholes, pa.int64())], names=["host", "shape", "whole"])

    outlines = rows.select("host", "html").mapInArrow(outline, "host string, shape string, whole long").distinct()
    counted = outlines.groupBy("host", "shape").agg(F.count("*").alias("n"))
    # Spark limits ranked rows in each task before it deals them out.
    commonest = counted.withColumn("_rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "shape"))).filter(F.col("_rank") <= CANDIDATES)
    candidates = commonest.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("_rank", "shape"))).alias("shapes"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for shapes in batch.column(1).to_pylist():
                chosen: list[list[list]] = []
                for shape in (json.loads(x["shape"]) for x in shapes):
                    if len(chosen) < LAYOUTS and all(likeness(matched(shape, c), shape, c) < SAME_LAYOUT for c in chosen):
                        chosen.append(shape)
                made.append(json.dumps(chosen))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "shapes"])

    layouts = store.write(candidates.select("host", "shapes").mapInArrow(choose, "host string, shapes string"), "layouts")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, layout, numbers, hashes, sizes, wholes, known = [], [], [], [], [], [], {}
            for host, page, shapes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                references = known.get(shapes) or known.setdefault(shapes, json.loads(shapes))
                root = parse(page or "")
                mine, nodes = skeleton(root)
                k, pairs = nearest(mine, references)
                texts: dict[int, list[str]] = {}
                whole = hash_of(plain([root], texts))
                for x, y in pairs.items():
                    text = plain(nodes[x], texts)
                    hosts.append(host)
                    layout.append(k)
                    numbers.append(y)
                    hashes.append(hash_of(text))
                    sizes.append(len(text))
                    wholes.append(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(layout, pa.int32()), pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(wholes, pa.int64())],
                names=["host", "layout", "number", "text_hash", "size", "whole"])

    aligned = rows.select("host", "html").join(layouts, "host").select("host", "html", "shapes")
    aligned = aligned.mapInArrow(align, "host string, layout int, number int, text_hash long, size long, whole long")
    # Copies of a page tell no more of its host than one of them.
    distinct = aligned.groupBy("host", "layout", "number", "text_hash", "whole").agg(F.max("size").alias("size"))
    texts = distinct.groupBy("host", "layout", "number", "text_hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    each = texts.groupBy("host", "layout", "number").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "text_hash")).alias("most"), F.sum(F.col("n") * F.col("size")).alias("mass"))
    each = each.select("host", "layout", "number", "pages", F.col("most.n").alias("same"), F.col("most.text_hash").alias("text_hash"), "mass")
    # One entry per node of the reference skeletons.
    tallied = each.groupBy("host").agg(F.collect_list(F.struct("layout", "number", "pages", "same", "text_hash", "mass")).alias("nodes")).join(layouts, "host")

    def induced(shape: list[list], nodes: list[dict]) -> dict:
        template = [(n["number"], n["text_hash"]) for n in nodes if n["same"] >= TEMPLATE_PAGES and n["same"] >= TEMPLATE_SHARE * n["pages"] and shape[n["number"]][0] not in ("html", "body")]
        constant = {number for number, _ in template}
        mass = {n["number"]: 0 if n["number"] in constant else n["mass"] for n in nodes}
        slot, kids = -1, [i for i, (_, above) in enumerate(shape) if above == -1]
        whole = max([mass.get(i, 0) for i in kids], default=0)
        while kids:
            top = max(kids, key=lambda i: mass.get(i, 0))
            if shape[top][0] not in CONTAINER or mass.get(top, 0) < SLOT_SHARE * whole or not whole:
                break
            slot, kids = top, [i for i, (_, above) in enumerate(shape) if above == top]
        return {"shape": shape, "template": template, "slot": slot, "pages": max([n["pages"] for n in nodes], default=0)}

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps([induced(shape, [n for n in nodes if n["layout"] == k]) for k, shape in enumerate(json.loads(shapes))])
                    for nodes, shapes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "wrapper"])

    return store.write(tallied.select("host", "nodes", "shapes").mapInArrow(induce, "host string, wrapper string"), "wrappers")


def extract(pages: DataFrame, store: TableStore, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, one row per row of `pages`."""
    own = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    found = wrappers(own, store)
    rows = own.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "wrapper")
    id_type = own.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[dict]] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper is not None and wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                texts.append(main_text(parse(page), known.get(wrapper)) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(read, f"page_id {id_type}, url string, text string, n_chars long")
