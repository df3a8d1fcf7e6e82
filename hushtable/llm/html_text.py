"""Main text of web pages by wrapper induction.

The DOM trees of the pages of a host are folded into one template by simple
tree matching: matched nodes count together, a node whose own text is the same
on every page that has it is constant, any other is a varying slot. The wrapper
of a host follows from its template alone: from the root down, the container
that holds two thirds of the varying text outside of links is the content, as
long as that leaves no varying main heading outside; boxes within it that most
pages have, with the same text on different pages, are template too. A page is
read through its host's wrapper. Elements that are never text of the article by
their HTML meaning (``UNREAD``) are left out of templates and texts.

Templates are folded within tasks first, then in levels of ``FAN_IN`` partial
templates, so neither a hot host nor many tasks meet in one group; they don't
grow with the number of pages, as repeated siblings count as one node, nodes
below ``DEPTH`` count with their ancestor there, and a node has ``MOST_CHILDREN``
at most, the rarest ones as one. Lines that pages share stay content: only
boxes are compared.

A host of one page, or of copies of one, has nothing to compare, and a template
may single no container out; such pages, and those that don't fit their host's
wrapper, are read by general rules for tags and class names. A null or empty
page has an empty text; a null URL has the host "". Elements nested deeper than
``DEEPEST`` are read as part of their ancestor there; broken declarations and
tags that the page's end cuts off are no text. Repeated pages give repeated
rows, an empty table gives an empty table, and further columns are left out. A
very long page is held by its task alone.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import kept_table, small_batches, table

#: HTML elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MUTE = ("script", "style")
UNREAD = set("head title noscript template iframe svg math canvas audio video object select option button input textarea form nav aside footer dialog".split())
#: Parts of class names and ids that mark what is not the article.
ASIDE_NAMES = set("""
nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended ad ads advert advertisement
adverts sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search
share sharing social comment comments reply replies disqus pagination pager toolbar skip
""".split())
MAIN = ("article", "main")
HEADING = "h1"
#: Elements that may hold a whole article, and those that are boxes within one.
CONTAINERS = set("html body main article section div center table tbody tr td".split())
BOXES = set("div section ul ol dl table".split())
#: The least share of the varying text that the content has.
CONTENT_SHARE = 2 / 3
#: Levels of a template, children of its nodes, levels of a page, and partial templates that are folded at once.
DEPTH, MOST_CHILDREN, DEEPEST, FAN_IN = 60, 200, 512, 64
#: A host's wrappers are broadcast up to this size; Spark joins larger ones by a shuffle.
BROADCAST_BYTES = 8 << 20
PIECE_BYTES = 2 << 20


class Node:
    """``unread`` by its element, ``aside`` by its element or by its names; both hold for all below, but names don't reach into an article."""

    __slots__ = ("tag", "label", "parent", "depth", "unread", "aside", "children", "text", "links")

    def __init__(self, tag: str, label: str, parent: Node | None, unread: bool, named: bool):
        self.tag, self.label, self.parent, self.depth = tag, label, parent, 0 if parent is None else parent.depth + 1
        self.unread = unread or parent is not None and parent.unread
        self.aside = self.unread or named or parent is not None and parent.aside and tag not in MAIN
        self.children, self.text, self.links = [], [], 0
        if parent is not None:
            parent.children.append(self)


class Page(HTMLParser):
    """The block-level tree of a page and its text blocks, in order, each with its node."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None, False, False)
        self.blocks: list[tuple[Node, str]] = []
        self.buffer: list[str] = []
        self.in_link = 0
        self.open, self.skipped = Counter(), Counter()  # open elements by name: nodes, and those too deep for one
        self.feed(html)
        if re.match("<[A-Za-z/!?]", self.rawdata):  # a tag, comment or declaration that the end cuts off
            self.rawdata = ""
        self.close()
        self.flush()

    def parse_html_declaration(self, i: int) -> int:
        """Declarations of any kind end at ``>``, a document type with declarations of its own at ``]>``."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i)
        inner = self.rawdata.find("[", i, max(end, i))
        if inner >= 0 and self.rawdata[i + 2 : i + 9].lower() == "doctype" and (found := re.compile(r"\]\s*>").search(self.rawdata, inner)):
            end = found.end() - 1
        return end + 1 if end >= 0 else -1

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer = []
            if text:
                self.blocks.append((self.at, text))
                self.at.text.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            self.in_link += tag == "a"
            return
        if tag in MUTE:
            return
        self.flush()
        self.in_link = 0
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.up_to("p", CLOSES_P - {"p"})
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.up_to(tag, {"ul", "ol", "dl", "table", "select"})
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        found = [x for x in re.split(r"[^a-z]+", names) if x]
        hidden = any(k == "hidden" or k == "style" and v and "display:none" in v.replace(" ", "").lower() for k, v in attrs)
        inside = any(self.open[m] for m in MAIN)
        unread = tag in UNREAD or hidden or tag == "header" and not inside
        if self.at.depth >= DEEPEST and (self.at.unread or not unread):
            self.skipped[tag] += 1
            return
        names_of_asides = ASIDE_NAMES - {"header"} if inside else ASIDE_NAMES  # the heading of an article is its own
        named = tag not in ("html", "body", *MAIN) and not names_of_asides.isdisjoint(found)
        self.open[tag] += 1
        self.at = Node(tag, ".".join([tag, *found]), self.at, unread, named)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.in_link = max(0, self.in_link - (tag == "a"))
            return
        if tag in MUTE:
            return
        self.flush()
        if self.skipped[tag]:
            self.skipped[tag] -= 1
        elif tag not in VOID:
            self.up_to(tag, {"article", "main", "table", "body"} - {tag} if tag in ("p", "li", "div", "span") else set())

    def handle_data(self, data: str) -> None:
        if self.cdata_elem in MUTE:
            return
        self.buffer.append(data)
        if self.in_link:
            self.at.links += len(data)

    def up_to(self, tag: str, bounds: set[str]) -> None:
        """Closes the innermost open element of this name, unless one of ``bounds`` is open within it."""
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            if node.tag in bounds:
                return
            node = node.parent
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.skipped.clear()


# A template node: label, pages, checksum of its text or None if it varies, characters, characters in links, unread, children,
# checksum of the page that has it or None if several do
LABEL, PAGES, TEXT, CHARS, LINKS, SKIPPED, CHILDREN, PAGE = range(8)


def skeleton(node: Node, page: int) -> list:
    """The template of one page: like neighbours count as one node."""
    texts, links, rest = list(node.text), node.links, []
    if node.depth >= DEPTH:
        rest = list(node.children)
        while rest:  # all below counts here
            below = rest.pop()
            texts += below.text if not below.unread else []
            links += below.links
            rest += below.children
    own = [node.label, 1, zlib.crc32("\n".join(texts).encode()), sum(map(len, texts)), links, int(node.unread), [], page]
    for child in () if node.depth >= DEPTH else node.children:
        part, last = skeleton(child, page), own[CHILDREN][-1] if own[CHILDREN] else None
        if last is not None and last[LABEL] == part[LABEL]:
            fold(last, part)
            last[PAGES] = 1
        else:
            own[CHILDREN].append(part)
    return own


def matched(a: list[list], b: list[list]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of subtrees: the most matched nodes, and the matched pairs of these lists."""
    if [x[0] for x in a] == [x[0] for x in b]:  # the best there is, as each node has its like at its place
        return sum(1 + matched(x[6], y[6])[0] for x, y in zip(a, b, strict=True)), [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    won = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j])
            if x[0] == y[0] and (w := best[i][j] + 1 + matched(x[6], y[6])[0]) > best[i + 1][j + 1]:
                best[i + 1][j + 1] = w
                won[i, j] = w
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if won.get((i - 1, j - 1)) == best[i][j] and best[i][j] > max(best[i - 1][j], best[i][j - 1]):
            pairs.append((i := i - 1, j := j - 1))
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return best[len(a)][len(b)], pairs[::-1]


def fold(into: list, other: list) -> list:
    """Aligns ``other`` with ``into`` and adds it there; what has no like becomes an optional node."""
    into[PAGES] += other[PAGES]
    into[TEXT] = into[TEXT] if into[TEXT] == other[TEXT] else None
    into[CHARS] += other[CHARS]
    into[LINKS] += other[LINKS]
    into[SKIPPED] = into[SKIPPED] and other[SKIPPED]
    into[PAGE] = into[PAGE] if into[PAGE] == other[PAGE] else None
    a, b = into[CHILDREN], other[CHILDREN]
    merged, i, j = [], 0, 0
    for x, y in [*matched(a, b)[1], (len(a), len(b))]:
        merged += a[i:x] + b[j:y]
        if x < len(a):
            merged.append(fold(a[x], b[y]))
        i, j = x + 1, y + 1
    if len(merged) > MOST_CHILDREN:  # the rarest become one node of no name, which no page's node is
        rare = sorted(range(len(merged)), key=lambda k: merged[k][PAGES])[: len(merged) - MOST_CHILDREN // 2]
        rest = ["*", 0, None, 0, 0, 0, [], None]
        for k in rare:
            rest[PAGES] += merged[k][PAGES]
            rest[CHARS] += mass(merged[k])
        gone = set(rare)
        merged = [x for k, x in enumerate(merged) if k not in gone] + [rest]
    into[CHILDREN] = merged
    return into


def mass(node: list) -> int:
    """Varying text in a template node, outside of links."""
    if node[SKIPPED]:
        return 0
    own = node[CHARS] - node[LINKS] if node[TEXT] is None else 0
    return max(0, own) + sum(map(mass, node[CHILDREN]))


def tag_of(node: list) -> str:
    return node[LABEL].split(".")[0]


def has_heading(node: list) -> bool:
    """Whether a main heading in it varies."""
    return not node[SKIPPED] and (tag_of(node) == HEADING and mass(node) > 0 or any(map(has_heading, node[CHILDREN])))


def is_constant(node: list) -> bool:
    return bool(node[SKIPPED]) or node[TEXT] is not None and all(map(is_constant, node[CHILDREN]))


def labels_of(node: list) -> list[str]:
    return [c[LABEL] for c in node[CHILDREN]]


def constants(node: list, pages: int) -> list | None:
    """The boxes below a node that most pages have, with the same text on different pages: the labels of its children, and pairs of a child's place and None (a box) or what is so below it."""
    found = []
    for k, c in enumerate(node[CHILDREN]):
        if tag_of(c) in BOXES and 2 * c[PAGES] > pages and c[PAGE] is None and is_constant(c):
            found.append((k, None))
        elif below := constants(c, pages):
            found.append((k, below))
    return [labels_of(node), found] if found else None


def wrapper(template: list) -> dict | None:
    """The way to the content (the labels of the children of each node on it, and the place of the next one) and the constant boxes in it; None where nothing varies or no container stands out."""
    if template[PAGE] is not None:
        return None
    node, path, total = template, [], mass(template)
    while node[CHILDREN]:
        k = max(range(len(node[CHILDREN])), key=lambda i: mass(node[CHILDREN][i]))
        best, others = node[CHILDREN][k], node[CHILDREN][:k] + node[CHILDREN][k + 1 :]
        if tag_of(best) not in CONTAINERS or mass(best) < CONTENT_SHARE * total or any(map(has_heading, others)):
            break
        path.append((labels_of(node), k))
        node = best
    if not total or tag_of(node) in ("", "html", "body"):
        return None
    return {"path": path, "constant": constants(node, node[PAGES])}


def aligned(labels: list[str], node: Node) -> dict[int, list[Node]]:
    """Which children of a page's node (runs of like neighbours) are those of a template's node."""
    runs: list[tuple[str, list[Node]]] = []
    for c in node.children:
        if runs and runs[-1][0] == c.label:
            runs[-1][1].append(c)
        else:
            runs.append((c.label, [c]))
    bare = lambda names: [[x, 0, 0, 0, 0, 0, [], 0] for x in names]
    return {i: runs[j][1] for i, j in matched(bare(labels), bare(x for x, _ in runs))[1]}


def read_by(page: Page, wrap: dict) -> list[str]:
    """The blocks that a wrapper chooses."""
    content = [page.root]
    for labels, k in wrap["path"]:
        content = [x for node in content for x in aligned(labels, node).get(k, [])]
    chosen, rest = {id(x): True for x in content}, [(x, wrap["constant"]) for x in content if wrap["constant"]]
    while rest:
        node, (labels, found) = rest.pop()
        places = aligned(labels, node)
        for k, below in found:
            for x in places.get(k, []):
                if below is None:
                    chosen[id(x)] = False
                else:
                    rest.append((x, below))
    out = []
    for node, text in page.blocks:
        x, passed = node, []
        while x is not None and id(x) not in chosen:
            passed.append(id(x))
            x = x.parent
        verdict = x is not None and chosen[id(x)]
        chosen.update(dict.fromkeys(passed, verdict))
        if verdict and not node.unread:
            out.append(text)
    return out


def read_by_rules(page: Page) -> list[str]:
    """The blocks of the first kind of main element, else all, without what is aside by its element or its names."""
    inside: dict[int, set[str]] = {}

    def mains(node: Node) -> set[str]:
        """The main elements that a node is in."""
        found, x = set(), node
        while x is not None:
            found |= {x.tag} & set(MAIN)
            x = x.parent
        return found

    for tag in MAIN:
        out = []
        for node, text in page.blocks:
            if id(node) not in inside:
                inside[id(node)] = mains(node)
            if tag in inside[id(node)] and not node.aside:
                out.append(text)
        if out:
            return out
    return [text for node, text in page.blocks if not node.aside] or [text for node, text in page.blocks if not node.unread]


def main_text(page: Page, wrap: dict | None) -> str:
    return "\n".join(wrap and read_by(page, wrap) or read_by_rules(page))


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def induced(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row for each host: its wrapper, in JSON."""
    schema = pa.schema([("host", pa.string()), ("part", pa.int32()), ("template", pa.string())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"host": h, "part": part, "template": json.dumps(t)} for h, t in held.items()], schema=schema)

        for batch in small_batches(batches, "html", PIECE_BYTES):
            for host, raw in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                if not raw or raw.isspace():
                    continue  # no tree to align
                own = skeleton(Page(raw).root, zlib.crc32(raw.encode()))
                held[host] = fold(held[host], own) if host in held else own
                if len(held) > 5_000:
                    yield out()
                    held = {}
        if held:
            yield out()

    def folded(pdf):
        templates = map(json.loads, pdf["template"])
        total = next(templates)
        for t in templates:
            total = fold(total, t)
        return pdf.iloc[:1].assign(template=json.dumps(total))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(wrapper(json.loads(t))) for t in batch["template"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(found, pa.string())], names=["host", "wrapper"])

    kinds = "host string, part int, template string"
    parts = kept_table(df.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(partial, kinds), "templates")
    tasks = 1 + (parts.agg(F.max("part")).first()[0] or 0)
    while True:  # each level has a FAN_IN-th of the parts
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("host", "part").applyInPandas(folded, kinds)
        if tasks <= 1:
            return parts.select("host", "template").mapInArrow(finished, "host string, wrapper string")


def extract(df: DataFrame, wrappers: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page. Wrappers are learnt from the same pages unless given."""
    wrappers = kept_table(induced(df, url, html) if wrappers is None else wrappers, "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("wrapper")), F.lit(0)).alias("n")).first()["n"]
    pages = df.select(page_id, url, F.col(html).alias("html"), host_of(url).alias("host"))
    joined = pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left").drop("host")
    own = f"{page_id} {df.schema[page_id].dataType.simpleString()}, {url} string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html", PIECE_BYTES):
            texts = [main_text(Page(raw or ""), json.loads(w) if w else None) for raw, w in zip(batch["html"].to_pylist(), batch["wrapper"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[page_id], batch[url], pa.array(texts, pa.string())], names=[page_id, url, "text"])

    return joined.select(page_id, url, "html", "wrapper").mapInArrow(run, own).withColumn("n_chars", F.length("text").cast("long"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
