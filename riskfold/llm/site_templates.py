"""Main text of web pages with removal of a site's repeated subtrees.

One pass parses every page into a light element tree.  It finds the articles,
leaves out elements whose tag says that they are something else (menus, footers,
forms, scripts) and containers whose role or class names them so (headers, side
bars, notices, adverts, reader comments), and writes the remaining text as blocks,
each with the hashes of the containers above it, together with the hashes of all
container subtrees of the page.  A class of a paragraph or of a run of text only
proposes: such an element counts as a container, and goes if the site repeats it.

Spark counts the subtree hashes per host.  A container whose subtree occurs with
``min_pages`` or more different surroundings on one host is a template and goes with
its blocks, however much of a page it is.  Its surroundings are the page's main text
without it, so copies of a page count once: an article that a site repeats stays.
Other paragraphs, headings and list entries of an article are never templates by
themselves: a passage that a site repeats stays, too.

Only pages that hold a removable container take part in the join with the
templates; hot templates are split by the skew join on (host, hash).
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import ship_package, stash, text_chunks
from riskfold.llm.url_filter import url_host

MIN_PAGES = 5

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
CONTAINERS = frozenset("div section aside nav header footer ul ol dl table form figure details center menu fieldset main article".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot
    th thead tr ul""".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
DROPPED = frozenset("""head script style noscript template title nav footer aside form button select option textarea iframe
    object embed svg canvas audio video dialog menu input applet noembed noframes map math xmp""".split())
#: An open element of the key ends where one of these starts.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
        "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
        "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"])}
SCOPES = frozenset("ul ol dl table td th article section div main body html".split())
#: Words of class, id or role that name something other than the article.
OTHER = frozenset("""ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription
    signup sidebar side sidenav menu menubar nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments
    commentlist disqus respond reply replies discussion related recommended recommendations share sharing social widget
    login search searchbox searchform pagination pager toolbar toc skip copyright legal disclaimer contentinfo complementary
    dialog teaser teasers outbrain taboola paywall""".split())
HEADER = frozenset(["header", "topbar"])

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|["'/=]""")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "names", "off", "parent", "kids", "size", "hash", "junk", "offer")

    def __init__(self, tag, names, off, parent):
        self.tag, self.names, self.off, self.parent = tag, names, off, parent
        self.kids: list = []      # texts and nodes in page order
        self.size, self.hash, self.junk, self.offer = 0, 0, False, False


def parse(source: str) -> Node:
    """Element tree of a page; unclosed, crossing and cut-off markup is accepted."""
    root = top = Node("#root", frozenset(), False, None)
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            top.kids.append(source[at:])
            break
        if m.start() > at:
            top.kids.append(source[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = top
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                top = node.parent
            elif tag == "p" or tag == "br":
                top.kids.append(Node(tag, frozenset(), False, top))
            continue
        if not source.endswith(">", 0, at):
            continue                                   # a tag cut off by the end of the page
        names, off, attrs = frozenset(), False, m[3]
        if len(attrs) > 1:
            found: set[str] = set()
            for a in _ATTR.finditer(attrs):
                key, value = (a[1] or "").lower(), (a[2] or "").strip("\"'")
                if key == "style":
                    off = off or _HIDDEN.search(value) is not None
                elif key == "hidden":                  # its mere presence counts
                    off = True
                elif key == "aria-hidden":
                    off = off or value.lower() == "true"
                elif key in ("class", "id", "role"):
                    found.update(x.lower() for x in _NAME.findall(value))
            names = frozenset(found)
        # elements that this start ends without an end tag
        if tag in BLOCKS:
            node = top
            while node is not root and node.tag not in SCOPES and node.tag != "p":
                node = node.parent
            if node.tag == "p":
                top = node.parent
        for kind, stops in ENDS.items():
            if tag in stops:
                node = top
                while node is not root and node.tag != kind and (node.tag not in SCOPES or node.tag in ("td", "th")):
                    node = node.parent
                if node.tag == kind:
                    top = node.parent
        node = Node(tag, names, off, top)
        top.kids.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            node.kids.append(source[at:stop.start() if stop else end])
            at = stop.end() if stop else end
        elif tag not in VOID and not attrs.endswith("/>"):
            top = node
        elif tag not in VOID and tag in BLOCKS:
            top = node                                  # "/" has no meaning on such elements
    return root


def _named(node: Node, words: frozenset) -> bool:
    return not node.names.isdisjoint(words)


def _survey(root: Node) -> tuple[set[int], list[Node]]:
    """Hash all subtrees; mark junk, offer named paragraphs and runs of text as
    templates, and measure what remains.  Returns the hashes of container and offered
    subtrees and the outermost main and article elements, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    hashes, mains = set(), []
    for node in order:                                  # from above: junk passes down
        up = node.parent
        named = node.tag in CONTAINERS and node.tag not in ("main", "article") and _named(node, OTHER)
        node.offer = node.tag not in CONTAINERS and node.tag not in ("html", "body") and node.tag not in HEADINGS and _named(node, OTHER)
        comment = node.tag == "article" and _named(node, OTHER)
        node.junk = (up.junk if up else False) or node.tag in DROPPED or node.off or named or comment
    for node in reversed(order):                        # from below: sizes and hashes
        digest = xxhash.xxh64(f"{node.tag} {' '.join(sorted(node.names))}")
        size = 0
        for k in node.kids:
            if isinstance(k, Node):
                digest.update(k.hash.to_bytes(8, "little"))
                size += k.size
            elif text := " ".join(k.split()):
                digest.update(b"\0" + text.encode("utf-8", "replace"))
                size += len(text)
        node.hash = digest.intdigest()
        node.size = 0 if node.junk else size
        if (node.tag in CONTAINERS or node.offer) and node.kids:
            hashes.add(node.hash)
    inside: set[int] = set()
    for node in order:
        below = node.parent is not None and id(node.parent) in inside
        if not below and node.tag in ("main", "article") and not node.junk and node.size:
            mains.append(node)
            below = True
        if below:
            inside.add(id(node))
    return hashes, mains


def extract(source: str) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """(blocks, subtrees) of a page.  A block is its text and the hashes of the
    containers above it; subtrees are the page's container hashes."""
    root = parse(source)
    hashes, mains = _survey(root)
    blocks: list[tuple[str, list[int]]] = []
    inline: list[tuple[str, int | None]] = []      # text and the offered element it stands in
    above: list[int] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(t for t, _ in inline)).split())
        offers = {o for t, o in inline if t.strip()}
        inline.clear()
        if text:     # a block that is nothing but an offered element goes with it
            blocks.append((text, [*above, *(offers if len(offers) == 1 and None not in offers else ())]))

    for top in mains or [root]:
        _write(top, inline, above, flush)
    return blocks, sorted(hashes)


def _write(top: Node, inline: list, above: list[int], flush) -> None:
    """Text of one element: fills ``inline``, flushed at the edges of blocks."""
    offered: list[int] = []
    # explicit stack: (node, next child, list its hash was pushed to, only headings count)
    stack = [(top, 0, None, False)]
    while stack:
        node, i, pushed, heads = stack.pop()
        kids = node.kids
        while i < len(kids):
            k = kids[i]
            i += 1
            if not isinstance(k, Node):
                if not heads:
                    inline.append((k, offered[-1] if offered else None))
                continue
            if k.junk:
                if k.tag in BLOCKS:
                    flush()
                else:
                    inline.append((" ", None))
                continue
            if k.tag == "br" or k.tag in VOID:
                inline.append((" ", None))
                if k.tag == "hr":
                    flush()
                continue
            if k.tag in BLOCKS:
                flush()
                held = above if k.tag in CONTAINERS or k.offer else None
                stack.append((node, i, pushed, heads))
                if held is not None:
                    held.append(k.hash)
                # of a header only headings belong to the article
                only = k.tag not in HEADINGS and (heads or (k.tag in CONTAINERS and (k.tag == "header" or _named(k, HEADER))))
                stack.append((k, 0, held, only))
                break
            stack.append((node, i, pushed, heads))
            if k.offer:
                offered.append(k.hash)
            stack.append((k, 0, offered if k.offer else None, heads))
            break
        else:
            if node.tag in BLOCKS or node is top:
                flush()
            if pushed is not None:
                pushed.pop()


def surroundings(blocks: list[tuple[str, list[int]]], subtrees: list[int]) -> list[int]:
    """Hash of the page's blocks without those of each subtree, whatever their order."""
    total, under = 0, dict.fromkeys(subtrees, 0)
    for text, above in blocks:
        x = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
        total += x
        for h in set(above):
            under[h] += x
    return [(total - under[h]) & (1 << 64) - 1 for h in subtrees]


_BLOCKS = "array<struct<text:string,above:array<long>>>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def page_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, host, blocks, subtrees, rests) per page, ``rests`` the surroundings of each
    subtree; null or empty html has no blocks."""
    ship_package(pages.sparkSession)
    kind = pa.list_(pa.struct([("text", pa.string()), ("above", pa.list_(pa.int64()))]))

    def run(batches):
        for batch in batches:
            for at, part in text_chunks(batch.column(3)):
                blocks, subtrees, rests = [], [], []
                for source in part.to_pylist():
                    b, s = extract(source or "")
                    blocks.append([{"text": t.encode("utf-8", "replace").decode(), "above": list(map(_signed, a))} for t, a in b])
                    subtrees.append(list(map(_signed, s)))
                    rests.append(list(map(_signed, surroundings(b, s))))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(part)) for i in range(3)), pa.array(blocks, kind),
                     *(pa.array(x, pa.list_(pa.int64())) for x in (subtrees, rests))],
                    [id_col, url_col, "host", "blocks", "subtrees", "rests"])

    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), url_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`")) \
        .mapInArrow(run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, host string, blocks {_BLOCKS}, subtrees array<long>, rests array<long>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES) -> DataFrame:
    """(id, url, text), one row per page; text is empty where nothing remains.

    Pages without a host count as one host.  Copies of a page count once; rows
    that share an id share their templates.
    """
    parsed = stash(page_blocks(pages, id_col, url_col, html_col), "blocks")
    common = stash(parsed.select("host", F.inline(F.arrays_zip(F.col("subtrees").alias("h"), F.col("rests").alias("rest"))))
                   .groupBy("host", "h").agg(F.countDistinct("rest").alias("n")).filter(F.col("n") >= min_pages).drop("n"), "templates")
    under = F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["above"])))
    parsed = parsed.select(id_col, url_col, "host", "blocks", under.alias("under"))
    free, bound = parsed.filter(F.size("under") <= 0), parsed.filter(F.size("under") > 0)
    gone = bound.select(F.col(id_col).alias("_id"), "host", F.explode("under").alias("h")).join(common, ["host", "h"]) \
        .groupBy("_id").agg(F.collect_set("h").alias("gone"))
    rest = bound.join(gone, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["above"], F.col("gone")), F.lit(False)))

    def joined(blocks):
        return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n").alias("text")

    return free.select(id_col, url_col, joined("blocks")).unionByName(rest.select(id_col, url_col, joined(kept)))


def op10_site_templates(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
