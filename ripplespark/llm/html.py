"""Main text of web pages: site template removal, with rules for furniture that no count can tell.

A page is parsed tolerantly into an element tree. Every element subtree is hashed
(tag, class, id and role, text), subtrees are counted per host in Spark over the
host's distinct pages, and those on more than ``max(LEAST_PAGES, LEAST_SHARE *
pages)`` of them are deleted: they are the site's template, inside and outside of
what a page marks as its content. Pages with equal kept text count as one, so copies
of an article don't make it look like a template. Inside marked content (``main`` or
``article``) a paragraph or heading is the author's even where it recurs, so there
only containers and lists are hashed.

What differs from page to page (random adverts, menus of related pages) recurs
nowhere. For it there are rules, by what pages say of themselves: elements that are
furniture by their tag (navigation, footers, forms, ...) or by a class, id or role
that names furniture and nothing else ("share-buttons" does, "market-share" doesn't)
are dropped; if a page marks its content, so is the rest of the page; of an
article's header the headings stay. ``n_template`` and ``n_rule`` count the blocks
that went for either reason.

The tree never leaves the worker. A page is emitted as blocks of text and the spans
of blocks that its subtrees hold; only counts by (host, hash) are shuffled, and only
pages that hold a frequent subtree are joined and filtered again. Time and memory
are linear in the page, however deep it is.

Character references are decoded. White space inside a block is one space (``br``
counts as white space); blocks are in page order, joined by one newline. A null or
empty page has empty text; so has one with no content. A url without a host is a
host of its own kind (empty). Repeated rows are each returned. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, split_by_keys, tidy
from .words import mix

LEAST_PAGES = 8
LEAST_SHARE = 0.02
#: Frequent subtrees (8 bytes each) that may be sent to all tasks.
MOST_TEMPLATES = 1_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>]*)>|<[/a-zA-Z][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "iframe", "xmp", "noembed", "noframes", "textarea", "title")}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
FURNITURE = frozenset(
    "head nav footer aside form script style noscript template iframe object embed applet svg math canvas audio video map button select option textarea input label fieldset dialog menu search noembed noframes title".split()
)
#: Furniture without text that a reader sees; it is skipped.
UNSEEN = frozenset("head script style noscript template iframe object embed applet svg math canvas audio video map textarea select option input noembed noframes title".split())
#: Words of a class or id that name furniture.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply pagination pager paginator skip widget widgets complementary contentinfo hidden".split()
)
#: Words that may stand beside those; with any other word a name isn't one of furniture.
STRUCTURE = frozenset(
    "a all article articles area author bar bars block body bottom box boxes btn button buttons card cards col column container content count danger desktop field fixed floating form frame global group header heading icon icons image img info inner input item items label large left level link links list lists main media message meta mobile module more next now outer page panel post posts prev previous primary reading region right row secondary section sections set site slot small space sticky stories story strip success tab tabs text this thread title to toggle top trail unit units us view warning wide wrap wrapper x zone".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
HEADERS = frozenset(("header", "heading"))
SITE = frozenset(("site", "top", "global", "website", "blog"))
CONTENT = frozenset(("main", "article"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
AUTHORED = frozenset(("p", "b", "i", "em", "strong", "a", "span", "br", "u", "s", "small", "sub", "sup", "code", "q", "cite", "mark", "time", "abbr", "blockquote", "pre", "figcaption", "li", "dt", "dd", "tr", "td", "th")) | HEADINGS
P_ENDS = BLOCKS - {"body", "html", "dd", "dt", "li", "tr", "tbody", "thead", "tfoot", "caption"}
#: What an opening tag closes, up to the element that holds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"})}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "name", "parent", "items", "furniture")

    def __init__(self, tag: str, name: str, parent: Node | None, furniture: int):
        self.tag, self.name, self.parent, self.items, self.furniture = tag, name, parent, [], furniture


def _names_furniture(words: set[str]) -> bool:
    return bool(words & NAMES) and all(w in NAMES or w in STRUCTURE or w.isdigit() for w in words)


def _furniture(tag: str, attributes: str) -> tuple[int, str]:
    """2 if the tag itself is furniture, 1 if its attributes say so, 3 for a header, 4 for a main part; and what names the element."""
    kind = 2 if tag in FURNITURE else 3 if tag == "header" else 0
    if not attributes or attributes.isspace():
        return kind, ""
    named = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            named.append(value)
            for name in value.split():
                words = {w.lower() for w in WORDS.findall(name)}
                if kind != 2 and _names_furniture(words):
                    kind = 1
                elif kind == 0 and words & HEADERS and (words <= HEADERS or words & SITE):
                    kind = 3
        elif key == "role":
            named.append(value)
            if kind != 2 and value.strip().lower() in ROLES:
                kind = 1
            elif value.strip().lower() == "main" and kind == 0:
                kind = 4
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            kind = kind or 1
    return (0 if tag in ("html", "body") else kind), " ".join(named)


def parse(html: str) -> Node:
    """The element tree. Text items are strings, element items nodes."""
    root = Node("", "", None, 0)
    cur, at = root, 0
    opened: Counter[str] = Counter()

    def up(to: Node) -> Node:
        """Close elements up to ``to``, which stays open."""
        node = cur
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return to

    while True:
        m = TOKEN.search(html, at)
        if m is None:
            if at < len(html):
                cur.items.append(html[at:])
            return root
        if m.start() > at:
            cur.items.append(html[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if html.startswith("<![CDATA[", m.start()):
                cur.items.append(html[m.start() + 9 : at - 3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if close:
            node = cur if opened[tag] else None
            while node is not None and node.tag != tag:
                # a cell or paragraph's end doesn't close what holds it
                node = node.parent if tag in BLOCKS or tag in ("td", "th") or node.tag not in BLOCKS else None
            if node is not None and node.parent is not None:
                cur = up(node.parent)
            continue
        if tag in P_ENDS and opened["p"]:
            node = cur
            while node.parent is not None and node.tag not in P_ENDS and node.tag not in ("li", "td", "th", "dd", "dt"):
                node = node.parent
            if node.tag == "p":
                cur = up(node.parent)
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag][0]):
            ends, holds = CLOSES[tag]
            node, last = cur, None
            while node.parent is not None and node.tag not in holds:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                cur = up(last.parent)
        kind, name = _furniture(tag, attributes)
        node = Node(tag, name, cur, kind)
        cur.items.append(node)
        if tag in RAW and not attributes.endswith("/"):
            end = RAW[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not attributes.endswith("/"):
            cur = node
            opened[tag] += 1


def _contents(root: Node) -> list[Node]:
    """The outermost elements that mark content and aren't inside furniture; ``main`` before ``article``. A ``main`` inside what only its class calls furniture counts if there is no other."""
    mains: list[Node] = []
    articles: list[Node] = []
    inner: list[Node] = []
    odd: list[Node] = []
    todo = [(root, "", False, False)]
    while todo:
        node, inside, in_main, in_furniture = todo.pop()
        for x in reversed(node.items):
            if not isinstance(x, Node) or x.furniture == 2:
                continue
            kind = "main" if x.furniture == 4 else x.tag
            doubt = in_furniture or x.furniture == 1
            if kind in CONTENT and kind != inside:
                if doubt:
                    if kind == "main":
                        odd.append(x)
                elif kind == "main":
                    mains.append(x)
                else:
                    articles.append(x)
                    if in_main:
                        inner.append(x)
                todo.append((x, kind, in_main or kind == "main", doubt))
            else:
                todo.append((x, inside, in_main, doubt))

    def mass(nodes: list[Node]) -> int:
        total, todo = 0, list(nodes)
        while todo:
            for x in todo.pop().items:
                if isinstance(x, str):
                    total += len(x)
                elif x.furniture not in (1, 2):
                    todo.append(x)
        return total

    if mains and articles:
        return inner if inner and mass(inner) * 2 >= mass(mains) else mains
    return mains or articles or odd[:1]


_MANY = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def extract(html: str | None) -> tuple[list[str | None], list[tuple[int, int, int]]]:
    """Blocks of a page (null where a rule drops them), and its hashed subtrees: hash, first block, one past the last."""
    if not html:
        return [], []
    root = parse(html)
    contents = _contents(root)
    marked = {id(x) for x in contents}
    above: set[int] = set()
    for x in contents:
        while x.parent is not None and id(x.parent) not in above:
            x = x.parent
            above.add(id(x))
    blocks: list[str | None] = []
    prefix, power = [0], [1]  # a span's blocks are hashed in constant time
    piece: list[str] = []
    spans: list[tuple[int, int, int]] = []
    DROP, KEEP, HEADER = 0, 1, 2

    def flush(state: int) -> None:
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                blocks.append(text if state == KEEP else None)
                prefix.append((prefix[-1] * _STEP + xxhash.xxh64_intdigest(text)) & _MANY)
                power.append(power[-1] * _STEP & _MANY)
            piece.clear()

    # an element is entered once and left once: node, next item, state, whether it is a block, its first block if it is hashed
    todo: list[tuple[Node, int, int, bool, int]] = [(root, 0, DROP if contents else KEEP, True, -1)]
    while todo:
        node, i, state, block, first = todo.pop()
        if i == len(node.items):
            inline = not block and bool(piece)  # an inline subtree's text is part of a block that goes on
            if block:
                flush(state)
            n = len(blocks)
            if first >= 0 and n > first and not inline:
                body = (prefix[n] - prefix[first] * power[n - first]) & _MANY
                spans.append((xxhash.xxh64_intdigest(f"{node.tag}\0{node.name}\0{body}") - (1 << 63), first, n))
            continue
        todo.append((node, i + 1, state, block, first))
        x = node.items[i]
        if isinstance(x, str):
            piece.append(x)
        elif x.tag == "br":
            piece.append(" ")
        elif x.tag in UNSEEN or x.tag == "hr" or x.furniture == 2 and x.tag not in BLOCKS:  # a button or label inside a line leaves it whole
            if x.tag in BLOCKS:
                flush(state)
        else:
            if x.tag in ("td", "th"):
                piece.append(" ")
            if id(x) in marked:
                then = KEEP
            elif x.furniture == 2 or x.furniture == 1 and id(x) not in above:
                then = DROP
            elif x.furniture == 3:  # of an article's header the headings stay
                then = HEADER if contents and state != DROP else DROP
            elif state == HEADER and x.tag in HEADINGS:
                then = KEEP
            else:
                then = state
            block = x.tag in BLOCKS or then != state
            if block:
                flush(state)
            authored = contents and then == KEEP and x.tag in AUTHORED
            todo.append((x, 0, then, block, -1 if authored or x.tag in ("html", "body") or x.tag in CONTENT else len(blocks)))
    return blocks, spans


PAGE = "uid long, page_id long, url string, host long, body long, blocks array<string>, hashes array<long>, firsts array<int>, ends array<int>"


def _parts(column: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of a string column, one row at least."""
    lo, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if held and held + n > size:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(column):
        yield lo, len(column)


def pages(rows: DataFrame) -> DataFrame:
    """Blocks and hashed subtrees of every page of ``rows`` (``page_id``, ``url``, ``html``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo, hi in _parts(whole.column(2)):
                b = whole.slice(lo, hi - lo)
                got = [extract(x.as_py()) for x in b.column(2)]
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(uid, uid + n), pa.int64()),
                        b.column(0),
                        b.column(1),
                        b.column(3),
                        pa.array([xxhash.xxh64_intdigest("\n".join(t for t in x if t is not None)) - (1 << 63) for x, _ in got], pa.int64()),
                        pa.array([x for x, _ in got], pa.list_(pa.string())),
                        pa.array([[y[0] for y in m] for _, m in got], pa.list_(pa.int64())),
                        *(pa.array([[y[k] for y in m] for _, m in got], pa.list_(pa.int32())) for k in (1, 2)),
                    ],
                    [x.split()[0] for x in PAGE.split(", ")],
                )
                uid += n

    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")))
    return rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host")).mapInArrow(tidy(run), PAGE)


def templates(parsed: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Rows ``host``, ``mark``: subtrees on more than the limit of a host's distinct pages."""
    once = parsed.groupBy("host", "body").agg(F.min("uid").alias("uid"))
    hosts = once.groupBy("host").agg(F.count("*").alias("pages"))
    held = parsed.select("host", "uid", F.array_distinct("hashes").alias("own")).where(F.size("own") > 0).join(once.select("uid"), "uid", "left_semi")
    counts = held.select("host", F.explode("own").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") > least_pages)
    return counts.join(hosts, "host").where(F.col("n") > F.greatest(F.lit(float(least_pages)), F.col("pages") * least_share)).select("host", "mark")


def _without(rows: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """``page_id``, ``url``, ``kept`` (blocks), ``n_template``, ``n_rule`` of pages without their subtrees in ``known`` (sorted keys of host and hash), or else in the column ``drop``."""
    held = None if known is None else rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                blocks, hashes, firsts, ends = (b.column(i) for i in range(2, 6))
                per, n = pc.list_value_length(hashes).to_numpy(), pc.list_value_length(blocks).to_numpy()
                row, h = np.repeat(np.arange(b.num_rows), per), hashes.flatten().to_numpy()
                if held is None:
                    drop = [set(x or ()) for x in b.column(6).to_pylist()]
                    gone = np.fromiter((x in drop[r] for r, x in zip(row.tolist(), h.tolist())), bool, len(h))
                else:
                    key = template_key(b.column(6).to_numpy()[row], h)
                    gone = held.value[np.minimum(np.searchsorted(held.value, key), len(held.value) - 1)] == key
                begin = np.concatenate([[0], np.cumsum(n + 1)])  # one more place a page, where its last spans end
                step = np.zeros(begin[-1], np.int64)
                np.add.at(step, begin[row[gone]] + firsts.flatten().to_numpy()[gone], 1)
                np.add.at(step, begin[row[gone]] + ends.flatten().to_numpy()[gone], -1)
                inside = np.delete(np.cumsum(step) > 0, begin[1:] - 1)
                at, shown = np.repeat(np.arange(b.num_rows), n), blocks.flatten().is_valid().to_numpy(zero_copy_only=False)
                stays = shown & ~inside
                cuts = np.concatenate([[0], np.cumsum(np.bincount(at[stays], minlength=b.num_rows))]).astype(np.int32)
                kept = pa.ListArray.from_arrays(pa.array(cuts), blocks.flatten().filter(pa.array(stays)))
                counts = [pa.array(np.bincount(at[x], minlength=b.num_rows).astype(np.int64)) for x in (inside, ~shown & ~inside)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), kept, *counts], ["page_id", "url", "kept", "n_template", "n_rule"])

    some = rows.select("page_id", "url", "blocks", "hashes", "firsts", "ends", "host" if held else "drop")
    return some.mapInArrow(tidy(run), "page_id long, url string, kept array<string>, n_template long, n_rule long")


def template_key(host: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """One number for a host and a subtree's hash."""
    return mix(host.view(np.uint64) ^ mix(mark.view(np.uint64)))


def main_text(rows: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, most_templates: int = MOST_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars, n_template, n_rule (blocks deleted as template, and by rules alone) of every page.

    Up to ``most_templates`` frequent subtrees are sent to all tasks, which cut their
    pages where they lie; beyond that pages that hold some are joined with them.
    Both ways give the same rows.
    """
    parsed = cut(pages(rows), "pages")
    found = cut(templates(parsed, least_pages, least_share), "templates")
    n = found.count()
    if n and n <= most_templates:
        pairs = found.toPandas()
        out = _without(parsed, np.sort(template_key(pairs["host"].to_numpy(np.int64), pairs["mark"].to_numpy(np.int64))))
    else:
        own = parsed.select("uid", "host", F.explode(F.array_distinct("hashes")).alias("mark"))
        drop = cut(own.join(found, ["host", "mark"]).groupBy("uid").agg(F.collect_set("mark").alias("drop")), "drop")  # a page's own subtrees
        maybe, clear = split_by_keys(parsed, drop, "uid")
        shown = F.filter("blocks", lambda x: x.isNotNull())
        clear = clear.select("page_id", "url", shown.alias("kept"), F.lit(0).cast("long").alias("n_template"), (F.size("blocks") - F.size(shown)).cast("long").alias("n_rule"))
        out = _without(maybe.join(drop, "uid", "left")).unionByName(clear)
    text = F.array_join("kept", "\n")
    return out.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "n_template", "n_rule")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return main_text(read_table(spark, sf_dir, "pages"))
