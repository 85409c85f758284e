"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree. Its element nodes are chains of elements (tag, class, id and role), its
style nodes the sequences of children that an element has, its content nodes the blocks of text an element holds. Over
the host's pages, two entropies say how much a node varies, each between 0 (the same on all pages) and 1 (different on
each):

 - content: 1 - log_m(d) for a block of text that d of the m pages with its element have;
 - presentation: the entropy, to the base m, of the styles of an element.

A host has few pages at times, so each is drawn towards the same node's value over all hosts, which weighs as much as
one page does; that value in turn is drawn towards what holds for a node that is on one page only: its presentation
counts as unvaried, its content as varied.

A block stays if its importance is 0 or more: the log odds of its content's value, VARIED times how far the presentation
of the elements around it is from the middle, and the marks of its chain of elements. Marks are features of
presentation as well, known beforehand: an element that is made for something else than the article speaks against what
it holds (STRONG for navigation, footers, comments and the like, WEAK for adverts, notices and the like, where the tree
decides), one made for the article speaks for it; nearer elements count more, and a mark for does not outweigh a
nearer one against. So text that a template repeats on all pages goes even from within an article, and text that varies
as articles do stays even without any mark.

Pages count once for each different longest block, so that copies of an article don't make a template of it. Unclosed
and misnested elements end where their parent ends; text in scripts, styles, controls and hidden elements is none, within
a line as well: a marked part of a line is a block of its own.

Character references are decoded; white space within a block becomes one blank; blocks are joined by a blank. Null and
empty pages and tables give empty texts and tables; repeated rows give repeated results; other columns are ignored,
whatever their names; pages of null urls are those of one host. A page is parsed in memory that grows with its length,
however deep its elements lie.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small, join_counted

#: Weights in log odds: presentation, marks.
VARIED, STRONG, FORM, WEAK, ARTICLE, MAIN, NAMED = 1.5, -6.0, -3.5, -2.75, 2.0, 1.5, 1.0
#: The content's value is kept within these bounds, so that marks can outweigh it.
SURE = 0.05

# A quote has a meaning only after an equals sign; else it is a character of the tag like any other.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+"""
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?P=raw)\s*+>|\Z)"""
    rf"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>{_ATTRIBUTES})>|<[!?/][^>]*+(?:>|\Z)|<[a-z][^>]*+\Z""",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*+:\s*+none|aria-hidden\s*+=\s*+["']?true""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    (
        "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
        "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul"
    ).split()
)
#: Elements that end an open one of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl div section article main body html".split())

NO_TEXT = frozenset("head title button select textarea object".split())
STRONG_TAGS = frozenset("nav aside footer dialog menu".split())
STRONG_NAMES = frozenset(
    (
        "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer colophon contentinfo complementary related recommended recommendations comment "
        "comments disqus reply replies respond discussion login search pagination pager toolbar"
    ).split()
)
WEAK_NAMES = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
        "newsletter subscribe subscription signup popup modal overlay widget share sharing social legal copyright disclaimer masthead"
    ).split()
)
MAIN_NAMES = frozenset("article articlebody content entry main post story".split())
#: A name with one of these words says how something is or is laid out, not what it is.
STATES = frozenset("no not has have with without is open closed enabled disabled free hide hides layout wrapper wrap container page grid columns fixed sticky static loaded ready active visible".split())
#: A name that starts with one of these says what an article is about.
TOPICS = frozenset("category categories cat tag tags topic topics label keyword".split())

BITS = (1 << 64) - 1


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(n: int) -> int:
    return (n & BITS) - (1 << 63)


def _mark(tag: str, named: list[tuple[str, str]], attributes: str) -> float:
    """What an element says about its text: below 0 against an article, above 0 for one, 0 nothing."""
    if tag in ("html", "body"):
        return 0.0
    if tag in NO_TEXT or (attributes and HIDDEN.search(attributes)):
        return -math.inf
    words: set[str] = set()
    tokens = [[w.lower() for w in WORDS.findall(token)] for _, value in named for token in value.split()]
    # Where a name says in one word that it is the article, names of several words say what else is about it.
    plainly = any(len(t) == 1 and t[0] in MAIN_NAMES for t in tokens)
    for own in tokens:
        if own and not STATES.intersection(own) and not (len(own) > 1 and (own[0] in TOPICS or (plainly and (STRONG_NAMES | WEAK_NAMES).intersection(own)))):
            words.update(own)
    roles = {value.lower() for kind, value in named if kind == "role"}
    if tag in STRONG_TAGS or words & STRONG_NAMES:
        return STRONG
    if tag == "form":
        return FORM  # some hold a whole page
    if tag == "header" or words & WEAK_NAMES:
        return WEAK
    if tag == "article" or "articlebody" in {value.lower() for _, value in named}:
        return ARTICLE
    if tag == "main" or "main" in roles:
        return MAIN
    return NAMED if tag in ("div", "section", "td") and words & MAIN_NAMES else 0.0


class Page:
    """blocks: element, the element around it, text and the sum of marks. styles: for each element its children, as a
    number. Elements are numbers made from those of their parents, so that a deep page needs no more memory."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[int, int, str, float]] = []
        self.styles: dict[int, int] = {}
        # Of each open element: tag, number, the nearest block element and the one around it, marks, style so far.
        self.stack: list[list] = [["", 0, 0, 0, 0.0, 0]]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]
        self.text: list[str] = []
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.text.append(source[at : m.start()])
            at = m.end()
            tag = m.group("tag")
            if tag:
                tag = tag.lower()
                if tag in BLOCK:
                    self.flush()
                if m.group("end"):
                    self.close((tag,))
                else:
                    self.open(tag, m.group("attributes"))
        self.text.append(source[at:])
        self.flush()
        while len(self.stack) > 1:
            self.pop()

    def flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            self.text = []
            if text:
                _, _, block, around, marks, _ = self.stack[-1]
                if marks > -math.inf:
                    self.blocks.append((block, around, text, marks))

    def pop(self) -> None:
        if self.stack[-1][1] == self.stack[-1][2]:  # a block of its own, also one within a line
            self.flush()
        tag, number, block, _, marks, style = self.stack.pop()
        self.places[tag].pop()
        if tag in SCOPE:
            self.scopes.pop()
        if number == block and marks > -math.inf and tag not in ("html", "body"):
            self.styles[number] = (self.styles.get(number, 0) * 0x9E3779B97F4A7C15 + style + 1) & BITS

    def close(self, tags: tuple[str, ...], within: bool = False) -> None:
        """End the innermost open element of these; within: not beyond the innermost one that is a scope."""
        place = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        if place and not (within and place < self.scopes[-1]):
            while len(self.stack) > place:
                self.pop()

    def open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            return
        if tag in BLOCK and tag != "option":
            self.close(("p",), True)
        if tag in ENDS:
            self.close(ENDS[tag], True)
        named = [(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "") for m in NAMES.finditer(attributes)] if "=" in attributes else []
        label = _number(" ".join([tag, *(f"{kind}={value}" for kind, value in named)]))
        parent = self.stack[-1]
        _, above, block, around, marks, _ = parent
        parent[5] = (parent[5] * 0x9E3779B97F4A7C15 + label) & BITS
        own = _mark(tag, named, attributes)
        if tag == "header" and marks > 0:
            own = 0.0  # an article's own header
        if own < 0:
            marks = min(marks, 0.0) + own
        elif own > 0:
            marks = marks + own if marks <= 0 else max(marks, own)
        number = ((above ^ label) * 0xBF58476D1CE4E5B9 + label) & BITS
        number ^= number >> 31
        if tag in BLOCK:
            around, block = (0 if tag in ("html", "body") else block), number
        elif own < 0:  # part of a line that isn't the article's: a block of its own
            self.flush()
            around, block = block, number
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append([tag, number, block, around, marks, 0])

    def longest(self) -> int:
        """The number of the longest block, of those that nothing speaks against if there are any."""
        free = [b for b in self.blocks if b[3] >= 0] or self.blocks
        return _number(max((text for _, _, text, _ in free), key=lambda t: (len(t), t), default=""))


def _rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]+)", 1))
    key = F.xxhash64("page_id", "url", "html").alias("page")
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(F.coalesce(host, F.lit(""))).alias("host"), key)


NODES = "page long, host long, longest long, is_text boolean, element long, around long, value long, marks double"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, host, source in zip(*(b.column(c).to_pylist() for c in ("page", "host", "html"))):
            page = Page(source)
            longest = _signed(page.longest())
            seen = {(element, around, _number(text), marks) for element, around, text, marks in page.blocks}
            rows += [(key, host, longest, True, _signed(e), _signed(a), _signed(v), marks) for e, a, v, marks in seen]
            rows += [(key, host, longest, False, _signed(e), None, _signed(v), None) for e, v in page.styles.items()]
        cols = list(zip(*rows)) or [()] * 8
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["page", "host", "longest", "is_text", "element", "around", "value", "marks"])


def _drawn(own: Column, pages: Column, beyond: Column) -> Column:
    """A value seen over some pages, drawn towards what is known beyond them, which weighs as much as one page."""
    return (own * (pages - 1) + beyond) / pages


def style_tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged trees of all hosts, from the nodes of their pages: (host, element, presentation), and of the blocks
    (host, element, value, marks, rows, content, varied), where rows is the number of rows in nodes and varied the
    larger presentation of the element and of the one around it."""
    # Partly aggregated before each shuffle, so that a host with a third of all pages stays spread out.
    once = cut(nodes.groupBy("is_text", "host", "element", "value", "longest").agg(F.count("*").alias("rows"), F.first("around").alias("around"), F.first("marks").alias("marks")))

    def entropy(keys: list[str]) -> DataFrame:
        counts = once.filter("not is_text").select(*keys, "value", "longest").distinct().groupBy(*keys, "value").agg(F.count("*").alias("d"))
        by = counts.groupBy(*keys).agg(F.sum("d").alias("m"), F.sum(F.col("d") * F.ln("d")).alias("s"))
        return by.select(*keys, "m", F.when(F.col("m") > 1, (F.ln("m") - F.col("s") / F.col("m")) / F.ln("m")).otherwise(0.0).alias("h"))

    every = entropy(["element"]).select("element", _drawn(F.col("h"), F.col("m"), F.lit(0.0)).alias("h_all"))
    styles = entropy(["host", "element"]).join(every, "element")
    styles = cut(styles.select("host", "element", _drawn(F.col("h"), F.col("m"), F.col("h_all")).alias("presentation")))

    def pages(keys: list[str], name: str) -> DataFrame:
        return once.filter("is_text").select(*keys, "longest").distinct().groupBy(*keys).agg(F.count("*").alias(name))

    values = once.filter("is_text").groupBy("host", "element", "value").agg(F.count("*").alias("d"), F.sum("rows").alias("rows"), F.first("around").alias("around"), F.first("marks").alias("marks"))
    values = cut(values)
    varied = lambda d, m: F.when(F.col(m) > 1, 1 - F.ln(d) / F.ln(m)).otherwise(1.0)
    shared = pages(["element", "value"], "d_all").filter("d_all > 1").join(pages(["element"], "m_all"), "element")
    shared = shared.select("element", "value", "d_all", _drawn(varied("d_all", "m_all"), F.col("m_all"), F.lit(1.0)).alias("h_all"))
    # One row for each element with text, then one join with its blocks, of which an element may have very many.
    holders = values.groupBy("host", "element").agg(F.count("*").alias("n_values"), F.first("around").alias("around")).join(pages(["host", "element"], "m"), ["host", "element"])
    outer = styles.withColumnRenamed("element", "around").withColumnRenamed("presentation", "outer")
    holders = holders.join(styles, ["host", "element"], "left").join(outer, ["host", "around"], "left")
    holders = holders.select("host", "element", "n_values", "m", F.greatest(F.coalesce("presentation", F.lit(0.0)), F.coalesce("outer", F.lit(0.0))).alias("varied"))
    blocks = join_counted(values.drop("around"), holders, ["host", "element"], "n_values")
    blocks = join_counted(blocks, shared, ["element", "value"], "d_all", "left")
    content = _drawn(varied("d", "m"), F.col("m"), F.coalesce("h_all", F.lit(1.0)))
    return styles, blocks.select("host", "element", "value", "marks", "rows", content.alias("content"), "varied")


def importance(content: Column, presentation: Column, marks: Column) -> Column:
    held = F.least(F.greatest(content, F.lit(SURE)), F.lit(1 - SURE))
    return F.ln(held / (1 - held)) + VARIED * (presentation - 0.5) + marks


def _alone(marks: float) -> bool:
    """Whether a block would stay by its marks alone, its content varied and its presentation in the middle."""
    return math.log((1 - SURE) / SURE) + marks >= 0


def _block(element: int, value: int) -> int:
    return _signed(element * 0x94D049BB133111EB + value)


def decisions(nodes: DataFrame) -> DataFrame:
    """page and its blocks (as numbers) for which the tree decides otherwise than marks alone do. nodes has been cut."""
    _, blocks = style_tree(nodes)
    stays = importance(F.col("content"), F.col("varied"), F.col("marks")) >= 0
    alone = F.lit(math.log((1 - SURE) / SURE)) + F.col("marks") >= 0
    turned = blocks.filter(stays != alone).select("host", "element", "value", "rows")
    rows = nodes.filter("is_text").select("page", "host", "element", "value")
    met = join_counted(rows, turned, ["host", "element", "value"], "rows")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_block(e + (1 << 63), v + (1 << 63)) for e, v in zip(b.column("element").to_pylist(), b.column("value").to_pylist())]
            yield pa.record_batch([b.column("page"), pa.array(found, pa.int64())], ["page", "block"])

    return met.select("page", "element", "value").mapInArrow(number, "page long, block long").groupBy("page").agg(F.collect_set("block").alias("turned"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each page."""
    rows = _rows(pages)
    nodes = cut(rows.select("page", "host", "html").mapInArrow(_nodes, NODES))
    judged = rows.join(if_small(decisions(nodes)), "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for source, turned in zip(b.column("html").to_pylist(), b.column("turned").to_pylist()):
                other = frozenset(turned or ())
                out.append(" ".join(text for element, _, text, marks in Page(source).blocks if _alone(marks) != (bool(other) and _block(element, _number(text)) in other)))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return judged.select("page_id", "url", "html", "turned").mapInArrow(run, "page_id long, url string, text string, n_chars long")
