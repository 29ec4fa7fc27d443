"""Main text of web pages by template deduction over the pages of a host.

A page is cut into tokens: each structural element by its path of tags and classes, and
each text node by its path and content; a path is a digest of its parent's digest and the
element's own label.  The occurrence vector of a token says how often every page of the
host holds it; tokens that share a vector are an equivalence class.  Vectors are compared
by their support and by a sum of page hashes times counts, which tasks combine before
anything is shuffled, so that no page and no host is gathered anywhere.

Every class of elements and texts that `SUPPORT` pages hold, which are not all copies of one
page, is a candidate, whatever the size of the host and however often it stands on a page.
Classes nest by their paths: a text is template where an enclosing element is of its class
and every such element of the page holds it once; so a layout that only some pages of a
host have gets a template of its own.  The order of a class's tokens is not compared.

The text of a page is all its text that is no template, in blocks in page order: character
references decoded, white space made one space, boilerplate elements left out: those of
boilerplate tags, and outside of article and main those with a boilerplate class or id that
enclose no article nor, on a page without text in one, half of its text.

Defined results: null or empty html, and pages without such text, give ''; a null
URL is a host of its own (''); null page ids stay null and repeated rows give repeated
rows; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import over_batches
from tessera.llm.urls import split_url
from tessera.session import hint_small, materialize

SUPPORT = 3  # pages that hold a class: fewer are no evidence
BROADCAST = 400_000  # tokens (16 bytes each) up to which the templates are broadcast

RAW = ("script", "style", "textarea", "title", "noscript", "template")
SKIPPED = frozenset(
    "head nav header footer aside form script style noscript template title button select option "
    "textarea iframe svg object canvas dialog".split()
)
CONTAINERS = frozenset("html body main article section div table tbody tr td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption th thead tfoot "
    "caption address hr fieldset details summary".split()
) | SKIPPED
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Whole class names and ids of boilerplate: no-sidebar, entry-header or comments-open are none.
_CHROME = re.compile(
    r"(?<!\S)(?:ads?|advert\w*|banner|nav|navbar|navigation|menu|sidebar|footer|header|breadcrumbs?|comments?|"
    r"share|social|related|promo\w*|sponsor\w*|newsletter|subscribe|cookies?|notices?|popup|modal|"
    r"login|signup|widget)(?!\S)",
    re.I,
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S
)
_NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An open element: its tag, path digest and parent, whether its or an ancestor's tag is boilerplate,
    and the outermost element from here up that is named as boilerplate."""

    __slots__ = ("tag", "key", "parent", "skipped", "header", "named", "content")

    def __init__(self, tag: str, key: int, parent: Node | None, skipped: bool, header: bool):
        self.tag, self.key, self.parent, self.skipped, self.header = tag, key, parent, skipped, header
        self.named = parent.named if parent else None
        self.content = tag in ("article", "main") or bool(parent and parent.content)


def _key(parent: int, label: str) -> int:
    """A signed 64-bit digest."""
    return xxhash.xxh3_64_intdigest(f"{parent}\x00{label}") - (1 << 63)


def _open(tag: str, attributes: str, parent: Node) -> Node:
    names = " ".join("".join(m) for m in _NAMES.findall(attributes)) if attributes else ""
    label = f"{tag}.{_DIGITS.sub('#', names.strip())}" if names else tag
    in_article = parent.tag in ("article", "main") or parent.header
    header = tag == "header" and in_article or parent.header
    skipped = parent.skipped or (tag in SKIPPED and not header)
    node = Node(tag, _key(parent.key, label), parent, skipped, header)
    # No name drops an article, what is in it, or the page.
    if names and not node.named and not node.content and tag not in ("html", "body") and _CHROME.search(names):
        node.named = node
    return node


def parse(page: str) -> Iterator[tuple]:
    """Events in page order: ('open', node), ('text', node, text), ('break', node)."""
    stack = [Node("", 0, None, False, False)]
    at, raw = 0, None
    n = len(page)
    while at < n:
        if raw:
            end = re.compile(rf"</{raw}", re.I).search(page, at)
            stop = end.start() if end else n
            yield "text", stack[-1], page[at:stop]
            at, raw = stop, None
            continue
        m = _TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            yield "text", stack[-1], page[at:stop]
        if not m:
            break
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if tag == "br":
            yield "text", stack[-1], " "
        elif tag not in BLOCKS:
            continue
        elif m.group(1):
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            yield "break", stack[-1]
            if depth:
                del stack[depth:]
        else:
            yield "break", stack[-1]
            for same in ("p", *HEADINGS):  # a block ends an open paragraph or heading
                if stack[-1].tag == same:
                    stack.pop()
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1].tag == tag:
                stack.pop()
            node = _open(tag, m.group(3), stack[-1])
            yield "open", node
            if tag not in VOID and not m.group(0).endswith("/>"):
                stack.append(node)
                if tag in RAW:
                    raw = tag
    yield "break", stack[-1]


def clean(parts: list[str]) -> str:
    return _SPACE.sub(" ", entities.unescape("".join(parts))).strip()


def blocks(page: str, opened: dict[int, int] | None = None) -> Iterator[tuple[Node, str]]:
    """The blocks of text with the element that holds each; counts elements by key in `opened`."""
    parts: list[str] = []
    owner = None
    for event in parse(page):
        if event[0] == "text":
            owner = owner or event[1]
            parts.append(event[2])
        elif event[0] == "open":
            if opened is not None and not event[1].skipped:
                opened[event[1].key] += 1
        elif parts:
            text = clean(parts)
            if text:
                yield owner, text
            parts, owner = [], None


def _text_key(node: Node, text: str) -> int:
    return _key(node.key, f"\x00{text}")


def token_counts(pages: DataFrame) -> DataFrame:
    """(host, token, element, n_pages, n, high, low) of tokens that `SUPPORT` pages hold, not all copies:
    `high` and `low` sum the halves of page hash x count."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[tuple[str, int], list[int]] = {}
        columns = [batch.column(i).to_pylist() for i in range(2)]
        for host, page in zip(*columns, strict=True):
            key = xxhash.xxh3_64_intdigest(page)
            elements: dict[int, int] = defaultdict(int)
            texts: dict[int, int] = defaultdict(int)
            for node, text in blocks(page, elements):
                if not node.skipped:
                    texts[_text_key(node, text)] += 1
            for element, count in ((1, elements), (0, texts)):
                for token, n in count.items():
                    row = total.setdefault((host, token), [element, 0, 0, 0, key, key])
                    row[1] += 1
                    row[2] += n
                    row[3] = (row[3] + key * n) & 0xFFFFFFFFFFFFFFFF
                    row[4], row[5] = min(row[4], key), max(row[5], key)
        keys = list(total)
        values = np.array(list(total.values()), np.uint64).reshape(-1, 6).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
             *(pa.array(values[:, i].copy()) for i in range(6))],
            ["host", "token", "element", "n_pages", "n", "vector", "least", "most"],
        )

    # Vectors wrap around at 64 bits: their high and low halves are summed apart.
    high = F.sum(F.shiftrightunsigned("vector", 32)).alias("high")
    low = F.sum(F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")
    differ = (F.min("least") != F.max("least")) | F.bool_or(F.col("least") != F.col("most"))
    return (
        over_batches(
            pages, work,
            "host string, token long, element long, n_pages long, n long, vector long, least long, most long",
        )
        .groupBy("host", "token")
        .agg(F.max("element").alias("element"), F.sum("n_pages").alias("n_pages"), F.sum("n").alias("n"),
             high, low, differ.alias("differ"))
        .where((F.col("n_pages") >= SUPPORT) & F.col("differ"))
        .drop("differ")
    )


def templates(tokens: DataFrame) -> DataFrame:
    """(host, elements, texts): tokens with their class, of the classes that hold both."""
    vector = F.xxhash64("n_pages", "n", "high", "low")
    classed = materialize(tokens.select("host", "token", "element", vector.alias("class")))
    both = classed.groupBy("host", "class").agg(F.min("element").alias("a"), F.max("element").alias("b")).where("a < b")
    pair = F.struct("token", "class")
    return (
        classed.join(both.select("host", "class"), ["host", "class"])
        .groupBy("host")
        .agg(F.collect_list(F.when(F.col("element") == 1, pair)).alias("elements"),
             F.collect_list(F.when(F.col("element") == 0, pair)).alias("texts"))
    )


def enclosing(kept: list[tuple[Node, str]]) -> set[Node]:
    """Elements named as boilerplate whose name does not count: they enclose an article or, on a page
    without text in one, half of the text."""
    articles = [node for node, _ in kept if node.content]
    if articles:
        return {node.named for node in articles if node.named}
    chars: dict[Node, int] = defaultdict(int)
    for node, text in kept:
        if node.named:
            chars[node.named] += len(text)
    total = sum(len(text) for _, text in kept)
    return {named for named, n in chars.items() if 2 * n >= total}


def main_text(page: str, elements: Iterable[tuple[int, int]], texts: Iterable[tuple[int, int]]) -> str:
    """The blocks that are no template; `elements` and `texts` are the host's tokens with their class."""
    elements, texts = dict(elements), dict(texts)
    found = [(node, text) for node, text in blocks(page) if not node.skipped]
    owners: dict[int, list[Node]] = defaultdict(list)
    for node, text in found:
        key = _text_key(node, text) if texts else None
        if key in texts:
            owner = node
            while owner and elements.get(owner.key) != texts[key]:
                owner = owner.parent
            owners[key].append(owner)
    # Nested: each element of the class holds the text once.
    template = {k for k, held in owners.items() if None not in held and len({id(o) for o in held}) == len(held)}
    kept = [
        (node, text)
        for node, text in found
        if (not node.header or node.tag in HEADINGS) and not (template and _text_key(node, text) in template)
    ]
    slots = enclosing(kept)
    return "\n".join(text for node, text in kept if not node.named or node.named in slots)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    url = F.col("url").cast("string")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        split_url(url)[0].alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    own = materialize(templates(token_counts(rows.select("host", "html"))))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages, elements, texts = (batch.column(i).to_pylist() for i in (2, 3, 4))
        pairs = [[[(t["token"], t["class"]) for t in row or ()] for row in column] for column in (elements, texts)]
        found = [main_text(*row) for row in zip(pages, *pairs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"]
        )

    size = own.agg(F.sum(F.size("elements") + F.size("texts"))).first()[0] or 0
    placed = rows.join(hint_small(own, size <= BROADCAST), "host", "left")
    return over_batches(
        placed.select("page_id", "url", "html", "elements", "texts"), work, "page_id long, url string, text string"
    )
