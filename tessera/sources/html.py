"""Web pages to documents: chrome removed, headings marked, text nodes joined."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions import text as T

# --- fixed values -----------------------------------------------------------
DROPPED_TAGS = {"script", "style", "nav", "header", "footer", "aside", "form", "button"}
CHROME = re.compile(
    r"(nav|menu|sidebar|footer|header|breadcrumb|cookie|share|social|pager)", re.IGNORECASE
)
ROOT_TAGS = {"main", "article"}
REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9A-Fa-f]+;)([A-Za-z0-9]*;?)")
# ----------------------------------------------------------------------------

HEADINGS = {f"h{n}": n for n in range(1, 7)}
VOID_TAGS = set("area base br col embed hr img input link meta source track wbr".split())
# Start tags that end an open element of the same group.
SELF_CLOSING = ({"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"})
ENDS_PARAGRAPH = set(
    "p div ul ol dl table form section article aside header footer main nav blockquote pre hr "
    "h1 h2 h3 h4 h5 h6 address figure fieldset".split()
)


class _Page(HTMLParser):
    """One pass over a page; keeps the text nodes of the body and of the content root."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.buffer: list[str] = []
        self.body: list[str] = []
        self.everything: list[str] = []
        self.root: list[str] = []
        self.root_found = self.body_dropped = False
        self.title: list[str] | None = None
        self.first_heading: list[str] | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        self.flush()
        if tag in ENDS_PARAGRAPH:
            self._end_open({"p"}, barrier={"table", "td", "th", "button"})
        for group in SELF_CLOSING:
            if tag in group:
                self._end_open(group, barrier={"ul", "ol", "dl", "table", "select"})
        if tag in VOID_TAGS:
            return
        above = self.stack[-1] if self.stack else {}
        values = dict(attrs)
        dropped = (
            above.get("dropped", False)
            or tag in DROPPED_TAGS
            or any(CHROME.search(values.get(a) or "") for a in ("class", "id"))
        )
        self.body_dropped |= tag == "body" and dropped
        is_root = tag in ROOT_TAGS and not dropped and not self.root_found
        self.root_found |= is_root
        node = {
            "tag": tag,
            "dropped": dropped,
            "in_root": above.get("in_root", False) or is_root,
            "in_head": above.get("in_head", False) or tag in ("head", "title"),
            "texts": [] if tag in HEADINGS or tag == "title" else None,
        }
        if tag == "body":
            node["in_head"] = False
        self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(node["tag"] == tag for node in self.stack):
            self._end_open({tag}, barrier=set())

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    def _end_open(self, tags: set[str], barrier: set[str]) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth]["tag"] in tags:
                self.flush()
                while len(self.stack) > depth:
                    self._close(self.stack.pop())
                return
            if self.stack[depth]["tag"] in barrier:
                return

    def _close(self, node: dict) -> None:
        if node["tag"] == "title":
            if self.title is None and not node["dropped"]:
                self.title = node["texts"]
        elif node["tag"] in HEADINGS:
            if self.first_heading is None and HEADINGS[node["tag"]] <= 2:
                self.first_heading = node["texts"]
            text = " ".join(node["texts"])
            self._emit(f"{'#' * HEADINGS[node['tag']]} {text}".strip(), node)

    def flush(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer.clear()
        if not text:
            return
        heading = None
        for node in reversed(self.stack):
            if node["texts"] is not None:
                node["texts"].append(text)
                heading = heading or (node["tag"] in HEADINGS)
        if not heading:
            self._emit(text, self.stack[-1] if self.stack else {})

    def _emit(self, text: str, node: dict) -> None:
        if node.get("dropped"):
            return
        self.everything.append(text)
        if not node.get("in_head"):
            self.body.append(text)
        if node.get("in_root"):
            self.root.append(text)

    def parts(self) -> tuple[str, str | None, str | None]:
        self.flush()
        while self.stack:
            self._close(self.stack.pop())
        nodes = self.everything if self.body_dropped else self.body
        title = " ".join(self.title) if self.title else None
        heading = " ".join(self.first_heading) if self.first_heading else None
        return "\n".join(self.root if self.root_found else nodes), title, heading


def _closed_only(html: str) -> str:
    """The page with every `&` that begins no reference ended by a semicolon made a plain one."""

    def shown(found: re.Match) -> str:
        name = found.group(1)
        return found.group() if name[-1:] == ";" and name in html5 else f"&amp;{name}"

    return REFERENCE.sub(shown, html)


def _parse(html: str, unclosed: bool = True) -> tuple[str, str | None, str | None]:
    page = _Page()
    page.feed(html if unclosed else _closed_only(html))
    page.close()
    return page.parts()


_PARTS = StructType([StructField(n, StringType()) for n in ("text", "title", "heading")])


def _parts_of(html: pd.Series, unclosed: bool) -> pd.DataFrame:
    rows = [_parse(h, unclosed) if isinstance(h, str) else (None, None, None) for h in html]
    return pd.DataFrame(rows, columns=["text", "title", "heading"])


@F.pandas_udf(_PARTS)
def html_parts(html: pd.Series) -> pd.DataFrame:
    """Joined text nodes, the title element and the first h1/h2 of each page."""
    return _parts_of(html, True)


@F.pandas_udf(_PARTS)
def html_parts_closed(html: pd.Series) -> pd.DataFrame:
    """The same, where a character reference without its semicolon is plain text."""
    return _parts_of(html, False)


def extract_html(
    pages: DataFrame, document_id: str, source_path: str, html: str, unclosed: bool = True
) -> DataFrame:
    """Page table -> documents (document_id, source_path, title, doc_type, text).

    Character references that lack their semicolon are decoded as browsers do, unless `unclosed`
    is false.
    """
    parts = html_parts if unclosed else html_parts_closed
    parsed = pages.select(
        F.col(document_id).cast("long").alias("document_id"),
        F.col(source_path).alias("source_path"),
        parts(F.col(html)).alias("html"),
    ).select(
        "document_id",
        "source_path",
        T.normalize_text(F.col("html.text")).alias("text"),
        T.strip(F.col("html.title")).alias("title_tag"),
        T.normalize_text(F.col("html.heading")).alias("heading"),
    )
    stem = T.source_stem(T.source_name(F.col("source_path")))
    title = F.coalesce(
        F.nullif("title_tag", F.lit("")),
        F.nullif("heading", F.lit("")),
        T.title_from_first_line(F.col("text"), stem),
    )
    return parsed.select(
        "document_id", "source_path", title.alias("title"), F.lit("html").alias("doc_type"), "text"
    )
