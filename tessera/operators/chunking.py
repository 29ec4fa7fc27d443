"""Documents to deterministic, content-addressed chunks.

The work on one document stays in one row and in the JVM: no shuffle.  The text
is cut into *tiles*, strings that together cover the text without gaps, so an
offset is a running sum of tile lengths.  The packing fold then runs over small
structs (lengths and counts) and the text is sliced once per chunk at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# --- fixed values -----------------------------------------------------------
TARGET_TOKENS = 700
OVERLAP_TOKENS = 100
PAGE_MARKER = ("[Page ", "]")
PAGED_TYPE = "pdf"
# ----------------------------------------------------------------------------

# A block with the white space before it; blocks end at an empty line.
BLOCK_TILE = rf"{T.WS}*+{T.NON_WS}(?:[^\n]++|\n(?!{T.WS}*\n))*+"
HEADING = rf"\A{T.WS}*#{{1,6}}{T.BLANK}+({T.NON_WS}{T.NON_BREAK}*)"

# Ids built from (document_id, ordinal): 2^28 chunks over a document's life, 2^35 documents.
CHUNK_ORDINALS = 1 << 28

_DRAFT = (
    "struct<start:int,end:int,tokens:int,section:string,page:int,"
    "segments:array<struct<start:int,tokens:int>>>"
)


def check_settings(target_tokens: int, overlap_tokens: int) -> None:
    if target_tokens <= 0:
        raise ValueError("target_tokens must be positive")
    if not 0 <= overlap_tokens < target_tokens:
        raise ValueError("overlap_tokens must be between 0 and target_tokens - 1")


def chunk_id_of(document_id: Column, ordinal: Column) -> Column:
    """Collision-free chunk id; fails rather than wrap into the next document."""
    return F.when(
        ordinal < CHUNK_ORDINALS, document_id * CHUNK_ORDINALS + ordinal
    ).otherwise(F.raise_error(F.lit("document has too many chunk ordinals")).cast("long"))


def chunk_documents(
    doc: DataFrame,
    target_tokens: int = TARGET_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per chunk of `doc` (document_id, text[, title, doc_type, pages]).

    Columns named in `keep` are carried onto the chunks, which spares a later
    join back to the documents.
    """
    check_settings(target_tokens, overlap_tokens)
    title = F.col("title") if "title" in doc.columns else F.lit(None).cast("string")
    base = ("document_id", "text", *(F.col(c).alias(f"kept_{c}") for c in keep))
    carried = ("document_id", "text", *(f"kept_{c}" for c in keep))
    staged = doc.select(*base, _segments(doc, title, target_tokens).alias("segments"))
    packed = staged.select(*carried, _pack(F.col("segments"), target_tokens).alias("packed"))
    drafts = packed.select(*carried, _close(F.col("packed")).alias("drafts")).select(
        *carried, _merge_orphan(F.col("drafts"), target_tokens).alias("drafts")
    )
    chunks = drafts.select(
        "document_id",
        *carried[2:],
        F.inline(_emit(F.col("text"), F.col("drafts"), overlap_tokens)),
    )
    return chunks.select(
        chunk_id_of(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        "document_id",
        "chunk_index",
        T.stable_chunk_id(
            F.col("document_id"),
            F.col("start_offset"),
            F.col("end_offset"),
            F.col("page_number"),
            F.col("text"),
        ).alias("stable_id"),
        "section_title",
        "page_number",
        "start_offset",
        "end_offset",
        "text",
        T.token_estimate(F.col("text")).alias("token_estimate"),
        *(F.col(f"kept_{c}").alias(c) for c in keep),
    )


# Segments -------------------------------------------------------------------


def _segments(doc: DataFrame, title: Column, target_tokens: int) -> Column:
    text = F.col("text")
    plain = F.transform(
        F.regexp_extract_all(text, F.lit(BLOCK_TILE), F.lit(0)),
        lambda b: _block(b, _heading(b), F.lit(None).cast("int")),
    )
    none = F.array().cast("array<struct<tile:string,heading:string,page:int>>")
    blocks = plain
    if "pages" in doc.columns:
        paged = (F.col("doc_type") == PAGED_TYPE) & (F.size("pages") > 0)
        blocks = F.when(paged, _page_blocks(F.col("pages"))).otherwise(plain)
    # Every text but a blank one has a block.  Named once: each mention would be evaluated.
    blocks = F.transform(F.coalesce(blocks, none), _sized)
    # Blocks above the target are cut at every `target_tokens`-th word.
    piece = rf"(?:{T.WS}*+{T.WORD}){{1,{target_tokens}}}+(?:{T.WS}++\z)?"

    def cut(block: Column) -> Column:
        def measure(p: Column, i: Column) -> Column:
            tokens = F.least(F.lit(target_tokens), block["tokens"] - i * target_tokens)
            return _measure(_trimmed(p), tokens, F.when(i == 0, block["heading"]), block["page"])

        whole = F.array(_measure(block["trimmed"], block["tokens"], block["heading"], block["page"]))
        pieces = F.regexp_extract_all(block["trimmed"]["tile"], F.lit(piece), F.lit(0))
        return F.when(block["tokens"] <= target_tokens, whole).otherwise(F.transform(pieces, measure))

    return F.flatten(F.transform(blocks, cut))


def _block(tile: Column, heading: Column, page: Column) -> Column:
    return F.struct(tile.alias("tile"), heading.alias("heading"), page.alias("page"))


def _heading(block: Column) -> Column:
    found = F.regexp_extract(block, HEADING, 1)
    return F.get(F.filter(F.array(T.strip(found)), lambda h: h != ""), F.lit(0))


def _page_blocks(pages: Column) -> Column:
    """Per page its marker, then its paragraphs; no section titles."""
    none = F.lit(None).cast("string")
    opening, closing = PAGE_MARKER

    def blocks(page: Column, i: Column) -> Column:
        gap = F.when(i > 0, "\n\n").otherwise("")
        number = page["page_number"]
        marker = F.concat(gap, F.lit(opening), number.cast("string"), F.lit(closing))
        body = F.regexp_extract_all(
            F.concat(F.lit("\n"), page["text"]), F.lit(BLOCK_TILE), F.lit(0)
        )
        return F.concat(
            F.array(_block(marker, none, number)),
            F.transform(body, lambda b: _block(b, none, number)),
        )

    return F.flatten(F.transform(pages, blocks))


def _trimmed(tile: Column) -> Column:
    """A tile, without its white space at the end, and without any at its ends.

    The lambda's variable is evaluated once, not once per mention.
    """
    ends = F.array(F.rtrim(tile, F.lit(T.SPACE_CHARS)))
    return F.get(
        F.transform(
            ends,
            lambda e: F.struct(
                tile.alias("tile"), e.alias("head"), F.ltrim(e, F.lit(T.SPACE_CHARS)).alias("bare")
            ),
        ),
        F.lit(0),
    )


def _sized(block: Column) -> Column:
    """A block with its trimmed tile and the number of its words."""
    sized = F.transform(
        F.array(_trimmed(block["tile"])),
        lambda t: F.struct(
            t.alias("trimmed"),
            F.size(F.split(t["bare"], f"{T.WS}+")).alias("tokens"),
            block["heading"].alias("heading"),
            block["page"].alias("page"),
        ),
    )
    return F.get(sized, F.lit(0))


def _measure(trimmed: Column, tokens: Column, heading: Column, page: Column) -> Column:
    def measured(t: Column) -> Column:
        size, head = F.length(t["tile"]), F.length(t["head"])
        return F.struct(
            size.alias("size"),
            (head - F.length(t["bare"])).alias("lead"),
            (size - head).alias("trail"),
            tokens.alias("tokens"),
            heading.alias("heading"),
            page.alias("page"),
        )

    return F.get(F.transform(F.array(trimmed), measured), F.lit(0))


# Packing --------------------------------------------------------------------


def _pack(segments: Column, target_tokens: int) -> Column:
    """Greedy fold; the open draft is kept apart so only flushes grow the list."""
    floor = max(2, target_tokens // 2)
    zero = F.struct(
        F.lit(0).alias("pos"),
        F.lit(None).cast("string").alias("section"),
        F.lit(None).cast(_DRAFT).alias("open"),
        F.array().cast(f"array<{_DRAFT}>").alias("done"),
    )

    def step(acc: Column, seg: Column) -> Column:
        section = F.coalesce(seg["heading"], acc["section"])
        start = acc["pos"] + seg["lead"]
        end = acc["pos"] + seg["size"] - seg["trail"]
        mark = F.array(F.struct(start.alias("start"), seg["tokens"].alias("tokens")))
        cur = acc["open"]
        new_page = F.coalesce(cur["page"] != seg["page"], F.lit(False))
        new_section = ~cur["section"].eqNullSafe(section)
        too_long = cur["tokens"] + seg["tokens"] > target_tokens
        flush = cur.isNotNull() & (
            new_page | ((new_section | too_long) & (cur["tokens"] >= floor))
        )
        opened = F.struct(
            start.alias("start"),
            end.alias("end"),
            seg["tokens"].alias("tokens"),
            section.alias("section"),
            seg["page"].alias("page"),
            mark.alias("segments"),
        )
        grown = F.struct(
            cur["start"].alias("start"),
            end.alias("end"),
            (cur["tokens"] + seg["tokens"]).alias("tokens"),
            F.coalesce(cur["section"], section).alias("section"),
            F.coalesce(cur["page"], seg["page"]).alias("page"),
            F.concat(cur["segments"], mark).alias("segments"),
        )
        return F.struct(
            (acc["pos"] + seg["size"]).alias("pos"),
            section.alias("section"),
            F.when(cur.isNull() | flush, opened).otherwise(grown).alias("open"),
            F.when(flush, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(segments, zero, step)


def _close(packed: Column) -> Column:
    return F.when(
        packed["open"].isNotNull(), F.concat(packed["done"], F.array(packed["open"]))
    ).otherwise(packed["done"])


def _merge_orphan(drafts: Column, target_tokens: int) -> Column:
    """A tiny last draft joins the one before it when both lie on one page."""
    orphan = max(1, target_tokens // 5)
    last, previous = F.get(drafts, F.size(drafts) - 1), F.get(drafts, F.size(drafts) - 2)
    merged = F.struct(
        previous["start"].alias("start"),
        last["end"].alias("end"),
        (previous["tokens"] + last["tokens"]).alias("tokens"),
        previous["section"].alias("section"),
        previous["page"].alias("page"),
        F.concat(previous["segments"], last["segments"]).alias("segments"),
    )
    joins = (
        (F.size(drafts) > 1)
        & (last["tokens"] <= orphan)
        & previous["page"].eqNullSafe(last["page"])
        & (previous["tokens"] + last["tokens"] <= target_tokens + orphan)
    )
    return F.when(
        joins, F.concat(F.slice(drafts, F.lit(1), F.size(drafts) - 2), F.array(merged))
    ).otherwise(drafts)


def _tail_start(segments: Column, overlap_tokens: int) -> Column:
    """Start of the shortest run of last segments that holds `overlap_tokens`."""
    zero = F.struct(F.lit(0).alias("tokens"), F.lit(None).cast("int").alias("start"))
    return F.aggregate(
        F.reverse(segments),
        zero,
        lambda acc, s: F.when(acc["tokens"] >= overlap_tokens, acc).otherwise(
            F.struct((acc["tokens"] + s["tokens"]).alias("tokens"), s["start"].alias("start"))
        ),
        lambda acc: acc["start"],
    )


def _emit(text: Column, drafts: Column, overlap_tokens: int) -> Column:
    def chunk(draft: Column, i: Column) -> Column:
        start = draft["start"]
        if overlap_tokens > 0:
            before = F.get(drafts, i - 1)
            shared = (
                (i > 0)
                & before["page"].eqNullSafe(draft["page"])
                & before["section"].eqNullSafe(draft["section"])
            )
            start = F.when(shared, _tail_start(before["segments"], overlap_tokens)).otherwise(start)
        return F.struct(
            i.alias("chunk_index"),
            draft["section"].alias("section_title"),
            draft["page"].alias("page_number"),
            start.alias("start_offset"),
            draft["end"].alias("end_offset"),
            F.substring(text, start + 1, draft["end"] - start).alias("text"),
        )

    return F.transform(drafts, chunk)
