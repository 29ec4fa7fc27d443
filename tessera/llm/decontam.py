"""Benchmark decontamination with a positional inverted index, DataFrame functions only.

The index stores the postings (document, position, term) of every training token whose
term some benchmark item uses; terms are 64-bit hashes, so a posting has a fixed width.  A
window is ten consecutive item words (a shorter item is one window).  For each window the
two terms that the index holds fewest postings of are looked up; their positions minus
their offsets in the item are diagonals, and a diagonal on which both lists meet is a
candidate.  Only candidates are compared word by word with the document's text, which
settles what hash collisions or the other words of a window leave open.

`exact_matches` marks the words inside any occurrence of a window; `proximity_matches`
finds items whose rarest terms stand within a short stretch in any order.

Defined results: a null text has no words; documents without words are clean; an item with
no words or a null id is ignored, and items that repeat an id count as one; a null doc_id
stays null and repeated rows give repeated rows; extra columns of any name are not read by
the index and pass through `clean_documents`; empty tables give empty or clean results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, text_or_empty
from tessera.session import hint_small, materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
# Rows of fixed width (at most 40 bytes) up to which a table of the benchmark's or of
# candidates is broadcast; a larger one is joined by a shuffle.
SMALL_ROWS = 400_000
KEY = ("k_doc", "k_text")


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the pair that identifies a row by its id and text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")
    ).select(
        "*", F.coalesce("doc_id", F.lit(0)).alias("k_doc"), F.xxhash64("doc_id", "text").alias("k_text")
    )


def _small(df: DataFrame) -> bool:
    return df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


@dataclass(frozen=True)
class Items:
    """item_id, words and terms (hashes) of the benchmark's items that have words."""

    table: DataFrame

    @classmethod
    def of(cls, benchmark: DataFrame) -> Items:
        words = benchmark.select(
            F.col("item_id").cast("long").alias("item_id"), words_of(text_or_empty()).alias("words")
        ).where(F.col("item_id").isNotNull() & (F.size("words") > 0))
        return cls(
            materialize(
                words.distinct().select(
                    "item_id",
                    F.xxhash64("words").alias("version"),
                    "words",
                    F.transform("words", lambda w: F.xxhash64(w)).alias("terms"),
                )
            )
        )

    def offsets(self) -> DataFrame:
        return self.table.select("item_id", "version", F.posexplode("terms").alias("offset", "term"))


@dataclass(frozen=True)
class Index:
    """`postings`: k_doc, k_text, pos, term; `rows`: doc_id, k_doc, k_text, n_words per document."""

    postings: DataFrame
    rows: DataFrame


def build_index(docs: DataFrame, items: Items) -> Index:
    """Stores the postings of the items' terms; one pass over the texts, no shuffle of words."""
    terms = items.offsets().select("term").distinct().withColumn("used", F.lit(True))
    exploded = _keyed(docs).select("doc_id", *KEY, words_of(F.col("text")).alias("words")).select(
        "doc_id", *KEY, F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word")
    )
    stored = materialize(
        exploded.withColumn("term", F.xxhash64("word"))
        .join(hint_small(terms, _small(terms)), "term", "left")
        # The first position is kept for every document: it carries the word count.
        .where("used OR pos = 0 OR pos IS NULL")
        .select("doc_id", *KEY, "n_words", "pos", "term", F.coalesce("used", F.lit(False)).alias("used"))
    )
    rows = stored.where("pos = 0 OR pos IS NULL").select("doc_id", *KEY, "n_words")
    return Index(stored.where("used").select(*KEY, "pos", "term"), rows)


def _anchors(items: Items, frequency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two rarest offsets of every window: (item, version, term, offset) and the pairs of each item."""
    counted = items.offsets().join(hint_small(frequency, _small(frequency)), "term", "left").fillna(0, ["n"])
    sized = counted.join(
        items.table.select("item_id", "version", F.size("terms").alias("size")), ["item_id", "version"]
    )
    # Offset o lies in the windows that start at o - 9 .. o, as far as the item has them.
    last = F.greatest(F.col("size") - WINDOW, F.lit(0))
    starts = F.sequence(F.greatest(F.col("offset") - (WINDOW - 1), F.lit(0)), F.least(F.col("offset"), last))
    inside = sized.select("item_id", "version", "term", "offset", "n", F.explode(starts).alias("start"))
    rarest = (
        inside.groupBy("item_id", "version", "start")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))), 1, 2).alias("rare"))
        # A window with a term that never occurs cannot occur.
        .where(F.col("rare")[0]["n"] > 0)
    )
    pairs = rarest.groupBy("item_id", "version").agg(
        F.collect_set(F.transform("rare", lambda r: r["offset"])).alias("pairs")
    )
    anchors = rarest.select("item_id", "version", F.explode("rare").alias("r")).select(
        "item_id", "version", "r.term", "r.offset"
    ).distinct()
    return anchors, pairs


def candidates(index: Index, items: Items) -> DataFrame:
    """(document key, item, diagonal) where the two rarest terms of some window meet."""
    frequency = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    anchors, pairs = map(materialize, _anchors(items, frequency))
    met = index.postings.join(hint_small(anchors, _small(anchors)), "term").select(
        *KEY, "item_id", "version", (F.col("pos") - F.col("offset")).alias("diagonal"), "offset"
    )
    # Offsets of an item are bounded by its length, so a group is small whatever the corpus.
    grouped = met.groupBy(*KEY, "item_id", "version", "diagonal").agg(
        F.collect_set("offset").alias("offsets")
    )
    both = F.exists("pairs", lambda pair: F.forall(pair, lambda o: F.array_contains("offsets", o)))
    return grouped.join(hint_small(pairs, _small(pairs)), ["item_id", "version"]).where(both).select(
        *KEY, "item_id", "version", "diagonal"
    )


def exact_matches(docs: DataFrame, items: Items, index: Index) -> DataFrame:
    """Per contaminated document: its key, the hit positions and the ids of the items."""
    found = materialize(candidates(index, items))
    small = _small(found)
    texts = _keyed(docs).select(*KEY, "text")
    if not small:
        texts = texts.join(found.select(*KEY).distinct(), list(KEY), "left_semi")
    aligned = (
        texts.join(hint_small(found, small), list(KEY))
        .select(*KEY, "item_id", "version", "diagonal", words_of(F.col("text")).alias("doc_words"))
        .join(
            hint_small(items.table.select("item_id", "version", "words"), _small(items.offsets())),
            ["item_id", "version"],
        )
    )
    # The stretch of the document that faces the item; words before or after its ends are null.
    facing = F.transform(
        "words", lambda w, i: F.coalesce(F.get("doc_words", F.col("diagonal") + i) == w, F.lit(False))
    )
    length = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("words") - length),
        lambda s: F.forall(F.slice("same", s + 1, length), lambda x: x),
    )
    hits = F.flatten(
        F.transform("starts", lambda s: F.sequence(F.col("diagonal") + s, F.col("diagonal") + s + length - 1))
    )
    return (
        aligned.withColumn("same", facing)
        .withColumn("starts", starts)
        .where(F.size("starts") > 0)
        .select(*KEY, "item_id", F.array_distinct(hits).alias("hits"))
        .groupBy(*KEY)
        .agg(
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.collect_set("item_id").alias("items"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (ids as sorted strings), contaminated."""
    items = Items.of(benchmark)
    index = build_index(docs, items)
    matches = exact_matches(docs, items, index)
    none = F.array().cast("array<string>")
    return index.rows.join(matches, list(KEY), "left").select(
        "doc_id",
        F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_sort(F.col("items").cast("array<string>")), none).alias("items"),
        F.col("hits").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a hit word, with all their columns."""
    items = Items.of(benchmark)
    dirty = materialize(exact_matches(docs, items, build_index(docs, items)).select(*KEY))
    packed = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k_doc"),
        F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()).alias("k_text"),
    )
    return packed.join(hint_small(dirty, _small(dirty)), list(KEY), "left_anti").select("row.*")


def proximity_matches(index: Index, items: Items, n_terms: int = 4, reach: int = 60) -> DataFrame:
    """(document key, item): the item's rarest terms all stand within `reach` words, in any order."""
    frequency = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("item_id", "version").orderBy("n", "term")
    rarest = (
        items.offsets()
        .select("item_id", "version", "term")
        .distinct()
        .join(hint_small(frequency, _small(frequency)), "term", "left")
        .fillna(0, ["n"])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n_terms)
    )
    whole = Window.partitionBy("item_id", "version")
    rarest = materialize(
        rarest.withColumn("wanted", F.count("*").over(whole)).select("item_id", "version", "term", "wanted")
    )
    # Stretches overlap by half, so that any stretch of `reach` words lies inside one of two.
    cell = F.floor(F.col("pos") / reach)
    near = (
        index.postings.join(hint_small(rarest, _small(rarest)), "term")
        .select(*KEY, "item_id", "version", "wanted", "pos", "term", F.explode(F.array(cell, cell - 1)).alias("cell"))
        .groupBy(*KEY, "item_id", "version", "wanted", "cell")
        .agg(F.collect_set(F.struct("pos", "term")).alias("at"))
    )
    within = F.exists(
        "at",
        lambda a: F.size(
            F.array_distinct(
                F.transform(
                    F.filter("at", lambda b: (b["pos"] >= a["pos"]) & (b["pos"] < a["pos"] + reach)),
                    lambda b: b["term"],
                )
            )
        )
        == F.col("wanted"),
    )
    return near.where(within).select(*KEY, "item_id").distinct()


def near_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_near, near_items (ids as sorted strings) of the items `proximity_matches` finds."""
    items = Items.of(benchmark)
    index = build_index(docs, items)
    near = proximity_matches(index, items).groupBy(*KEY).agg(F.collect_set("item_id").alias("near"))
    none = F.array().cast("array<string>")
    return index.rows.join(near, list(KEY), "left").select(
        "doc_id",
        F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_sort(F.col("near").cast("array<string>")), none).alias("near_items"),
    )
