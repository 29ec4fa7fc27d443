"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

Texts are equal when identical without white space.  Pass one counts the Bloom patterns of
all text hashes (two numbers a row, combined in each task first); patterns met twice make
the filter of possibly repeated hashes.  Pass two probes each row: a row the filter does not
pass has no equal and goes straight through; only the others are shuffled, by the SHA-256
of their text, and grouped exactly.  Of equal texts the row with the most code points in
the original text stays, then the smallest doc_id.

Defined results: a null text counts as empty, so null and blank texts equal each other; a
null doc_id loses ties against any other; rows that repeat both doc_id and text are one
document given twice: all of them are listed as kept, and `distinct_documents` returns one
of them; extra columns of any name pass through `distinct_documents` untouched; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.common import text_or_empty
from tessera.session import materialize

SPACE = " \t\n\v\f\r"
HEAVY = 1_000


def normalised(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def repeated_filter(hashes: DataFrame, words: int = bloom.WORDS) -> DataFrame:
    """Filter of the hashes (one long column, `hash`) whose pattern occurs more than once."""
    patterns = hashes.select(
        bloom.word_of(F.col("hash"), words).alias("word"), bloom.mask_of(F.col("hash")).alias("mask")
    )
    twice = patterns.groupBy("word", "mask").agg(F.count("*").alias("n")).where("n > 1")
    return bloom.build(twice)


def list_duplicates(docs: DataFrame, words: int = bloom.WORDS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are read and hashed once, into a narrow table; both passes run over that.
    """
    text = text_or_empty()
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
            "doc_id",
            F.length("text").alias("n_chars"),
            F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
        )
    ).withColumn("hash", F.xxhash64("text_sha256"))
    seen = bloom.probe(rows, "hash", repeated_filter(rows.select("hash"), words), words, "again")
    alone = seen.where(~F.col("again")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    again = seen.where("again").select("doc_id", "n_chars", "text_sha256")
    groups = materialize(
        again.groupBy("text_sha256").agg(
            F.max(F.struct("n_chars", (-F.col("doc_id")).alias("id"))).alias("best"),
            F.count("*").alias("group_size"),
        )
    )
    # At most HEAVY groups hold more than 1 / HEAVY of the rows each: that bounds the broadcast,
    # and leaves no key that could fill a task for the shuffled join.
    heavy = F.col("group_size") * HEAVY > F.lit(rows.count())
    large = F.broadcast(groups.where(heavy))
    grouped = (
        again.join(large, "text_sha256")
        .unionByName(
            again.join(large, "text_sha256", "left_anti").join(groups.where(~heavy), "text_sha256")
        )
        .select(
            "doc_id",
            (-F.col("best.id")).alias("keep_id"),
            "group_size",
            (
                F.col("doc_id").eqNullSafe(-F.col("best.id"))
                & (F.col("n_chars") == F.col("best.n_chars"))
            ).alias("kept"),
            "text_sha256",
        )
    )
    return alone.unionByName(grouped)


def distinct_documents(docs: DataFrame, words: int = bloom.WORDS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    packed = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        text_or_empty().alias("text"),
    ).select("row", "id", F.length("text").alias("n_chars"), normalised(F.col("text")).alias("key"))
    hashed = packed.withColumn("hash", F.xxhash64("key"))
    again = bloom.probe(hashed, "hash", repeated_filter(hashed.select("hash"), words), words, "again")
    alone = again.where(~F.col("again")).select("row.*")
    # Each task keeps the best row of every group it meets before anything is shuffled.
    best = (
        again.where("again")
        .groupBy(F.sha2("key", 256).alias("sha"))
        .agg(F.max_by("row", F.struct("n_chars", (-F.col("id")).alias("id"))).alias("row"))
        .select("row.*")
    )
    return alone.unionByName(best)
