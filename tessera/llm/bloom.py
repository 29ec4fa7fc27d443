"""Blocked Bloom filters made and read with DataFrame functions only.

A filter is a table of 64-bit words (word, bits).  A key sets four bits of one word, so
that one equi-join and one mask test probe it.  The number of words is a parameter, a
power of two of at most 2^20: the table has at most so many rows of 16 bytes whatever the data, which
is the proven bound that lets it be broadcast.  A filter that is full only passes more rows
on to the exact step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18
MOST_WORDS = 1 << 20


def word_of(key: Column, words: int = WORDS) -> Column:
    """The word of a 64-bit key: its low bits."""
    return key.bitwiseAND(F.lit(words - 1).cast("long"))


def mask_of(key: Column) -> Column:
    """Four bits of the word, taken from the key's high bits."""
    bits = [F.shiftrightunsigned(key, s).bitwiseAND(F.lit(63).cast("long")) for s in (40, 46, 52, 58)]
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")) for b in bits]
    return masks[0].bitwiseOR(masks[1]).bitwiseOR(masks[2]).bitwiseOR(masks[3])


def build(patterns: DataFrame) -> DataFrame:
    """The filter's words from a table of (word, mask)."""
    return patterns.groupBy("word").agg(F.bit_or("mask").alias("bits"))


def probe(rows: DataFrame, key: str, filter_words: DataFrame, words: int, hit: str) -> DataFrame:
    """Adds the boolean column `hit`: whether the filter may hold the row's key."""
    if not 0 < words <= MOST_WORDS or words & (words - 1):
        raise ValueError(f"words must be a power of two up to {MOST_WORDS}")
    held = filter_words.select(
        F.col("word").alias("__bloom_word"), F.col("bits").alias("__bloom_bits")
    )
    mask = mask_of(F.col(key))
    return (
        rows.join(F.broadcast(held), word_of(F.col(key), words) == F.col("__bloom_word"), "left")
        .withColumn(
            hit, F.coalesce(F.col("__bloom_bits").bitwiseAND(mask) == mask, F.lit(False))
        )
        .drop("__bloom_word", "__bloom_bits")
    )
