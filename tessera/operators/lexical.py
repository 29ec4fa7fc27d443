"""BM25 search of a table of queries over a LexicalIndex."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.index import (
    SEGMENT_DOCUMENTS,
    LexicalIndex,
    fetch_chunks,
    field_weight,
    segment_of,
    token_bucket,
)
from tessera.session import BROADCAST_ROWS, CANDIDATE_ROWS, fits, hint_small, materialize

# --- fixed values -----------------------------------------------------------
EXACT_TITLE_BONUS = 25.0
EXACT_SOURCE_NAME_BONUS = 20.0
PHRASE_MATCH_BONUS = 8.0
FETCH_MULTIPLIER = 5
MIN_TERM_COVERAGE = 1.0
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
# ----------------------------------------------------------------------------

# Scores are added as whole numbers of 1e-13, so that the sum does not depend on
# the order of its terms and equal texts tie exactly.
SCORE_UNIT = 1e13
# Rows of single words' postings, over all queries, that are read without looking for bounds;
# and the share of them that bounds must save to be worth the look-ups.
READ_WHOLE = 50_000_000
WORTH = 0.5
# Rows of single words' postings from which queries may share the words they have in common,
# and a word's least part of them to be shared.
SHARE_FROM = 5_000_000
SHARED_PART = 0.001


def parse_queries(q: DataFrame) -> DataFrame:
    """Adds phrases, terms, the normalised query and whether it can be searched."""
    parsed = q.select(
        "query_id",
        "query_text",
        T.query_phrases(F.col("query_text")).alias("phrases"),
        T.query_terms(F.col("query_text")).alias("terms"),
        T.normalize_search_text(F.col("query_text")).alias("normalized_query"),
    )
    return parsed.withColumn("is_searchable", F.size("phrases") + F.size("terms") > 0)


def match_clauses(parsed: DataFrame) -> DataFrame:
    """(query_id, phrase, times): what a query looks for; any of them may match.

    A string given both as a phrase and as a term counts twice.
    """
    return (
        parsed.select("query_id", F.explode(F.concat("phrases", "terms")).alias("phrase"))
        .groupBy("query_id", "phrase")
        .agg(F.count("*").alias("times"))
    )


@dataclass(frozen=True)
class QueryShape:
    """What is known about a query table before its search is planned."""

    small: bool  # its clauses may be broadcast
    phrases: bool  # it holds clauses of several words
    queries: int = 0  # searchable queries, when small


def query_shape(q: DataFrame, max_clauses: int = BROADCAST_ROWS) -> QueryShape:
    """Counts the clauses, but no further than the broadcast bound."""
    seen = match_clauses(parse_queries(q)).limit(max_clauses + 1)
    row = seen.agg(
        F.count("*").alias("n"),
        F.bool_or(F.contains("phrase", F.lit(" "))).alias("phrases"),
        F.count_distinct("query_id").alias("queries"),
    ).first()
    small = row["n"] <= max_clauses
    return QueryShape(small, bool(row["phrases"]) or not small, row["queries"])


def phrase_hits(index: LexicalIndex, phrases: DataFrame, shape: QueryShape) -> DataFrame:
    """(phrase, chunk_id, hits, chunk_tokens); `hits` are weighted by field.

    With a broadcast phrase table the only shuffle is by chunk, which spreads
    common words evenly and also serves the per-chunk sums that follow.
    """
    single = _found(
        index.postings,
        phrases.filter(~F.contains("phrase", F.lit(" "))).select(
            "phrase", F.col("phrase").alias("token")
        ),
        ["token"],
        shape,
    ).select("phrase", "chunk_id", "field", "chunk_tokens")
    if not shape.phrases:
        return _weigh(single)
    # Phrases are looked up by pairs of neighbours, far rarer than single words;
    # a phrase occurs where all its pairs meet at one anchor.
    words = F.split("phrase", " ")
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(words) - 2),
        lambda i: F.struct(
            i.alias("offset"),
            F.get(words, i).alias("token"),
            F.get(words, i + 1).alias("next_token"),
        ),
    )
    wanted = phrases.filter(F.contains("phrase", F.lit(" "))).select(
        "phrase", F.size(pairs).alias("pairs"), F.inline(pairs)
    )
    several = (
        _found(index.postings, wanted, ["token", "next_token"], shape)
        .groupBy(
            "chunk_id",
            "phrase",
            "field",
            (F.col("position") - F.col("offset")).alias("anchor"),
            "pairs",
            "chunk_tokens",
        )
        .agg(F.count("*").alias("met"))
        .filter("met = pairs")
        .select("phrase", "chunk_id", "field", "chunk_tokens")
    )
    return _weigh(single.unionByName(several))


def _found(
    postings: DataFrame, wanted: DataFrame, keys: list[str], shape: QueryShape
) -> DataFrame:
    """Occurrences of the wanted tokens; the bucket prunes stored postings."""
    wanted = wanted.withColumn("bucket", token_bucket(F.col("token")))
    found = postings.join(hint_small(wanted, shape.small), ["bucket", *keys])
    return found.repartition("chunk_id") if shape.small else found


def _weigh(found: DataFrame) -> DataFrame:
    return found.groupBy("chunk_id", "phrase", "chunk_tokens").agg(
        F.sum(field_weight(F.col("field"))).alias("hits")
    )


def idf(chunk_count: Column, matching: Column) -> Column:
    value = F.log((chunk_count - matching + 0.5) / (matching + 0.5))
    return F.when(value <= 0, F.lit(IDF_FLOOR)).otherwise(value)


def phrase_counts(
    index: LexicalIndex, phrases: DataFrame, shape: QueryShape, hits: DataFrame | None = None
) -> DataFrame:
    """(phrase, chunk_count): single words from the vocabulary, others by their hits."""
    single = phrases.withColumnRenamed("phrase", "token")
    counts = index.vocabulary.join(hint_small(single, shape.small), "token").select(
        F.col("token").alias("phrase"), "chunk_count"
    )
    if not shape.phrases:
        return counts
    if hits is None:
        hits = phrase_hits(index, phrases, shape)
    several = hits.filter(F.contains("phrase", F.lit(" ")))
    return counts.unionByName(several.groupBy("phrase").agg(F.count("*").alias("chunk_count")))


def bm25_scores(index: LexicalIndex, clauses: DataFrame, shape: QueryShape) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that holds any clause."""
    phrases = clauses.select("phrase").distinct()
    hits = phrase_hits(index, phrases, shape)
    if shape.phrases:
        # Counted and scored: found once, then read from the stored rows.
        hits = materialize(hits)
    counts = phrase_counts(index, phrases, shape, hits)
    total = index.stats.select("chunk_count").scalar()
    average = index.stats.select("average_tokens").scalar()
    weighted = clauses.join(counts, "phrase").select(
        "query_id", "phrase", (F.col("times") * idf(total, F.col("chunk_count"))).alias("weight")
    )
    part = F.floor(F.col("weight") * saturation(F.col("hits"), F.col("chunk_tokens"), average) * SCORE_UNIT)
    return (
        hits.join(hint_small(weighted, shape.small), "phrase")
        .groupBy("query_id", "chunk_id")
        .agg(F.sum(part).alias("units"))
        .select("query_id", "chunk_id", (F.col("units") / SCORE_UNIT).alias("score"))
    )


def saturation(hits: Column, tokens: Column, average: Column) -> Column:
    """Grows with the hits and falls with the length of the chunk."""
    length_norm = BM25_K1 * (1 - BM25_B + BM25_B * tokens / average)
    return hits * (BM25_K1 + 1) / (hits + length_norm)


def best_scores(index: LexicalIndex, clauses: DataFrame, k: int, shape: QueryShape) -> DataFrame:
    """(query_id, chunk_id, score) that hold the `k` best chunks of each query, exactly scored.

    Upper bounds leave out most of the common words' postings.  Each query's rarest clauses,
    those with the first k postings or so, give k chunks a part of their score; the k-th of
    these is a score t that the k best all reach.  Of the words, taken from the least they can
    add to any chunk, as many as add up to less than t are *optional*: a chunk that holds
    nothing else can't be among the best.  So only the other clauses' postings are read for
    candidates; a candidate whose score with all optional words at their greatest stays
    below t goes, and the optional words are looked up in the segments of those left.  Where
    there is little to read, or little to save as in very long queries, all words' blocks are
    read and added up; the scores are the same.

    Where many queries have the same common words, these are added up once for all of them,
    see `_shared_scores`.
    """
    phrases = clauses.select("phrase").distinct()
    several = F.contains("phrase", F.lit(" "))
    hits = None
    if shape.phrases:
        hits = materialize(phrase_hits(index, phrases.filter(several), shape))
    stored = index.blocks  # where tables are stored when first read, the counts come from these
    counts = phrase_counts(index, phrases, shape, hits)
    total = index.stats.select("chunk_count").scalar()
    average = index.stats.select("average_tokens").scalar()
    weight = F.col("times") * idf(total, F.col("chunk_count"))
    weighted = materialize(
        clauses.join(counts, "phrase").select("query_id", "phrase", "times", "chunk_count", weight.alias("weight"))
    )

    def units(hits: Column, tokens: Column) -> Column:
        return F.floor(F.col("weight") * saturation(hits, tokens, average) * SCORE_UNIT)

    words = weighted.filter(~several).withColumn("token", F.col("phrase")).withColumn("bucket", token_bucket(F.col("phrase")))

    def added(wanted: DataFrame, phrases: bool = True) -> DataFrame:
        """(query_id, chunk_id, units) of the wanted words and, if asked for, of all phrases."""
        blocks = stored.select("bucket", "token", "segment", "entries")
        wanted = wanted.select("query_id", "token", "bucket", "weight")
        if shape.small:
            # Each wanted block is shuffled once, by segment, however many queries ask for it;
            # the sums below need no further shuffle.
            tokens = F.broadcast(wanted.select("bucket", "token").distinct())
            blocks = blocks.join(tokens, ["bucket", "token"], "left_semi").repartition("segment")
        found = (
            blocks.join(hint_small(wanted, shape.small), ["bucket", "token"])
            .select("segment", "query_id", "weight", F.inline("entries"))
            .groupBy("segment", "query_id", "chunk_id")
            .agg(F.sum(units(F.col("hits"), F.col("chunk_tokens"))).alias("units"))
            .select("query_id", "chunk_id", "units")
        )
        if not phrases or hits is None:
            return found
        matched = hits.join(hint_small(weighted.filter(several), shape.small), "phrase")
        found = found.unionByName(
            matched.select("query_id", "chunk_id", units(F.col("hits"), F.col("chunk_tokens")).alias("units"))
        )
        return found.groupBy("query_id", "chunk_id").agg(F.sum("units").alias("units"))

    whole = words.agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]
    if whole > SHARE_FROM:
        shared = _shared_scores(words, added, whole, k, shape)
        if shared is not None:
            return _scored(shared)
    if whole <= READ_WHOLE:
        return _scored(added(words))

    # The most that a word adds anywhere, from the blocks' bounds alone.
    tokens = words.select("bucket", "token").distinct()
    most = saturation(F.max("max_hits"), F.min("min_tokens"), average)
    tops = (
        stored.select("bucket", "token", "max_hits", "min_tokens")
        .join(hint_small(tokens, shape.small), ["bucket", "token"])
        .groupBy("token").agg(most.alias("top"))
    )
    rare = Window.partitionBy("query_id").orderBy("chunk_count", "phrase").rowsBetween(Window.unboundedPreceding, -1)
    words = materialize(
        words.join(hint_small(tops, shape.small), "token")
        .withColumn("most", F.floor(F.col("weight") * F.col("top") * SCORE_UNIT) + 1)
        .withColumn("rarer", F.coalesce(F.sum("chunk_count").over(rare), F.lit(0)))
    )
    first = top_k(added(words.filter(F.col("rarer") < k)), k, ["query_id"], [F.desc("units"), F.asc("chunk_id")], "place")
    reached = first.filter(F.col("place") == k).select("query_id", F.col("units").alias("reached"))
    least = Window.partitionBy("query_id").orderBy("most", "phrase").rowsBetween(Window.unboundedPreceding, 0)
    words = materialize(
        words.join(hint_small(reached, shape.small), "query_id", "left")
        .withColumn("reached", F.coalesce("reached", F.lit(0)))
        .withColumn("up_to", F.sum("most").over(least))
    )
    optional, needed = words.filter("up_to < reached"), words.filter("up_to >= reached")
    saved = optional.agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]
    if saved < WORTH * whole:
        return _scored(added(words))
    rest = optional.groupBy("query_id").agg(F.sum("most").alias("rest"), F.max("reached").alias("reached"))
    candidates = materialize(
        added(needed)
        .join(hint_small(rest, shape.small), "query_id", "left")
        .filter("reached IS NULL OR units + rest >= reached")
        .select("query_id", "chunk_id", "units")
    )
    optional = optional.select("query_id", "token", "bucket", "weight")
    # A look-up goes through a block of some SEGMENT_DOCUMENTS entries.
    each = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    look_ups = optional.join(hint_small(each, shape.small), "query_id").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if look_ups * SEGMENT_DOCUMENTS > saved:
        found = added(words)
        if fits(candidates, CANDIDATE_ROWS):
            found = found.join(F.broadcast(candidates.select("query_id", "chunk_id")), ["query_id", "chunk_id"], "left_semi")
        return _scored(found)
    wanted = candidates.select("query_id", "chunk_id", segment_of(F.col("chunk_id")).alias("segment")).join(
        hint_small(optional, shape.small), "query_id"
    )
    # Few of them prune the stored blocks by their buckets.
    few = shape.small and fits(wanted, CANDIDATE_ROWS)
    looked_up = (
        stored.select("bucket", "token", "segment", "entries")
        .join(hint_small(wanted, few), ["bucket", "token", "segment"])
        .select("query_id", "chunk_id", "weight",
                F.get(F.filter("entries", lambda e: e["chunk_id"] == F.col("chunk_id")), F.lit(0)).alias("e"))
        .filter("e IS NOT NULL")
        .select("query_id", "chunk_id", units(F.col("e.hits"), F.col("e.chunk_tokens")).alias("units"))
    )
    found = candidates.unionByName(looked_up)
    return _scored(found.groupBy("query_id", "chunk_id").agg(F.sum("units").alias("units")))


def _shared_scores(
    words: DataFrame, added: Callable[..., DataFrame], whole: int, k: int, shape: QueryShape
) -> DataFrame | None:
    """(query_id, chunk_id, units) that hold the `k` best chunks of each query; None if the
    queries share too little.

    Words that make up much of what would be read, over all queries, are *shared*.  A query's
    shared words are its group; the group's sums over all chunks are made once.  A chunk with
    none of the query's other clauses has the group's sum, so it is among the best only if it
    is among the group's k best; the chunks of the other clauses get the group's sum added.
    """
    much = words.groupBy("token", "times").agg((F.sum("chunk_count") >= SHARED_PART * whole).alias("much"))
    words = materialize(words.join(hint_small(much, shape.small), ["token", "times"]))
    each = materialize(
        words.filter("much").groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("token", "times"))).alias("words"), F.sum("chunk_count").alias("rows"))
    )
    groups = materialize(each.groupBy("words").agg(F.min("query_id").alias("group_id"), F.min("rows").alias("rows")))
    size = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    own = words.filter(~F.col("much"))
    rest = own.agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]
    if not size.n or size.rows + rest > WORTH * whole:
        return None
    few = size.n * k <= BROADCAST_ROWS
    named = materialize(each.join(hint_small(groups.select("words", "group_id"), few), "words").select("query_id", "group_id"))
    first = groups.select(F.col("group_id").alias("query_id"))
    sums = materialize(added(words.filter("much").join(hint_small(first, few), "query_id", "left_semi"), phrases=False))
    best = top_k(sums, k, ["query_id"], [F.desc("units"), F.asc("chunk_id")], "place")
    best = materialize(best.select(F.col("query_id").alias("group_id"), "chunk_id", "units"))
    own = materialize(added(own))
    in_group = sums.select(F.col("query_id").alias("group_id"), "chunk_id", F.col("units").alias("more"))
    lifted = (
        own.join(hint_small(named, shape.small), "query_id", "left")
        .join(in_group, ["group_id", "chunk_id"], "left")
        .select("query_id", "chunk_id", (F.col("units") + F.coalesce("more", F.lit(0))).alias("units"))
    )
    others = (
        named.join(hint_small(best, few), "group_id").select("query_id", "chunk_id", "units")
        .join(own.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    )
    return lifted.unionByName(others)


def _scored(units: DataFrame) -> DataFrame:
    return units.select("query_id", "chunk_id", (F.col("units") / SCORE_UNIT).alias("score"))


def top_k(df: DataFrame, k: int, keys: list[str], order: list[Column], rank: str) -> DataFrame:
    """First `k` rows per key; each task keeps k rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def bm25_candidates(
    q: DataFrame, index: LexicalIndex, limit: int, shape: QueryShape
) -> DataFrame:
    clauses = match_clauses(parse_queries(q))
    fetched = max(limit, limit * FETCH_MULTIPLIER)
    return top_k(
        best_scores(index, clauses, fetched, shape),
        fetched,
        ["query_id"],
        [F.desc("score"), F.asc("chunk_id")],
        "candidate_rank",
    )


def lexical_search(
    q: DataFrame, index: LexicalIndex, limit: int = 8, shape: QueryShape | None = None
) -> DataFrame:
    """Ranked chunks per query of `q` (query_id, query_text).

    The first 5 x limit chunks by BM25 are kept when the title or file name is
    the query, a phrase occurs, or every term occurs; then bonuses are added.
    """
    shape = shape or query_shape(q)
    return judge_candidates(q, bm25_candidates(q, index, limit, shape), index.chunks, limit, shape)


def judge_candidates(
    q: DataFrame, candidates: DataFrame, chunks: DataFrame, limit: int, shape: QueryShape
) -> DataFrame:
    """The second half of `lexical_search`: candidates against their texts, ranked."""
    # A searchable query has at most 5 x limit candidates.
    small = shape.small and shape.queries * FETCH_MULTIPLIER * limit <= CANDIDATE_ROWS
    parsed = parse_queries(q).select("query_id", "phrases", "terms", "normalized_query")
    # Candidates and queries are bounded by the query count, the chunks are not.
    rows = fetch_chunks(chunks, candidates, small).join(hint_small(parsed, small), "query_id")
    text = T.haystack(*(F.col(c) for c in ("title", "source_name", "section_title", "text")))
    judged = (
        rows.withColumn(
            "exact_title_match", T.exact_title_match(F.col("title"), F.col("normalized_query"))
        )
        .withColumn(
            "exact_source_name_match",
            T.exact_source_name_match(F.col("source_name"), F.col("normalized_query")),
        )
        .withColumn("coverage", T.query_coverage(F.col("phrases"), F.col("terms"), text))
        .withColumn("phrase_match", F.col("coverage.phrase_match"))
        .withColumn("term_coverage", F.col("coverage.term_coverage"))
    )
    kept = judged.filter(
        F.col("exact_title_match")
        | F.col("exact_source_name_match")
        | F.col("phrase_match")
        | (F.col("term_coverage") >= MIN_TERM_COVERAGE)
    )
    bonus = sum(
        (
            F.when(F.col(flag), F.lit(value)).otherwise(F.lit(0.0))
            for flag, value in (
                ("exact_title_match", EXACT_TITLE_BONUS),
                ("exact_source_name_match", EXACT_SOURCE_NAME_BONUS),
                ("phrase_match", PHRASE_MATCH_BONUS),
            )
        ),
        F.lit(0.0),
    )
    order = [
        F.desc("lexical_score"),
        F.desc("exact_title_match"),
        F.desc("exact_source_name_match"),
        F.desc("phrase_match"),
        F.asc("chunk_id"),
    ]
    scored = kept.withColumn("lexical_score", F.col("score") + bonus)
    return top_k(scored, limit, ["query_id"], order, "lexical_rank").select(
        "query_id",
        "chunk_id",
        "document_id",
        "chunk_index",
        "stable_id",
        "source_path",
        "source_name",
        "title",
        "section_title",
        "page_number",
        T.excerpt(F.col("text")).alias("chunk_text_excerpt"),
        F.col("text").alias("chunk_text"),
        "embedding_model",
        "embedding_dim",
        "exact_title_match",
        "exact_source_name_match",
        "phrase_match",
        "lexical_score",
        "lexical_rank",
    )
