"""DuckDB SQL for the registered queries, over the same tables.

Statements are put together from named CTEs, so that a search statement reads
documents -> chunks -> tokens -> scores like the query it checks.
"""

from __future__ import annotations

from catalog.corpus import LETTERS, MODEL
from catalog.queries import RESPONSES
from tessera.functions.text import accent_table
from tessera.operators import answers as A
from tessera.operators import evaluation as E
from tessera.operators import runlog as R

_SPACES = (
    r"\t-\r\x1c- \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS, NON_WS = f"[{_SPACES}]", f"[^{_SPACES}]"
BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
ACCENTED, PLAIN = accent_table()


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+', '')"


def normalize(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t]+\\n', chr(10), 'g')"
    return strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def search_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NON_WS}+'))"


def first_line_title(x: str, fallback: str) -> str:
    line = strip(f"trim({strip('l')}, '#')")
    lines = f"list_transform(regexp_split_to_array({x}, '{BREAK}'), lambda l: {line})"
    return f"coalesce(left(list_filter({lines}, lambda l: l <> '')[1], 160), {fallback})"


def tokens(x: str) -> str:
    folded = f"translate(lower(coalesce({x}, '')), {quote(ACCENTED)}, {quote(PLAIN)})"
    split = rf"regexp_split_to_array({folded}, '[^\p{{L}}\p{{N}}\p{{Co}}]+')"
    return f"list_filter({split}, lambda t: t <> '')"


def excerpt(x: str) -> str:
    return f"CASE WHEN length({x}) <= 240 THEN {x} ELSE left({x}, 240) || '...' END"


def stable_id(doc: str, start: str, end: str, page: str, text: str) -> str:
    return (
        f"sha256({doc} || chr(31) || {start} || chr(31) || {end} || chr(31) || "
        f"coalesce({page}, -1) || chr(31) || {text})"
    )


def statement(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select if ctes else select


PATH = "source || '/doc_' || doc_id || '.txt'"
DOCS = f"""docs AS MATERIALIZED (
  SELECT *, {first_line_title('text', "'doc_' || document_id")} AS title FROM (
    SELECT doc_id AS document_id, {PATH} AS source_path, lang, {normalize('text')} AS text
    FROM documents))"""


def chunk_ctes(name: str, source: str) -> list[str]:
    """Fixed windows: these texts have no empty lines, so each is one block."""
    return [
        f"""{name}_spans AS (
  SELECT *, CASE WHEN i = 0 THEN 0 ELSE 700 * (i - 1) END AS a,
    CASE WHEN i = k - 1 THEN n ELSE 700 * (i + 1) END AS b
  FROM (SELECT *, unnest(range(k)) AS i FROM (
    SELECT *, CASE WHEN pieces > 1 AND n - 700 * (pieces - 1) <= 140 THEN pieces - 1 ELSE pieces END
      AS k
    FROM (SELECT *, len(tiles) AS n, (len(tiles) + 699) // 700 AS pieces FROM (
      SELECT *, regexp_extract_all(text, '{WS}*{NON_WS}+') AS tiles FROM {source})))))""",
        f"""{name} AS MATERIALIZED (
  SELECT *, {stable_id('document_id', 'start_offset', 'end_offset', 'NULL', 'text')} AS stable_id
  FROM (SELECT document_id * 268435456 + i AS chunk_id, document_id, i AS chunk_index,
      source_path, regexp_extract(source_path, '[^/]+$') AS source_name, title,
      {lstrip("array_to_string(tiles[a + 1:b], '')")} AS text,
      length(array_to_string(tiles[1:a], '')) + length(tiles[a + 1])
        - length({lstrip('tiles[a + 1]')}) AS start_offset,
      length(array_to_string(tiles[1:b], '')) AS end_offset, b - a AS token_estimate
    FROM {name}_spans))""",
    ]


CHUNKS = [DOCS, *chunk_ctes("chunks", "docs")]
TOKENS = [
    *CHUNKS,
    f"""fields AS (
  SELECT chunk_id, 0 AS field, 12e0 AS w, {tokens('title')} AS toks FROM chunks
  UNION ALL SELECT chunk_id, 1, 8e0, {tokens('source_path')} FROM chunks
  UNION ALL SELECT chunk_id, 3, 1e0, {tokens('text')} FROM chunks)""",
    """occ AS MATERIALIZED (
  SELECT chunk_id, field, w, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM fields)""",
    "lens AS MATERIALIZED (SELECT chunk_id, count(*) AS n FROM occ GROUP BY chunk_id)",
    """corpus AS (SELECT (SELECT count(*) FROM chunks) AS total,
  (SELECT count(*) FROM occ)::DOUBLE / (SELECT count(*) FROM chunks) AS average)""",
]
BENCHMARK = "q AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"
PART = r"""'"([^"]+)"|([A-Za-z0-9][A-Za-z0-9._:-]*)'"""


def parts(group: int) -> str:
    every = f"regexp_extract_all(query_text, {PART}, {group})"
    normed = f"list_transform({every}, lambda p: {search_norm('p')})"
    kept = f"list_filter({normed}, lambda p: p <> '')"
    # list_distinct does not keep the order; keep first positions instead.
    return f"list_filter({kept}, lambda p, i: list_position({kept}, p) = i)"


PARSED = f"""parsed AS MATERIALIZED (
  SELECT query_id, query_text, {parts(1)} AS phrases, {parts(2)} AS terms,
    {search_norm('query_text')} AS normalized_query FROM q)"""
CLAUSES = [
    PARSED,
    """clauses AS MATERIALIZED (
  SELECT query_id, phrase, count(*) AS times
  FROM (SELECT query_id, unnest(list_concat(phrases, terms)) AS phrase FROM parsed)
  GROUP BY ALL)""",
]
BM25 = [
    *CLAUSES,
    """wanted AS (
  SELECT phrase, len(toks) AS size, unnest(toks) AS token, unnest(range(len(toks))) AS place
  FROM (SELECT phrase, string_split(phrase, ' ') AS toks
    FROM (SELECT DISTINCT phrase FROM clauses)))""",
    """hits AS MATERIALIZED (
  SELECT phrase, chunk_id, sum(w) AS f
  FROM (SELECT phrase, chunk_id, field, w, pos - place AS anchor, size, count(*) AS met
    FROM occ JOIN wanted USING (token) GROUP BY ALL)
  WHERE met = size GROUP BY ALL)""",
    """weights AS (
  SELECT phrase, CASE WHEN v <= 0 THEN 1e-6 ELSE v END AS idf
  FROM (SELECT phrase, ln((total - n + 5e-1) / (n + 5e-1)) AS v
    FROM (SELECT phrase, count(*) AS n FROM hits GROUP BY phrase), corpus))""",
    """bm25 AS MATERIALIZED (
  SELECT query_id, chunk_id, sum(CAST(floor(times * idf * f * 2.2e0
      / (f + 1.2e0 * (25e-2 + 75e-2 * n / average)) * 1e13) AS BIGINT))::DOUBLE / 1e13 AS score
  FROM hits JOIN clauses USING (phrase) JOIN weights USING (phrase) JOIN lens USING (chunk_id),
    corpus GROUP BY ALL)""",
]


def lexical_ctes(limit: int, name: str = "lexical") -> list[str]:
    hay = " || chr(10) || ".join(
        ["" + search_norm("title"), search_norm("source_name"), "''", search_norm("text")]
    )
    return [
        f"""{name}_cut AS MATERIALIZED (
  SELECT query_id, chunk_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS candidate_rank
  FROM bm25 QUALIFY candidate_rank <= {5 * limit})""",
        f"""{name}_judged AS MATERIALIZED (
  SELECT *, len(list_filter(phrases, lambda p: contains(hay, p))) > 0 AS phrase_match,
    len(terms) > 0 AND len(list_filter(terms, lambda p: contains(hay, p))) = len(terms) AS covered
  FROM (SELECT c.*, score, query_id, phrases, terms, {hay} AS hay,
      title <> '' AND {search_norm('title')} = normalized_query AS exact_title_match,
      normalized_query IN ({search_norm('source_name')},
        {search_norm("regexp_replace(source_name, '(.)[.][^.]+$', '\\1')")})
        AS exact_source_name_match
    FROM {name}_cut JOIN chunks c USING (chunk_id) JOIN parsed USING (query_id)))""",
        f"""{name} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC,
      exact_title_match DESC, exact_source_name_match DESC, phrase_match DESC, chunk_id)
      AS lexical_rank
  FROM (SELECT *, score + CASE WHEN exact_title_match THEN 25e0 ELSE 0e0 END
      + CASE WHEN exact_source_name_match THEN 20e0 ELSE 0e0 END
      + CASE WHEN phrase_match THEN 8e0 ELSE 0e0 END AS lexical_score
    FROM {name}_judged
    WHERE exact_title_match OR exact_source_name_match OR phrase_match OR covered)
  QUALIFY lexical_rank <= {limit})""",
    ]


LEXICAL = [BENCHMARK, *TOKENS, *BM25]


def profile(x: str) -> str:
    letters = "[" + ", ".join(quote(c) for c in LETTERS) + "]"
    count = f"length(lower({x})) - length(replace(lower({x}), c, ''))"
    share = f"({count}) / greatest(length(lower({x})), 1)"
    return f"list_transform({letters}, lambda c: CAST({share} AS FLOAT)::DOUBLE)"


def distance(a: str, b: str, width: int) -> str:
    return " + ".join(f"({a}[{i}] - {b}[{i}]) ** 2" for i in range(1, width + 1))


def semantic_ctes(limit: int, name: str = "semantic") -> list[str]:
    return [
        f"""{name} AS MATERIALIZED (
  SELECT query_id, chunk_id, distance, 1e0 / (1e0 + distance) AS semantic_score,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS semantic_rank
  FROM (SELECT query_id, chunk_id, {distance('qv', 'cv', len(LETTERS))} AS distance
    FROM (SELECT query_id, {profile('query_text')} AS qv FROM q),
      (SELECT chunk_id, {profile('text')} AS cv FROM chunks))
  QUALIFY semantic_rank <= {limit})""",
    ]


ARMS = [*LEXICAL, *lexical_ctes(10), *semantic_ctes(10)]
FUSED = [
    *ARMS,
    """fused AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC,
      coalesce(lexical_score, 0) DESC, coalesce(semantic_score, 0) DESC,
      lexical_rank ASC NULLS LAST, semantic_rank) AS final_rank
  FROM (SELECT query_id, chunk_id, lexical_rank, lexical_score, semantic_rank, semantic_score,
      coalesce(exact_title_match, false) AS exact_title_match,
      coalesce(exact_source_name_match, false) AS exact_source_name_match,
      coalesce(l.phrase_match, false) AS phrase_match,
      coalesce(1e0 / (60 + lexical_rank), 0e0) + coalesce(1e0 / (60 + semantic_rank), 0e0)
        AS fusion_score
    FROM lexical l FULL JOIN semantic s USING (query_id, chunk_id)))""",
    """ranked AS MATERIALIZED (
  SELECT f.*, c.document_id, c.chunk_index, c.stable_id, c.source_path, c.source_name, c.title,
    c.text AS chunk_text FROM fused f JOIN chunks c USING (chunk_id))""",
]


def collapse_ctes(source: str, name: str) -> list[str]:
    """Pairs that repeat each other, then a walk down each list."""
    w = words("chunk_text")
    return [
        f"""{name}_words AS MATERIALIZED (
  SELECT query_id, final_rank, document_id, stable_id, {strip('chunk_text')} AS body,
    list_distinct({w}) AS ws, len({w}) AS wn FROM {source})""",
        f"""{name}_pairs AS MATERIALIZED (
  SELECT a.query_id, b.final_rank, list(a.final_rank) AS earlier
  FROM {name}_words a JOIN {name}_words b ON a.query_id = b.query_id
    AND a.document_id = b.document_id AND a.final_rank < b.final_rank
  WHERE a.stable_id = b.stable_id OR a.body = b.body OR (least(a.wn, b.wn) >= 12
    AND len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) >= 9e-1)
  GROUP BY ALL)""",
        f"""{name}_walk AS (
  SELECT DISTINCT query_id, 0::BIGINT AS r, []::BIGINT[] AS kept FROM {source}
  UNION ALL
  SELECT w.query_id, s.final_rank,
    CASE WHEN p.earlier IS NOT NULL AND list_has_any(w.kept, p.earlier) THEN w.kept
      ELSE list_append(w.kept, s.final_rank) END
  FROM {name}_walk w JOIN {source} s ON s.query_id = w.query_id AND s.final_rank = w.r + 1
    LEFT JOIN {name}_pairs p ON p.query_id = s.query_id AND p.final_rank = s.final_rank)""",
        f"""{name} AS MATERIALIZED (
  SELECT s.* EXCLUDE (final_rank),
    row_number() OVER (PARTITION BY s.query_id ORDER BY s.final_rank) AS final_rank
  FROM {source} s JOIN (
    SELECT query_id, unnest(arg_max(kept, r)) AS final_rank FROM {name}_walk GROUP BY query_id) k
    ON k.query_id = s.query_id AND k.final_rank = s.final_rank)""",
    ]


COLLAPSED = [*FUSED, *collapse_ctes("ranked", "collapsed")]
QUERY_WORDS = f"list_distinct({words('query_text')})"
RERANKED = [
    *COLLAPSED,
    f"""scored AS (
  SELECT c.*, CASE WHEN final_rank <= 10 THEN
      CASE WHEN len({QUERY_WORDS}) = 0 THEN 0e0 ELSE
        len(list_intersect({QUERY_WORDS}, list_distinct({words('chunk_text')})))
        / len({QUERY_WORDS}) END END AS reranker_score
  FROM collapsed c JOIN q USING (query_id))""",
    """reranked AS MATERIALIZED (
  SELECT * EXCLUDE (final_rank), row_number() OVER (PARTITION BY query_id ORDER BY
      final_rank > 10, CASE WHEN final_rank > 10 THEN 0
        WHEN exact_title_match OR exact_source_name_match THEN 2
        WHEN phrase_match AND lexical_rank = 1 THEN 1 ELSE 0 END DESC,
      CASE WHEN final_rank > 10 THEN 0e0 ELSE reranker_score END DESC,
      CASE WHEN final_rank > 10 THEN 0e0 ELSE fusion_score END DESC, final_rank) AS final_rank
  FROM scored)""",
]


def final_ctes(source: str, name: str, limit: int | str, cap: int) -> list[str]:
    return [
        f"""{name} AS MATERIALIZED (
  SELECT * EXCLUDE (final_rank, nth), row_number() OVER (PARTITION BY query_id
      ORDER BY nth > {cap}, final_rank) AS final_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY final_rank) AS nth
    FROM {source})
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY nth > {cap}, final_rank) <= {limit})"""
    ]


FINAL = [*RERANKED, *final_ctes("reranked", "final", 8, 2)]

# Answers --------------------------------------------------------------------

ANSWER_ROWS = [
    """q AS (SELECT item_id AS query_id, text AS query_text FROM benchmark UNION ALL
  SELECT DISTINCT 1000000 + doc_id, CASE WHEN doc_id % 2 = 0 THEN 'doc_' || doc_id || '.txt'
    ELSE 'about doc ' || doc_id END FROM labels UNION ALL
  SELECT DISTINCT 2000000 + doc_id, 'zqxj' || doc_id FROM labels WHERE doc_id % 10 = 0)""",
    *TOKENS,
    *BM25,
    *lexical_ctes(10),
    *semantic_ctes(10, "semantic_all"),
    "semantic AS (SELECT * FROM semantic_all WHERE query_id < 2000000)",
    *RERANKED[len(ARMS):],
    *final_ctes("reranked", "shown", "CASE WHEN query_id < 1000000 THEN 5 ELSE 1 END", 2),
    *collapse_ctes("shown", "context"),
]
GATED = [
    *ANSWER_ROWS,
    """used AS MATERIALIZED (
  SELECT query_id, count(*) AS used_count,
    bool_or(final_rank = 1 AND coalesce(lexical_rank = 1, false)
      AND (exact_title_match OR exact_source_name_match)) AS confident
  FROM context WHERE final_rank <= 5 GROUP BY query_id)""",
    """gated AS MATERIALIZED (
  SELECT *, used_chunk_count < 2 AS weak_retrieval,
    CASE WHEN used_chunk_count = 0 THEN 'empty'
      WHEN used_chunk_count = 1 AND NOT confident THEN 'single' ELSE 'generate' END AS decision
  FROM (SELECT query_id, query_text, coalesce(r.n, 0) AS retrieved_count,
      coalesce(used_count, 0) AS used_chunk_count, coalesce(confident, false) AS confident
    FROM q LEFT JOIN used USING (query_id)
      LEFT JOIN (SELECT query_id, count(*) AS n FROM shown GROUP BY query_id) r USING (query_id)))""",
]
WARNINGS = f"""CASE decision WHEN 'empty' THEN [{quote(A.EMPTY_WARNING)}]
    WHEN 'single' THEN [{quote(A.LIMITED_WARNING)}, {quote(A.SINGLE_WARNING)}]
    ELSE CASE WHEN weak_retrieval THEN [{quote(A.LIMITED_WARNING)}] ELSE []::VARCHAR[] END END"""


def string_list(field: str) -> str:
    """JSON list of strings; empty when absent or null, NULL when it is anything else."""
    kind = f"coalesce(json_type(js, '$.{field}'), 'NULL')"
    items = f"json_extract(js, '$.{field}[*]')"
    plain = f"len(list_filter({items}, lambda i: json_type(i) <> 'VARCHAR')) = 0"
    return (
        f"CASE WHEN {kind} = 'NULL' THEN []::VARCHAR[] WHEN {kind} = 'ARRAY' AND {plain} "
        f"THEN list_transform({items}, lambda i: json_extract_string(i, '$')) END"
    )


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda p, i: list_position({x}, p) = i)"


LABEL = f"regexp_replace({strip('x')}, '^\\[(.*)\\]$', '\\1', 's')"


def answer_ctes(shift: int, n: str) -> list[str]:
    kinds = "[" + ", ".join(quote(r) for r in RESPONSES) + "]"
    markers = " OR ".join(f"contains(flat, {quote(m)})" for m in A.LIMITED_EVIDENCE_MARKERS)
    return [
        f"""read_{n} AS MATERIALIZED (
  SELECT *, list_transform(cited_raw, lambda x: {LABEL}) AS cited_all,
    {ordered_distinct("inline_all")} AS inline,
    {strip(f"regexp_replace(lower(answer_text), '{WS}+', ' ', 'g')")} AS flat
  FROM (SELECT *, {string_list('citations')} AS cited_raw, {string_list('warnings')} AS noted_raw,
      regexp_extract_all(coalesce(answer_text, ''), '\\[(C\\d+)\\]', 1) AS inline_all
    FROM (SELECT *, CASE WHEN json_type(js, '$.answer') = 'VARCHAR'
        THEN json_extract_string(js, '$.answer') END AS answer_text
      FROM (SELECT *, CASE WHEN json_valid(raw) THEN raw::JSON END AS js
        FROM (SELECT *, {kinds}[(query_id + {shift}) % {len(RESPONSES)} + 1] AS raw FROM gated)))))""",
        f"""judged_{n} AS MATERIALIZED (
  SELECT *, CASE WHEN decision = 'generate' THEN CASE
      WHEN js IS NULL THEN {quote(A.BAD_JSON)}
      WHEN json_type(js) <> 'OBJECT' THEN {quote(A.NOT_AN_OBJECT)}
      WHEN coalesce({strip('answer_text')}, '') = '' THEN {quote(A.EMPTY_FIELD)}
      WHEN cited_raw IS NULL OR
        len(list_filter(cited_all, lambda x: NOT regexp_full_match(x, 'C\\d+'))) > 0
        THEN {quote(A.BAD_LABELS)}
      WHEN len(inline) = 0 THEN {quote(A.UNCITED)}
      WHEN list_sort(inline) <> list_sort(list_distinct(cited_all)) THEN {quote(A.LABEL_MISMATCH)}
      WHEN len(list_filter(inline, lambda x: substr(x, 2)::INT > used_chunk_count)) > 0
        THEN {quote(A.UNKNOWN_LABEL)}
      WHEN noted_raw IS NULL THEN {quote(A.BAD_WARNINGS)}
      WHEN weak_retrieval AND NOT ({markers}) THEN {quote(A.NOT_ADMITTED)} END END AS failure
  FROM read_{n})""",
        f"""cites_{n} AS MATERIALIZED (
  SELECT j.query_id, i, label, c.chunk_id, c.source_name,
    '[' || i || '] ' || coalesce(nullif(title, ''), 'Untitled document') || ' — ' || source_path
      || ' — chunk ' || chunk_index || ' / ' || {strip('left(chunk_text, 180)')} AS display
  FROM (SELECT query_id, unnest(inline) AS label, unnest(range(1, len(inline) + 1)) AS i
    FROM judged_{n} WHERE decision = 'generate' AND failure IS NULL) j
  JOIN context c ON c.query_id = j.query_id AND 'C' || c.final_rank = j.label)""",
        f"""cited_{n} AS (
  SELECT query_id, string_agg(display, chr(10) ORDER BY i) AS citations, count(*) AS cited_count,
    list(chunk_id ORDER BY i) AS cited_ids, list(source_name ORDER BY i) AS cited_sources,
    list(label ORDER BY i) AS labels
  FROM cites_{n} GROUP BY query_id)""",
        f"""render_{n} AS (
  SELECT query_id, 0::BIGINT AS i, answer_text AS answer FROM judged_{n} WHERE failure IS NULL
    AND decision = 'generate'
  UNION ALL SELECT r.query_id, c.i, replace(r.answer, '[' || c.label || ']', '[' || c.i || ']')
  FROM render_{n} r JOIN cites_{n} c ON c.query_id = r.query_id AND c.i = r.i + 1)""",
        f"""answers_{n} AS MATERIALIZED (
  SELECT query_id, decision = 'generate' AS generator_called, weak_retrieval, failure, decision,
    used_chunk_count, retrieved_count, coalesce(citations, '') AS citations,
    coalesce(cited_count, 0) AS cited_chunk_count, coalesce(cited_ids, []) AS cited_ids,
    coalesce(cited_sources, []) AS cited_sources,
    CASE WHEN decision = 'generate' AND failure IS NULL THEN rendered
      WHEN decision = 'generate' THEN {quote(A.FAILURE_ANSWER)}
      WHEN decision = 'single' THEN {quote(A.SINGLE_ANSWER)} ELSE {quote(A.EMPTY_ANSWER)} END
      AS answer,
    array_to_string({ordered_distinct("all_warnings")}, '|') AS warnings
  FROM (SELECT *, list_filter(list_transform(list_concat({WARNINGS},
      CASE WHEN decision <> 'generate' THEN [] WHEN failure IS NULL THEN noted_raw
        ELSE [failure] END), lambda x: {strip('x')}), lambda x: x <> '') AS all_warnings
    FROM judged_{n}) j
  LEFT JOIN cited_{n} USING (query_id)
  LEFT JOIN (SELECT query_id, arg_max(answer, i) AS rendered FROM render_{n} GROUP BY query_id)
    USING (query_id))""",
    ]


ANSWERS = [*GATED, *answer_ctes(0, "a")]
BOTH_ANSWERS = [*ANSWERS, *answer_ctes(1, "b")]

GOLDEN = """golden AS MATERIALIZED (
  SELECT query_id, 'case-' || query_id AS case_id, query_text,
    'doc_' || query_id || '.txt' AS source,
    [query_text, query_text || '?'] AS substrings,
    CASE WHEN length(query_text) < 200 THEN 'doc_' || query_id || '.txt' END AS expected_top,
    CASE WHEN length(query_text) >= 150 THEN 2 END AS min_sources,
    length(query_text) < 180 AS should_decline FROM q)"""


def eval_ctes(source: str, rank: str, name: str) -> list[str]:
    return [
        f"""{name} AS MATERIALIZED (
  SELECT case_id, CASE WHEN m > 0 OR t > 0 THEN 1e0 ELSE 0e0 END AS hit, (m + t) / 3e0 AS recall,
    coalesce(1e0 / first_rank, 0e0) AS reciprocal_rank, top_source AS top_result_source,
    CASE WHEN m > 0 THEN source ELSE '' END AS matched_sources, t AS matched_texts,
    CASE WHEN expected_top IS NOT NULL THEN
      (top_source IS NOT DISTINCT FROM expected_top)::INT::DOUBLE END AS top_source_hit,
    coalesce(n_sources, 0) AS unique_sources_at_k,
    CASE WHEN min_sources IS NOT NULL THEN
      (coalesce(n_sources, 0) >= min_sources)::INT::DOUBLE END AS source_diversity_hit
  FROM golden LEFT JOIN (
    SELECT query_id, max((c.source_name = g.source)::INT) AS m,
      max(contains(lower(c.text), lower(substrings[1]))::INT)
        + max(contains(lower(c.text), lower(substrings[2]))::INT) AS t,
      min(CASE WHEN c.source_name = g.source OR contains(lower(c.text), lower(substrings[1]))
        THEN {rank} END) AS first_rank, arg_min(c.source_name, {rank}) AS top_source,
      count(DISTINCT c.source_name) AS n_sources
    FROM {source} r JOIN chunks c USING (chunk_id) JOIN golden g USING (query_id)
    GROUP BY query_id) USING (query_id))""",
    ]


EVAL8 = [*LEXICAL, GOLDEN, *lexical_ctes(8), *eval_ctes("lexical", "lexical_rank", "rows_raw")]
ROWS = """rows_{n} AS MATERIALIZED (SELECT * REPLACE (coalesce(matched_texts, 0) AS matched_texts,
  coalesce(recall, 0) AS recall) FROM {raw})"""
EVAL8.append(ROWS.format(n="e", raw="rows_raw"))
EVAL5 = [
    *LEXICAL,
    GOLDEN,
    *lexical_ctes(5),
    *semantic_ctes(5),
    *eval_ctes("lexical", "lexical_rank", "before_raw"),
    *eval_ctes("semantic", "semantic_rank", "after_raw"),
    ROWS.format(n="before", raw="before_raw"),
    ROWS.format(n="after", raw="after_raw"),
]


def report(rows: str) -> str:
    return f"""SELECT 'lexical' AS mode, count(*) AS query_count, avg(hit) AS hit_at_k,
    avg(recall) AS recall_at_k, avg(reciprocal_rank) AS mrr, avg(top_source_hit) AS top_source_at_1,
    avg(source_diversity_hit) AS source_diversity_at_k FROM {rows}"""


EVAL_DIFF = """ev AS MATERIALIZED (SELECT case_id, CASE WHEN b.top_result_source IS NOT DISTINCT FROM
      a.top_result_source AND b.hit = a.hit AND b.recall = a.recall
      AND b.reciprocal_rank = a.reciprocal_rank AND b.matched_sources = a.matched_sources
      AND b.matched_texts = a.matched_texts AND b.unique_sources_at_k = a.unique_sources_at_k
      AND b.top_source_hit IS NOT DISTINCT FROM a.top_source_hit
      AND b.source_diversity_hit IS NOT DISTINCT FROM a.source_diversity_hit
      THEN 'same' ELSE 'changed' END AS status,
    b.top_result_source AS before_top_source, a.top_result_source AS after_top_source,
    b.hit AS before_hit, a.hit AS after_hit, round(b.reciprocal_rank, 6) AS before_rr,
    round(a.reciprocal_rank, 6) AS after_rr, b.unique_sources_at_k AS before_unique_sources,
    a.unique_sources_at_k AS after_unique_sources
  FROM rows_before b JOIN rows_after a USING (case_id))"""

# Ingest ---------------------------------------------------------------------

KNOWN = f"""known AS (SELECT d.doc_id AS document_id, {PATH} AS source_path,
    sha256(text) AS content_hash, CASE WHEN toxic = 1 THEN 'failed' ELSE 'parsed' END AS status
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)""".replace(
    "source || '/doc_' || doc_id", "source || '/doc_' || d.doc_id"
)
FOUND = f"""found AS (SELECT {PATH} AS source_path,
    sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS content_hash
  FROM documents WHERE lang <> 'es')"""
CHANGES = """changes AS (SELECT source_path, document_id, status,
    CASE WHEN document_id IS NULL THEN 'added' WHEN f.content_hash <> k.content_hash
      THEN 'updated' ELSE 'unchanged' END AS change_type
  FROM found f LEFT JOIN known k USING (source_path))"""
GONE = """gone AS (SELECT document_id, source_path FROM known
  WHERE (starts_with(source_path, 'src1/') OR starts_with(source_path, 'src2/')
    OR starts_with(source_path, 'src3/')) AND source_path NOT IN (SELECT source_path FROM found))"""
REVISED = [
    *CHUNKS,
    """revised_docs AS (SELECT * REPLACE (CASE WHEN lang = 'en' THEN text || ' One more sentence.'
    ELSE text END AS text) FROM docs)""",
    *chunk_ctes("revised", "revised_docs"),
    """matched AS MATERIALIZED (
  SELECT coalesce(n.document_id, o.document_id) AS document_id,
    coalesce(n.stable_id, o.stable_id) AS stable_id, o.chunk_id, n.chunk_index,
    CASE WHEN o.chunk_id IS NULL THEN 'inserted' WHEN n.chunk_index IS NULL THEN 'deleted'
      ELSE 'preserved' END AS outcome
  FROM revised n FULL JOIN chunks o ON o.stable_id = n.stable_id)""",
]

# Sections -------------------------------------------------------------------

SECTIONS = [
    DOCS,
    f"""paras AS MATERIALIZED (
  SELECT document_id, i, tile, heading, regexp_extract_all(tile, '{WS}*{NON_WS}+') AS toks,
    CAST(sum(length(tile)) OVER (PARTITION BY document_id ORDER BY i) AS BIGINT) - length(tile) AS pos
  FROM (SELECT document_id, i, CASE WHEN i > 1 THEN chr(10) || chr(10) ELSE '' END
        || CASE WHEN length(line) <= 80 THEN '# ' || line ELSE line END AS tile,
      CASE WHEN length(line) <= 80 THEN {strip('line')} END AS heading
    FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS line,
        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)))""",
    f"""segs AS MATERIALIZED (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i, j) AS s,
    last_value(heading IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i, j
      ROWS UNBOUNDED PRECEDING) AS section,
    least(120, len(toks) - 120 * j) AS tokens,
    pos + length(array_to_string(toks[1:120 * j], '')) + length(toks[120 * j + 1])
      - length({lstrip('toks[120 * j + 1]')}) AS seg_start,
    pos + length(array_to_string(toks[1:120 * (j + 1)], '')) AS seg_end
  FROM (SELECT *, unnest(range((len(toks) + 119) // 120)) AS j FROM paras))""",
    """fold AS (
  SELECT document_id, s, 0::BIGINT AS draft, tokens::BIGINT AS size, section FROM segs WHERE s = 1
  UNION ALL
  SELECT g.document_id, g.s, CASE WHEN cut THEN draft + 1 ELSE draft END,
    CASE WHEN cut THEN g.tokens ELSE size + g.tokens END,
    CASE WHEN cut THEN g.section ELSE coalesce(f_section, g.section) END
  FROM (SELECT f.document_id, f.draft, f.size, f.section AS f_section, g AS g,
      f.size >= 60 AND (f.section IS DISTINCT FROM g.section OR f.size + g.tokens > 120) AS cut
    FROM fold f JOIN segs g ON g.document_id = f.document_id AND g.s = f.s + 1))""",
    """placed AS MATERIALIZED (SELECT g.*, f.draft FROM fold f JOIN segs g USING (document_id, s))""",
    """drafts AS MATERIALIZED (
  SELECT document_id, draft, arg_min(section, s) FILTER (section IS NOT NULL) AS section,
    min(seg_start) AS d_start, max(seg_end) AS d_end, sum(tokens) AS size,
    max(draft) OVER (PARTITION BY document_id) AS last_draft
  FROM placed GROUP BY document_id, draft)""",
    """tails AS (
  SELECT document_id, draft, max(seg_start) AS tail
  FROM (SELECT *, sum(tokens) OVER (PARTITION BY document_id, draft ORDER BY s DESC) AS from_end
    FROM placed) WHERE from_end >= 30 GROUP BY ALL)""",
    """merged AS (
  SELECT d.document_id, d.draft, d.section,
    CASE WHEN m.document_id IS NOT NULL THEN m.d_end ELSE d.d_end END AS d_end, d.d_start
  FROM drafts d LEFT JOIN drafts m ON m.document_id = d.document_id AND m.draft = d.draft + 1
    AND m.draft = m.last_draft AND m.size <= 24 AND m.size + d.size <= 144
  WHERE NOT (d.draft > 0 AND d.draft = d.last_draft AND d.size <= 24 AND d.size
    + (SELECT p.size FROM drafts p WHERE p.document_id = d.document_id AND p.draft = d.draft - 1)
    <= 144))""",
    """spanned AS (
  SELECT m.*, CASE WHEN p.document_id IS NOT NULL THEN coalesce(t.tail, p.d_start) ELSE m.d_start END
    AS start_offset
  FROM merged m LEFT JOIN drafts p ON p.document_id = m.document_id AND p.draft = m.draft - 1
    AND p.section IS NOT DISTINCT FROM m.section
  LEFT JOIN tails t ON t.document_id = p.document_id AND t.draft = p.draft)""",
    """whole AS (SELECT document_id, string_agg(tile, '' ORDER BY i) AS text FROM paras
  GROUP BY document_id)""",
]

# Run log --------------------------------------------------------------------

RUN_LOG = """log AS MATERIALIZED (
  SELECT *, length(content) AS size_bytes,
    CASE WHEN k < 10 THEN NULL ELSE content::JSON END AS payload,
    CASE WHEN k >= 5 THEN date_trunc('second', ts) END AS stamp,
    CASE WHEN k >= 20 AND kind IN ('inspect', 'ask') THEN 'user ' || user_id END AS query
  FROM (SELECT event_id, ts AS modified_at, ts, user_id, k, kind,
      CASE WHEN k < 5 THEN 'undated' ELSE strftime(ts, '%Y%m%dT%H%M%SZ') END || '-' || kind
        || CASE WHEN kind = 'debug-bundle' THEN '' ELSE '-q' || event_id END || '.json' AS file_name,
      CASE WHEN k < 10 THEN 'not json'
        WHEN k < 20 THEN '{"query":7,"mode":1,"results":{},"generated_answer":[],"traces":[]}'
        WHEN k < 40 THEN '{"query":"user ' || user_id
          || '","doctor":{},"traces":{"inspect":{},"ask":[]},"results":null}'
        ELSE '{"query":"user ' || user_id || '","mode":"hybrid","results":[1],"generated_answer":{},"retrieval_snapshot":{},"retrieval_results":[],"doctor":{},"traces":{}}'
        END AS content
    FROM (SELECT *, (props->>'$.k')::INT AS k,
        CASE event_type WHEN 'view' THEN 'inspect' WHEN 'signup' THEN 'inspect'
          WHEN 'click' THEN 'ask' WHEN 'purchase' THEN 'debug-bundle' ELSE 'notes' END AS kind
      FROM events))
  WHERE kind <> 'notes')"""


def _type(path: str) -> str:
    return f"coalesce(json_type(payload, '{path}'), 'NULL')"


ISSUES = f"""CASE WHEN payload IS NULL THEN {quote(R.NO_OBJECT)} ELSE concat_ws('|',
    CASE WHEN {_type('$.query')} NOT IN ('VARCHAR', 'NULL') THEN {quote(R.BAD_QUERY)} END,
    CASE WHEN kind = 'inspect' AND {_type('$.results')} <> 'ARRAY' THEN {quote(R.NO_RESULTS)} END,
    CASE WHEN kind = 'inspect' AND {_type('$.mode')} NOT IN ('VARCHAR', 'NULL')
      THEN {quote(R.BAD_MODE)} END,
    CASE WHEN kind = 'ask' AND {_type('$.generated_answer')} <> 'OBJECT'
      THEN {quote(R.NO_ANSWER)} END,
    CASE WHEN kind = 'ask' AND {_type('$.retrieval_snapshot')} <> 'OBJECT'
      THEN {quote(R.NO_SNAPSHOT)} END,
    CASE WHEN kind = 'ask' AND {_type('$.retrieval_results')} <> 'ARRAY'
      THEN {quote(R.NO_RETRIEVAL)} END,
    CASE WHEN kind = 'debug-bundle' AND {_type('$.doctor')} <> 'OBJECT'
      THEN {quote(R.NO_DOCTOR)} END,
    CASE WHEN kind = 'debug-bundle' AND {_type('$.traces')} <> 'OBJECT'
      THEN {quote(R.NO_TRACES)} END,
    CASE WHEN kind = 'debug-bundle' AND {_type('$.traces.inspect')} NOT IN ('ARRAY', 'NULL')
      THEN {quote(R.BAD_TRACES.format('inspect'))} END,
    CASE WHEN kind = 'debug-bundle' AND {_type('$.traces.ask')} NOT IN ('ARRAY', 'NULL')
      THEN {quote(R.BAD_TRACES.format('ask'))} END) END"""
VERIFIED = f"verified AS (SELECT event_id, {ISSUES} AS issues FROM log)"
JOBS = """jobs AS (SELECT user_id AS job_id, min(ts) AS created_at,
    max(ts) FILTER (event_type = 'view') AS heartbeat_at,
    CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed' ELSE 'running' END AS status
  FROM events GROUP BY user_id)"""

TITLE_QUERIES = f"""q AS MATERIALIZED (SELECT document_id AS query_id,
    '"' || array_to_string(ws[1:2], ' ') || '" ' || array_to_string(ws[3:4], '.') AS query_text
  FROM (SELECT document_id, string_split({search_norm('title')}, ' ') AS ws
    FROM docs WHERE document_id IN (SELECT doc_id FROM labels)))"""


def page_text(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


PAGES = f"""pages_text AS MATERIALIZED (
  SELECT page_id AS document_id, url AS source_path,
    {strip(page_text("regexp_extract(html, '<title>(.*?)</title>', 1)"))} AS title,
    {normalize(f"array_to_string(list_filter(list_transform(regexp_split_to_array(body, '<[^>]*>'), lambda t: {strip(page_text('t'))}), lambda t: t <> ''), chr(10))")} AS text
  FROM (SELECT *, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1),
      '<h1>[ ]*', '<h1># ', 'g') AS body FROM pages))"""


SNAPSHOTS = """snapshots AS (
  SELECT query_id, coalesce(n, 0) AS result_count, documents,
    left(sha256(query_text || chr(31) || 'hybrid' || coalesce(body, '')), 16) AS snapshot_id
  FROM q LEFT JOIN (SELECT query_id, count(*) AS n, count(DISTINCT document_id) AS documents,
      string_agg(chr(30) || chunk_id || chr(31) || stable_id || chr(31) || final_rank, ''
        ORDER BY final_rank) AS body
    FROM shown GROUP BY query_id) USING (query_id))"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    rough = "replace(text, '. ', '. ' || chr(9) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10))"
    sql["normalize_text"] = f"SELECT doc_id, {normalize(rough)} AS normalized FROM documents"
    sql["doc_title"] = statement("SELECT document_id, title FROM docs", DOCS)
    line = "string_split(text, chr(10))[1]"
    quoted = f"regexp_replace({strip(line)}, '^[\"'']+|[\"'']+$', '', 'g')"
    sql["markdown_title"] = f"""SELECT doc_id, CASE
      WHEN lang = 'en' THEN left({quoted}, 160)
      WHEN lang = 'de' THEN {strip(line)}
      ELSE {first_line_title('text', "'untitled'")} END AS title FROM documents"""
    sql["token_estimate"] = f"SELECT doc_id, {word_count('text')} AS tokens FROM documents"
    sql["search_norm"] = f"SELECT doc_id, {search_norm('text')} AS normalized FROM documents"
    sql["similarity_words"] = f"""SELECT doc_id, len({words('text')}) AS words,
      len(list_distinct({words('text')})) AS distinct_words FROM documents"""
    sql["excerpt"] = f"SELECT doc_id, {excerpt('text')} AS excerpt FROM documents"
    sql["content_hash"] = "SELECT doc_id, sha256(text) AS content_hash FROM documents"
    sql["source_names"] = f"""SELECT doc_id AS document_id, 'doc_' || doc_id || '.txt' AS source_name,
      'doc_' || doc_id AS stem, starts_with({PATH}, 'src1/') AS under_src1 FROM documents"""
    sql["query_slug"] = """SELECT item_id AS query_id, coalesce(nullif(left(regexp_replace(
      regexp_replace(lower(text), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'query')
      AS slug FROM benchmark"""
    page_q = """q AS MATERIALIZED (SELECT document_id AS query_id, '"' || array_to_string(ws[1:2], ' ')
      || '" ' || array_to_string(ws[3:6], ' ') || ' ' || array_to_string(ws[3:4], '.') AS query_text
      FROM (SELECT *, string_split(title, ' ') AS ws FROM pages_text))"""
    sql["parse_query"] = statement(
        """SELECT query_id, array_to_string(phrases, '|') AS phrases,
      array_to_string(terms, '|') AS terms, normalized_query,
      len(phrases) + len(terms) > 0 AS is_searchable FROM parsed""",
        PAGES, page_q, PARSED,
    )
    sql["match_clauses"] = statement("SELECT * FROM clauses", BENCHMARK, *CLAUSES)
    chunk_columns = """chunk_id, document_id, chunk_index, stable_id, NULL::VARCHAR AS section_title,
      start_offset, end_offset, token_estimate"""
    sql["chunk_plain"] = statement(f"SELECT {chunk_columns} FROM chunks", *CHUNKS)
    cut = "substr(w.text, start_offset + 1, d_end - start_offset)"
    sql["chunk_sections"] = statement(
        f"""SELECT document_id * 268435456 + draft AS chunk_id, document_id, draft AS chunk_index,
      {stable_id('document_id', 'start_offset', 'd_end', 'NULL', cut)} AS stable_id,
      section AS section_title, start_offset::BIGINT AS start_offset, d_end::BIGINT AS end_offset,
      {word_count(cut)} AS token_estimate
      FROM spanned s JOIN whole w USING (document_id)""",
        *SECTIONS,
    )
    paged = f"""paged AS MATERIALIZED (
      SELECT conv_id AS document_id, string_agg({strip(f"'[Page ' || (turn + 1) || ']' || chr(10) || {normalize('text')}")},
        chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS page_count,
        arg_min({normalize('text')}, turn) FILTER ({normalize('text')} <> '') AS first_text
      FROM conversations GROUP BY conv_id)"""
    sql["paged_text"] = statement(
        f"""SELECT document_id, {first_line_title('first_text', 'NULL')} AS title, text, page_count
      FROM paged""",
        paged,
    )
    paged_chunk = "'[Page ' || page_number || ']' || CASE WHEN t = '' THEN '' ELSE chr(10) || t END"
    sql["chunk_paged"] = statement(
        f"""SELECT document_id * 268435456 + chunk_index AS chunk_id, document_id, chunk_index,
      {stable_id('document_id', 'start_offset', 'end_offset', 'page_number', 'body')} AS stable_id,
      NULL::VARCHAR AS section_title, start_offset, end_offset, {word_count('body')}
        AS token_estimate, page_number
      FROM (SELECT *, end_offset - length(body) AS start_offset FROM (
        SELECT *, CAST(sum(length(body)) OVER w AS BIGINT) + 2 * chunk_index AS end_offset
        FROM (SELECT *, {paged_chunk} AS body, row_number() OVER w - 1 AS chunk_index
          FROM (SELECT conv_id AS document_id, turn + 1 AS page_number, {normalize('text')} AS t
            FROM conversations)
          WINDOW w AS (PARTITION BY document_id ORDER BY page_number))
        WINDOW w AS (PARTITION BY document_id ORDER BY page_number)))"""
    )
    sql["page_extract"] = statement(
        "SELECT document_id, source_path, title, text FROM pages_text", PAGES
    )
    vocabulary = "SELECT token, count(DISTINCT chunk_id) AS chunk_count FROM occ GROUP BY token"
    sql["fts_vocab"] = statement(vocabulary, *TOKENS)
    sql["corpus_stats"] = statement(
        "SELECT total AS chunk_count, round(average, 6) AS average_tokens FROM corpus", *TOKENS
    )
    updated = """docs AS (SELECT * REPLACE (CASE WHEN lang = 'fr' THEN 'Update notice ' || text
      ELSE text END AS text) FROM old_docs)"""
    sql["index_refresh"] = statement(
        vocabulary, DOCS.replace("docs AS", "old_docs AS", 1), updated, *TOKENS[1:]
    )
    twice = """docs AS (SELECT * REPLACE (CASE lang WHEN 'fr' THEN 'Update notice ' || text
      WHEN 'es' THEN 'Second notice ' || text ELSE text END AS text)
      FROM old_docs WHERE lang IS DISTINCT FROM 'de')"""
    sql["segment_refresh"] = statement(
        """SELECT chunk_id, document_id, n_tokens, vocabulary_sum, postings_sha256, total AS chunk_count,
      round(average, 6) AS average_tokens
      FROM (SELECT chunk_id, count(*) AS n_tokens, sum(chunk_count)::BIGINT AS vocabulary_sum,
          sha256(string_agg(field || ':' || pos || ':' || token, ',' ORDER BY field, pos)) AS postings_sha256
        FROM occ JOIN vocabulary USING (token) GROUP BY chunk_id)
      JOIN chunks USING (chunk_id), corpus""",
        DOCS.replace("docs AS", "old_docs AS", 1), twice, *TOKENS[1:], f"vocabulary AS ({vocabulary})",
    )
    sql["bm25_topk"] = statement(
        """SELECT query_id, chunk_id, round(score, 6) AS score, candidate_rank
      FROM lexical_cut""",
        *LEXICAL, lexical_ctes(8)[0],
    )
    sql["lexical_search"] = statement(
        f"""SELECT query_id, chunk_id, document_id, lexical_rank,
      round(lexical_score, 6) AS lexical_score, source_name, title,
      {excerpt('text')} AS chunk_text_excerpt, exact_title_match, exact_source_name_match,
      phrase_match FROM lexical""",
        *LEXICAL, *lexical_ctes(8),
    )
    sql["phrase_search"] = statement(
        """SELECT query_id, chunk_id, round(lexical_score, 6) AS lexical_score, lexical_rank,
      exact_title_match, phrase_match FROM lexical""",
        *TOKENS, TITLE_QUERIES, *BM25, *lexical_ctes(5),
    )
    sql["knn_topk"] = f"""SELECT query_id, chunk_id, round(d, 6) AS distance, row_number() OVER (
      PARTITION BY query_id ORDER BY d, chunk_id) AS semantic_rank
      FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
        {distance('a.v', 'b.v', 64)} AS d
        FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a,
          (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b)
      QUALIFY semantic_rank <= 8"""
    sql["semantic_search"] = statement(
        """SELECT query_id, chunk_id, document_id, semantic_rank,
      round(semantic_score, 6) AS semantic_score, source_name
      FROM semantic JOIN chunks USING (chunk_id)""",
        BENCHMARK, *CHUNKS, *semantic_ctes(8),
    )
    sql["index_missing"] = """SELECT doc_id AS chunk_id, doc_id AS document_id FROM documents
      WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"""
    sql["index_stale"] = """SELECT vec_id AS chunk_id FROM embeddings
      WHERE vec_id NOT IN (SELECT doc_id FROM labels)"""
    sql["vector_status"] = """SELECT 'table' AS embedding_model, c AS chunk_count, v AS vector_count,
      greatest(c - v, 0) AS remaining_count, round(v * 100e0 / c, 3) AS completion_percentage
      FROM (SELECT (SELECT count(*) FROM documents) AS c, (SELECT count(*) FROM embeddings) AS v)"""
    vector = "'table' AS embedding_model, len(v) AS dimensions, round(list_sum(v), 4) AS total"
    base = "SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings"
    labelled = "vec_id IN (SELECT doc_id FROM labels)"
    sql["vector_upsert"] = f"""SELECT chunk_id, {vector} FROM ({base} WHERE NOT {labelled}
      UNION ALL SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 2)
      FROM embeddings WHERE {labelled})"""
    sql["vector_delete"] = f"SELECT chunk_id, {vector} FROM ({base} WHERE NOT {labelled})"
    sql["embed_batched"] = statement(
        f"""SELECT chunk_id, '{MODEL}' AS embedding_model, len(v) AS dimensions, round(list_sum(v), 4) AS total
      FROM (SELECT chunk_id, {profile('text')} AS v FROM chunks)""",
        *CHUNKS,
    )
    sql["sync_vectors"] = statement(
        f"""SELECT chunk_id, {vector} FROM ({base} WHERE {labelled} UNION ALL
      SELECT document_id, {profile('text')} FROM docs
      WHERE document_id IN (SELECT doc_id FROM labels)
        AND document_id NOT IN (SELECT vec_id FROM embeddings))""",
        DOCS,
    )
    missing = """document_id IN (SELECT doc_id FROM labels)
        AND document_id NOT IN (SELECT vec_id FROM embeddings)"""
    sql["sync_limit"] = statement(
        f"""SELECT chunk_id, {vector} FROM ({base} WHERE {labelled} UNION ALL
      SELECT document_id, v FROM (SELECT document_id, {profile('text')} AS v FROM docs
      WHERE {missing} ORDER BY document_id LIMIT 100))""",
        DOCS,
    )
    sql["reindex_resume"] = """SELECT 'table' AS embedding_model, c AS chunk_count, v + t AS vector_count,
      c - v - t AS remaining_count, round((v + t) * 100e0 / c, 3) AS completion_percentage,
      true AS resume, v AS starting_vector_count, c - v AS starting_remaining_count,
      t AS target_count, t AS indexed_count, false AS stopped_due_to_time_budget
      FROM (SELECT c, v, least(100, c - v) AS t FROM (SELECT
        (SELECT count(DISTINCT doc_id) FROM labels) AS c,
        (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)) AS v))"""
    sql["reindex_rebuild"] = statement(
        f"""SELECT document_id AS chunk_id, 'table' AS embedding_model, len(v) AS embedding_dim,
      len(v) AS dimensions, round(list_sum(v), 4) AS total
      FROM (SELECT document_id, {profile('text')} AS v FROM docs
            WHERE document_id IN (SELECT doc_id FROM labels))""",
        DOCS,
    )
    sql["index_batches"] = """SELECT (i - 1) // 64 + 1 AS batch, count(*) AS chunks
      FROM (SELECT unnest(range(1, 1 + (SELECT count(DISTINCT doc_id) FROM labels))) AS i)
      GROUP BY 1"""
    sql["embedding_meta"] = """SELECT doc_id AS chunk_id,
      CASE WHEN vec_id IS NOT NULL THEN 'table' END AS embedding_model,
      len(embedding) AS embedding_dim
      FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""
    sql["rrf"] = statement(
        """SELECT query_id, chunk_id, lexical_rank, semantic_rank,
      round(fusion_score, 6) AS fusion_score, phrase_match, final_rank FROM fused""",
        *FUSED,
    )
    listed = "SELECT query_id, chunk_id, document_id, final_rank"
    sql["near_dup_collapse"] = statement(f"{listed} FROM collapsed", *COLLAPSED)
    sql["rerank"] = statement(
        f"{listed}, round(reranker_score, 6) AS reranker_score FROM reranked", *RERANKED
    )
    sql["diversify"] = statement(
        f"{listed} FROM spread", *FUSED, *final_ctes("ranked", "spread", 20, 1)
    )
    sql["hybrid_search"] = statement(f"{listed} FROM final", *FINAL)
    sql["hybrid_diagnostics"] = statement(
        """SELECT query_id, a AS fused_candidate_count, b AS deduped_candidate_count,
      a - b AS collapsed_same_document_count, b AS reranked_candidate_count,
      b - c AS document_capped_count, 2 AS max_results_per_document, c AS returned_result_count,
      d AS unique_document_count
      FROM (SELECT query_id, (SELECT count(*) FROM fused f WHERE f.query_id = q.query_id) AS a,
        (SELECT count(*) FROM collapsed f WHERE f.query_id = q.query_id) AS b,
        (SELECT count(*) FROM final f WHERE f.query_id = q.query_id) AS c,
        (SELECT count(DISTINCT document_id) FROM final f WHERE f.query_id = q.query_id) AS d
        FROM q)""",
        *FINAL,
    )
    sql["inspect_documents"] = statement(
        """SELECT query_id, document_id, min(title) AS title, min(source_path) AS source_path,
      count(*) AS chunk_count, min(final_rank) AS first_rank,
      row_number() OVER (PARTITION BY query_id ORDER BY min(final_rank)) AS document_order
      FROM final GROUP BY query_id, document_id""",
        *FINAL,
    )
    sql["change_detect"] = statement(
        """SELECT source_path, document_id, change_type,
      change_type <> 'unchanged' OR coalesce(status <> 'parsed', false) AS should_parse
      FROM changes""",
        KNOWN, FOUND, CHANGES,
    )
    sql["deleted_detect"] = statement("SELECT document_id, source_path FROM gone", KNOWN, FOUND, GONE)
    sql["chunk_reconcile"] = statement(
        """SELECT CASE WHEN outcome = 'inserted' THEN document_id * 268435456 + 1
        + (SELECT max(chunk_index) FROM chunks c WHERE c.document_id = m.document_id)
        + row_number() OVER (PARTITION BY document_id, outcome ORDER BY chunk_index) - 1
        ELSE chunk_id END AS chunk_id, document_id, stable_id, outcome,
      CASE WHEN outcome <> 'inserted' THEN 'm' END AS embedding_model FROM matched m""",
        *REVISED,
    )
    sql["chunk_change_counts"] = statement(
        """SELECT document_id, count(*) FILTER (outcome = 'preserved') AS preserved_chunk_count,
      count(*) FILTER (outcome = 'inserted') AS new_chunk_count,
      count(*) FILTER (outcome = 'deleted') AS removed_chunk_count FROM matched GROUP BY document_id""",
        *REVISED,
    )
    sql["run_summary"] = statement(
        """SELECT count(*) AS docs_seen, count(*) FILTER (change_type = 'added') AS docs_added,
      count(*) FILTER (change_type = 'updated') AS docs_updated,
      count(*) FILTER (change_type = 'unchanged') AS docs_unchanged,
      (SELECT count(*) FROM gone) AS docs_deleted,
      count(*) FILTER (status = 'failed') AS docs_failed FROM changes""",
        KNOWN, FOUND, CHANGES, GONE,
    )
    sql["document_upsert"] = statement(
        """SELECT source_path, content_hash FROM known
      WHERE source_path NOT IN (SELECT source_path FROM found)
      UNION ALL SELECT source_path, content_hash FROM found""",
        KNOWN, FOUND,
    )
    not_gone = "document_id NOT IN (SELECT document_id FROM gone)"
    sql["cascade_delete"] = statement(
        f"""SELECT 'documents' AS name, count(*) AS row_count FROM known WHERE {not_gone}
      UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE {not_gone}
      UNION ALL SELECT 'vectors', count(*) FROM embeddings
        WHERE vec_id NOT IN (SELECT document_id FROM gone)""",
        *CHUNKS, KNOWN, FOUND, GONE,
    )
    second = [part.replace("lang = 'en'", "lang = 'de'") for part in REVISED]
    sql["ingest_documents"] = statement(
        """SELECT '/corpus/' || source_path AS source_path,
      CASE lang WHEN 'fr' THEN 'added' WHEN 'de' THEN 'updated' ELSE 'unchanged' END AS change_type,
      'parsed' AS parse_status,
      CASE WHEN lang = 'fr' THEN 0 ELSE preserved END AS preserved_chunk_count,
      CASE WHEN lang = 'fr' THEN preserved ELSE inserted END AS new_chunk_count,
      removed AS removed_chunk_count
      FROM docs JOIN (SELECT document_id, count(*) FILTER (outcome = 'preserved') AS preserved,
          count(*) FILTER (outcome = 'inserted') AS inserted,
          count(*) FILTER (outcome = 'deleted') AS removed FROM matched GROUP BY document_id)
        USING (document_id)
      WHERE lang <> 'es'""",
        *second,
    )
    sql["ingest_run"] = """SELECT count(*) FILTER (lang <> 'es') AS docs_seen,
      count(*) FILTER (lang = 'fr') AS docs_added, count(*) FILTER (lang = 'de') AS docs_updated,
      count(*) FILTER (lang = 'en') AS docs_unchanged, count(*) FILTER (lang = 'es') AS docs_deleted,
      0 AS docs_failed FROM documents"""
    sql["ingest_dry_run"] = sql["ingest_run"]
    sql["scan_files"] = """SELECT doc_id, 'text' AS doc_type, sha256(coalesce(text, '') || chr(10)) AS content_hash,
      'parsed' AS parse_status, length(coalesce(text, '')) + 1 AS characters FROM documents"""
    longer = "CASE WHEN lang = 'de' THEN text || ' One more sentence.' ELSE text END"
    after = (
        DOCS.replace(f"{PATH} AS source_path", f"'/corpus/' || {PATH} AS source_path")
        .replace(normalize("text"), normalize(f"({longer})"))
        .replace("FROM documents)", "FROM documents WHERE lang <> 'es')")
    )
    sql["ingest_index"] = statement(vocabulary, after, *TOKENS[1:])
    sql["event_stream"] = "SELECT event_id, user_id, event_type, value FROM events"
    sql["event_numbers"] = """SELECT event_id AS id, user_id AS job_id, row_number() OVER (PARTITION BY user_id
      ORDER BY event_type IS DISTINCT FROM 'view', ts, event_id) AS sequence,
      CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS batch_id FROM events"""
    sql["ingest_stream_runs"] = """SELECT run_id, count(*) AS docs_seen, count(*) AS docs_added, 0 AS docs_updated,
      0 AS docs_unchanged, 0 AS docs_failed
      FROM (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run_id FROM documents) GROUP BY run_id"""
    sql["duplicate_texts"] = """SELECT sha256(text) AS content_hash, count(*) AS count FROM documents
      GROUP BY text HAVING count(*) > 1"""
    sql["eval_cases"] = statement(
        """SELECT case_id, matched_sources, matched_texts, hit, round(recall, 6) AS recall,
      round(reciprocal_rank, 6) AS reciprocal_rank, top_result_source, top_source_hit,
      unique_sources_at_k, source_diversity_hit FROM rows_e""",
        *EVAL8,
    )
    metrics = "hit_at_k recall_at_k mrr top_source_at_1 source_diversity_at_k".split()
    sql["retrieval_eval"] = statement(
        f"""SELECT mode, 8 AS k, query_count,
      {', '.join(f'round({m}, 6) AS {m}' for m in metrics)} FROM ({report('rows_e')})""",
        *EVAL8,
    )
    sql["case_bundles"] = statement(
        """SELECT case_id, 'lexical' AS mode, hit, coalesce((SELECT string_agg(chunk_id, ','
        ORDER BY lexical_rank) FROM lexical l WHERE 'case-' || l.query_id = case_id), '') AS chunk_ids
      FROM rows_e""",
        *EVAL8,
    )
    diff = """diff AS MATERIALIZED (
      SELECT query_id, chunk_id, b.final_rank AS before_rank, a.final_rank AS after_rank,
        b.final_rank - a.final_rank AS rank_delta,
        CASE WHEN b.final_rank IS NULL THEN 'added' WHEN a.final_rank IS NULL THEN 'removed'
          WHEN b.final_rank > a.final_rank THEN 'up' WHEN b.final_rank < a.final_rank THEN 'down'
          ELSE 'same' END AS status
      FROM (SELECT * FROM ranked WHERE final_rank <= 8) b
        FULL JOIN final a USING (query_id, chunk_id))"""
    sql["retrieval_diff"] = statement(
        "SELECT diff.*, source_path FROM diff JOIN chunks USING (chunk_id)", *FINAL, diff
    )
    sql["retrieval_diff_summary"] = statement(
        """SELECT query_id, count(before_rank) AS before_count, count(after_rank) AS after_count,
      count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
      count(*) FILTER (status = 'up') AS moved_up, count(*) FILTER (status = 'down') AS moved_down,
      count(*) FILTER (status = 'same') AS unchanged_rank FROM diff GROUP BY query_id""",
        *FINAL, diff,
    )
    sql["eval_diff"] = statement("SELECT * FROM ev", *EVAL5, EVAL_DIFF)
    deltas = ", ".join(f"round(a.{m} - b.{m}, 6) AS {m}_delta" for m in metrics)
    sql["eval_diff_summary"] = statement(
        f"""SELECT true AS mode_changed, false AS k_changed,
      a.query_count <> b.query_count AS query_count_changed, {deltas}, 0 AS added_cases,
      0 AS removed_cases, (SELECT count(*) FROM ev WHERE status = 'changed') AS changed_cases,
      (SELECT count(*) FROM ev WHERE status = 'same') AS unchanged_cases
      FROM ({report('rows_before')}) b, ({report('rows_after')}) a""",
        *EVAL5, EVAL_DIFF,
    )
    sql["answer_context"] = statement(
        """SELECT query_id, 'C' || final_rank AS label, chunk_id, title AS document_title,
      sha256(chunk_text) AS text_hash FROM context WHERE final_rank <= 5""",
        *ANSWER_ROWS,
    )
    sql["evidence_gate"] = statement(
        f"""SELECT query_id, retrieved_count, used_chunk_count, decision, weak_retrieval,
      array_to_string({WARNINGS}, '|') AS warnings FROM gated""",
        *GATED,
    )
    sql["build_prompts"] = statement(
        f"""SELECT query_id, {quote(A.SYSTEM_PROMPT)} AS system_prompt,
      'Question: ' || query_text || chr(10) || CASE WHEN weak_retrieval
        THEN {quote(A.WEAK_INSTRUCTION)} ELSE {quote(A.STRONG_INSTRUCTION)} END
        || chr(10) || {quote(A.PROMPT_RULES)} || chr(10) || blocks AS user_prompt
      FROM gated JOIN (SELECT query_id, string_agg('C' || final_rank || chr(10) || 'title: '
          || coalesce(nullif(title, ''), 'Untitled document') || chr(10) || 'path: ' || source_path
          || chr(10) || 'section: -' || chr(10) || 'page: -' || chr(10) || 'chunk_index: '
          || chunk_index || chr(10) || 'text:' || chr(10) || chunk_text, chr(10) || chr(10)
          ORDER BY final_rank) AS blocks
        FROM context WHERE final_rank <= 5 GROUP BY query_id) USING (query_id)
      WHERE decision = 'generate'""",
        *GATED,
    )
    sql["validate_answers"] = statement(
        """SELECT query_id, answer, citations, warnings, failure, cited_chunk_count, weak_retrieval,
      generator_called FROM answers_a""",
        *ANSWERS,
    )
    sql["ask_answers"] = statement(
        f"""SELECT query_id, CASE WHEN decision = 'generate' AND NOT weak_retrieval THEN 'Evidence: '
        || array_to_string(list_transform(range(1, cited + 1), lambda i: '[' || i || ']'), ' ')
        WHEN decision = 'generate' THEN {quote(A.FAILURE_ANSWER)}
        WHEN decision = 'single' THEN {quote(A.SINGLE_ANSWER)} ELSE {quote(A.EMPTY_ANSWER)} END
        AS answer,
      CASE WHEN decision = 'generate' AND NOT weak_retrieval THEN cited ELSE 0 END
        AS cited_chunk_count, snapshot_id,
      (SELECT count(*) FROM fused f WHERE f.query_id = g.query_id) AS fused_candidate_count,
      retrieved_count AS returned_result_count, coalesce(documents, 0) AS unique_document_count,
      coalesce(used_documents, 0) AS context_document_count
      FROM (SELECT *, (used_chunk_count + 1) // 2 AS cited FROM gated) g
        JOIN snapshots USING (query_id)
        LEFT JOIN (SELECT query_id, count(DISTINCT document_id) AS used_documents FROM context
          WHERE final_rank <= 5 GROUP BY query_id) USING (query_id)""",
        *RERANKED, *final_ctes("reranked", "shown", 5, 2), *collapse_ctes("shown", "context"),
        *GATED[-2:], SNAPSHOTS,
    )
    declined = " OR ".join(f"contains(lower(answer), {quote(m)})" for m in E.DECLINE_MARKERS)
    problems = f"""concat_ws('|',
      CASE WHEN should_decline AND NOT declined THEN {quote(E.EXPECTED_DECLINE)} END,
      CASE WHEN NOT should_decline AND declined THEN {quote(E.UNEXPECTED_DECLINE)} END,
      CASE WHEN NOT list_contains(cited_sources, source)
        THEN {quote(E.MISSING_SOURCES)} || source END,
      CASE WHEN not_there <> '' THEN {quote(E.MISSING_TEXT)} || not_there END,
      CASE WHEN there <> '' THEN {quote(E.FORBIDDEN_TEXT)} || there END)"""
    sql["answer_eval"] = statement(
        f"""SELECT case_id, declined AS answer_declined, {problems} AS failures,
      {problems} = '' AS passed
      FROM (SELECT *, cited_chunk_count = 0 AND (({declined}) OR NOT generator_called) AS declined,
        concat_ws(', ', CASE WHEN NOT contains(lower(answer), 'claim') THEN 'claim' END,
          CASE WHEN NOT contains(lower(answer), 'supported') THEN 'supported' END) AS not_there,
        concat_ws(', ', CASE WHEN contains(lower(answer), 'limited') THEN 'LIMITED' END,
          CASE WHEN contains(lower(answer), 'could not') THEN 'could not' END) AS there
        FROM golden JOIN answers_a USING (query_id))""",
        *ANSWERS, GOLDEN,
    )
    sql["snapshot_ids"] = statement(
        "SELECT query_id, snapshot_id, result_count FROM snapshots", *ANSWER_ROWS, SNAPSHOTS
    )
    sql["answer_diff"] = statement(
        """SELECT query_id, false AS query_mismatch, a.answer <> b.answer AS answer_changed,
      false AS retrieval_snapshot_changed, a.cited_ids <> b.cited_ids AS citations_changed,
      false AS used_chunks_changed, a.warnings <> b.warnings AS warnings_changed
      FROM answers_a a JOIN answers_b b USING (query_id)""",
        *BOTH_ANSWERS,
    )
    sql["answer_eval_diff"] = statement(
        """SELECT 'case-' || query_id AS case_id,
      CASE WHEN a.answer = b.answer AND a.cited_ids = b.cited_ids AND a.warnings = b.warnings
        THEN 'same' ELSE 'changed' END AS status,
      c.source_name AS before_top_source, c.source_name AS after_top_source,
      a.answer AS before_answer, b.answer AS after_answer,
      a.cited_chunk_count AS before_citations, b.used_chunk_count AS after_used
      FROM answers_a a JOIN answers_b b USING (query_id)
        LEFT JOIN (SELECT * FROM context WHERE final_rank = 1) c USING (query_id)""",
        *BOTH_ANSWERS,
    )
    # Answers equal themselves, those of other responses differ, and modes cannot be compared.
    sql["regression_gate"] = """SELECT 3 AS selected_checks, 3 AS executed_checks,
      0 AS skipped_checks, 1 AS passed_checks, 1 AS changed_checks, 1 AS error_checks, true AS failed"""
    sql["regression_gate_fail_fast"] = """SELECT 3 AS selected_checks, 1 AS executed_checks,
      2 AS skipped_checks, 0 AS passed_checks, 0 AS changed_checks, 1 AS error_checks, true AS failed"""
    day = "'%Y-%m-%d %H:%M:%S'"
    sql["run_log_metadata"] = statement(
        f"""SELECT event_id, kind AS type, strftime(stamp, {day}) AS stamp, query, size_bytes
      FROM log""",
        RUN_LOG,
    )
    stats = f"""count(*) AS run_count, coalesce(sum(size_bytes), 0)::BIGINT AS size_bytes,
      strftime(min(stamp), {day}) AS oldest, strftime(max(stamp), {day}) AS newest"""
    sql["run_log_stats"] = statement(
        f"""SELECT kind AS type, {stats} FROM log GROUP BY kind
      UNION ALL SELECT 'total', {stats} FROM log""",
        RUN_LOG,
    )
    sql["run_log_verify"] = statement(
        "SELECT event_id, issues, issues = '' AS valid FROM verified", RUN_LOG, VERIFIED
    )
    sql["run_log_verify_summary"] = statement(
        """SELECT count(*) AS total_count, count(*) FILTER (issues = '') AS valid_count,
      count(*) FILTER (issues <> '') AS invalid_count FROM verified""",
        RUN_LOG, VERIFIED,
    )
    sql["run_log_latest"] = statement(
        """SELECT event_id, kind AS type, row_number() OVER (PARTITION BY kind
        ORDER BY modified_at DESC, file_name DESC) AS recency FROM log QUALIFY recency <= 5""",
        RUN_LOG,
    )
    sql["run_log_retention"] = statement(
        """SELECT event_id, row_number() OVER (ORDER BY modified_at DESC, file_name DESC) <= 100
      AS kept FROM log""",
        RUN_LOG,
    )
    sql["event_sequence"] = """SELECT event_id AS id, user_id AS job_id, row_number() OVER (
      PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events"""
    sql["event_tail"] = """SELECT event_id AS id, user_id AS job_id, event_type FROM events
      WHERE event_id > 100 ORDER BY event_id LIMIT 200"""
    stale = """status = 'running' AND (heartbeat_at IS NULL
      OR heartbeat_at <= (SELECT max(ts) FROM events) - INTERVAL 12 HOURS)"""
    sql["stale_sweep"] = statement(
        f"""SELECT job_id, CASE WHEN {stale} THEN 'interrupted' ELSE status END AS status,
      {stale} AS finished FROM jobs""",
        JOBS,
    )
    sql["job_listing"] = statement(
        "SELECT job_id FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 50", JOBS
    )
    return sql
