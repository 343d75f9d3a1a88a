"""The registered queries once more, as DuckDB SQL over the same tables."""

from __future__ import annotations

import re

from corpus_search.functions.text import QUERY_PUNCTUATION, WHITESPACE, normalised_stop_words
from corpus_search.operators.reranking import BIAS, COVERAGE_WEIGHT, PHRASE_WEIGHT
from corpus_search.plans.derived import INDEX, SEARCH
from corpus_search.settings import (
    CHUNK_SIZE,
    CONTEXT_TEMPLATE,
    DELIMITER,
    DOCUMENT_PREFIX,
    EMPTY_ANSWER,
    FUSION_CONSTANT,
    MAX_DOCUMENT_TOKENS,
    QUERY_PREFIX,
    SYSTEM_TEMPLATE,
    USER_TEMPLATE,
    VIDEO_SEARCH_URL,
    IndexSettings,
)

SPACE = f"[{WHITESPACE}]"
STOP_WORDS = "[" + ", ".join(f"'{word}'" for word in normalised_stop_words()) + "]"
PUNCTUATION = QUERY_PUNCTUATION.replace("'", "''")
BLANKS = " " * len(QUERY_PUNCTUATION)
WIDTH = INDEX.embedding_width
NUMBER = r"^(\d+(e\d+)?|nan|inf|infinity)$"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def clean(column: str) -> str:
    collapsed = f"regexp_replace({column}, '{SPACE}{{2,}}', ' ', 'g')"
    return (
        f"replace(replace(replace({collapsed}, '&#39;', ''''), '&quot;', ''''), '&amp;', '&')"
    )


def words(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '{SPACE}+'), lambda x: x <> '')"


def query_words(column: str) -> str:
    return words(f"lower(translate({column}, '{PUNCTUATION}', '{BLANKS}'))")


def raw_tokens(column: str) -> str:
    kept = f"regexp_replace(lower({column}), '[^a-z0-9{WHITESPACE}]', '', 'g')"
    return f"string_split_regex(trim({kept}, '{WHITESPACE}'), '{SPACE}+')"


def tokens(column: str) -> str:
    return f"list_filter({raw_tokens(column)}, lambda x: NOT list_contains({STOP_WORDS}, x))"


def windows(settings: IndexSettings, source: str = "x_transcripts") -> str:
    size, stride = settings.chunk_size, settings.stride
    return f"""
        SELECT video_id, (i + 1)::SMALLINT AS chunk_index,
               array_to_string(list_slice(w, i * {stride} + 1, i * {stride} + {size}), ' ') AS chunk
        FROM (SELECT video_id, {words('transcript')} AS w
              FROM {source}) d,
             unnest(range(0, greatest(0, ceil((len(w) - {size}) / {stride}))::BIGINT + 1)) t(i)
        WHERE len(w) > 0"""


def hash_slots(column: str) -> str:
    return (
        f"list_transform(list_filter({tokens(column)}, lambda x: x <> ''), "
        f"lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {2 * WIDTH})"
    )


# Signed token counts over 2 * WIDTH hash slots.
SIGNED_COUNTS = f"""list_transform(range({WIDTH}), lambda i:
    (len(list_filter(slots, lambda s: s = i))
     - len(list_filter(slots, lambda s: s = i + {WIDTH})))::DOUBLE)"""


def one_edit(u: str, d: str) -> str:
    """Character by character; DuckDB's edit distances count bytes."""

    def some(length_of: str, condition: str) -> str:
        return f"len(list_filter(range(1, length({length_of}) + 1), lambda i: {condition})) > 0"

    def deletion(longer: str, shorter: str) -> str:
        return some(longer, f"left({longer}, i - 1) || substr({longer}, i + 1) = {shorter}")

    same_length = some(
        u,
        f"left({u}, i - 1) = left({d}, i - 1) AND (substr({u}, i + 1) = substr({d}, i + 1) OR "
        f"(substr({u}, i, 1) = substr({d}, i + 1, 1) AND substr({u}, i + 1, 1) = substr({d}, i, 1)"
        f" AND substr({u}, i + 2) = substr({d}, i + 2)))",
    )
    return f"""CASE length({u}) - length({d}) WHEN 0 THEN {same_length}
        WHEN 1 THEN {deletion(u, d)} WHEN -1 THEN {deletion(d, u)} ELSE false END"""


def shortened(column: str) -> str:
    """The word and the word less one character, for every character."""
    return (
        f"unnest(list_distinct(list_append(list_transform(range(1, length({column}) + 1), "
        f"lambda i: left({column}, i - 1) || substr({column}, i + 1)), {column})))"
    )


def best_correction(asked: str) -> str:
    """Words one edit apart share a shortened form; the comparison of characters decides."""
    return f"""SELECT u.word, arg_min(d.word, (-frequency, d.word)) AS corrected
        FROM (SELECT word, {shortened('word')} AS form
              FROM (SELECT DISTINCT word FROM {asked}
                    WHERE word NOT IN (SELECT word FROM x_dictionary)
                      AND NOT regexp_matches(word, '{NUMBER}'))) u
        JOIN (SELECT word, frequency, {shortened('word')} AS form FROM x_dictionary
              WHERE NOT regexp_matches(word, '{NUMBER}')) d ON u.form = d.form
        WHERE {one_edit('u.word', 'd.word')} GROUP BY u.word"""


def template(pattern: str, **values: str) -> str:
    parts = re.split(r"\{(\w+)\}", pattern)
    return "concat(" + ", ".join(
        values[part] if position % 2 else text(part) for position, part in enumerate(parts)
    ) + ")"


def bm25(source: str, prefix: str) -> dict[str, str]:
    """The lexical index over one chunk relation, as a chain of relations."""
    return {
        f"{prefix}_tokens": f"""SELECT video_id, chunk_index, tokens, len(tokens) AS n_tokens
            FROM (SELECT video_id, chunk_index, {tokens('chunk')} AS tokens FROM {source})""",
        f"{prefix}_stats": f"""SELECT avg(n_tokens) AS avg_n_tokens, count(*) AS n_chunks
            FROM {prefix}_tokens""",
        f"{prefix}_terms": f"""SELECT video_id, chunk_index, n_tokens, token, count(*) AS tf
            FROM (SELECT video_id, chunk_index, n_tokens, unnest(tokens) AS token
                  FROM {prefix}_tokens) WHERE token <> '' GROUP BY ALL""",
        f"{prefix}_idf": f"""SELECT token, df, ln((n_chunks - df + 0.5) / (df + 0.5) + 1) AS idf
            FROM (SELECT token, count(*) AS df FROM {prefix}_terms GROUP BY token),
                 {prefix}_stats""",
        f"{prefix}_bm25": f"""SELECT video_id, chunk_index, token,
              idf * (tf * ({INDEX.k1} + 1))
              / (tf + {INDEX.k1} * (1 - {INDEX.b} + {INDEX.b} * n_tokens / avg_n_tokens)) AS score
            FROM {prefix}_terms JOIN {prefix}_idf USING (token), {prefix}_stats""",
    }


RELATIONS: dict[str, str] = {
    "x_transcripts": f"""SELECT doc_id::VARCHAR AS video_id,
          make_timestamp((1704067200 + doc_id * 60) * 1000000) AS creation_date,
          {clean("regexp_extract(text, '^[^.' || chr(10) || ']*')")} AS title,
          {clean('text')} AS transcript FROM documents""",
    "x_items": """SELECT source AS channel_id, doc_id::VARCHAR AS video_id,
          strftime(make_timestamp((1704067200 + doc_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
            AS published_at,
          regexp_extract(text, '^[^.' || chr(10) || ']*') AS title FROM documents""",
    "x_labels": "SELECT doc_id::VARCHAR AS video_id, quality, toxic FROM labels",
    "x_known": "SELECT * FROM x_transcripts WHERE video_id IN (SELECT video_id FROM x_labels)",
    "x_texts": f"""SELECT conv_id::VARCHAR AS video_id,
          string_agg(lower(trim(text, '{WHITESPACE}')), ' ' ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id""",
    "x_outcomes": f"""SELECT channel_id, i.video_id, title, published_at, CASE
          WHEN i.video_id = '' OR title = '' OR published_at = '' THEN 'missing_field'
          WHEN i.video_id IN (SELECT video_id FROM x_known) THEN 'existing'
          WHEN t.text IS NULL THEN 'unavailable'
          WHEN trim(t.text, '{WHITESPACE}') = '' THEN 'empty'
          ELSE 'new' END AS outcome, t.text
        FROM x_items i LEFT JOIN x_texts t ON i.video_id = t.video_id""",
    "x_new": f"""SELECT o.video_id, t.creation_date, {clean('o.title')} AS title,
          {clean('o.text')} AS transcript
        FROM x_outcomes o JOIN x_transcripts t ON o.video_id = t.video_id WHERE outcome = 'new'""",
    "x_chunks": windows(INDEX),
    "x_completions": """SELECT c.video_id, c.chunk_index,
          CASE WHEN toxic = 1 THEN 'length' ELSE 'stop' END AS finish_reason,
          CASE WHEN quality = 0 THEN '' ELSE title END AS content
        FROM x_chunks c JOIN x_transcripts t ON c.video_id = t.video_id
        JOIN x_labels l ON c.video_id = l.video_id""",
    "x_contextual": f"""SELECT c.video_id, c.chunk_index, c.chunk AS bare_chunk,
          content IS NULL OR content = '' OR finish_reason = 'length' AS is_fallback,
          CASE WHEN content IS NULL OR content = '' OR finish_reason = 'length' THEN c.chunk
               ELSE lower(trim(content, '{WHITESPACE}')) || chr(10) || c.chunk END AS chunk
        FROM x_chunks c LEFT JOIN x_completions p
          ON c.video_id = p.video_id AND c.chunk_index = p.chunk_index""",
    **bm25("x_chunks", "x"),
    "x_counts": "SELECT video_id, max(chunk_index) AS chunk_count FROM x_chunks GROUP BY video_id",
    "x_knowledge": """SELECT c.video_id, c.chunk_index, title,
          round_even((c.chunk_index - 1) / chunk_count * 100, 0) / 100 AS "start",
          round_even(c.chunk_index / chunk_count * 100, 0) / 100 AS "end", chunk
        FROM x_chunks c JOIN x_counts n ON c.video_id = n.video_id
        JOIN x_transcripts t ON c.video_id = t.video_id""",
    "x_slots": f"SELECT video_id, chunk_index, {hash_slots('chunk')} AS slots FROM x_chunks",
    "x_raw_vectors": f"SELECT video_id, chunk_index, {SIGNED_COUNTS} AS v FROM x_slots",
    "x_vectors": """SELECT video_id, chunk_index,
          list_transform(v, lambda x: (x / n)::FLOAT) AS embedding
        FROM (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n
              FROM x_raw_vectors)""",
    "x_queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "x_dictionary": f"""SELECT word, count(*) AS frequency
        FROM (SELECT unnest({query_words('transcript')}) AS word FROM x_transcripts)
        GROUP BY word""",
    "x_query_words": f"""SELECT query_id, generate_subscripts(w, 1) - 1 AS position,
          unnest(w) AS word FROM (SELECT query_id, {query_words('query')} AS w FROM x_queries)""",
    "x_fixes": best_correction("x_query_words"),
    "x_asked": """SELECT word FROM x_query_words UNION
        SELECT word[2:2] || word[1:1] || word[3:] FROM x_query_words""",
    "x_prepared": """SELECT q.query_id, q.query, coalesce(corrected, '') AS corrected, w AS words
        FROM x_queries q LEFT JOIN (
          SELECT query_id, string_agg(coalesce(f.corrected, p.word), ' ' ORDER BY position)
                   AS corrected,
                 list(coalesce(f.corrected, p.word) ORDER BY position) AS w
          FROM x_query_words p LEFT JOIN x_fixes f ON p.word = f.word GROUP BY query_id) c
        ON q.query_id = c.query_id""",
    "x_query_tokens": """SELECT DISTINCT query_id, token
        FROM (SELECT query_id, unnest(words) AS token FROM x_prepared)""",
    "x_lexical": """SELECT query_id, video_id, chunk_index, sum(score) AS lexical_score
        FROM x_bm25 JOIN x_query_tokens USING (token) GROUP BY ALL""",
    "x_query_slots": f"SELECT query_id, {hash_slots('corrected')} AS slots FROM x_prepared",
    "x_query_vectors": f"""SELECT query_id,
          list_transform(v, lambda x: (x / n)::FLOAT::DOUBLE) AS q
        FROM (SELECT query_id, v, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n
              FROM (SELECT query_id, {SIGNED_COUNTS} AS v FROM x_query_slots))""",
    "x_similar": """SELECT query_id, video_id, chunk_index, lexical_score,
          (round_even(list_dot_product(embedding::DOUBLE[], q) * 10000000, 0) / 10000000 + 0.0)::FLOAT
            AS cosine
        FROM x_lexical JOIN x_vectors USING (video_id, chunk_index)
        JOIN x_query_vectors USING (query_id)""",
    "x_dense": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY cosine DESC, video_id, chunk_index) AS dense_rank
          FROM x_similar WHERE cosine > 0) WHERE dense_rank <= {SEARCH.dense_cut}""",
    "x_title_queries": f"""SELECT video_id::BIGINT AS query_id, {query_words('title')} AS w
        FROM x_transcripts""",
    "x_title_tokens": """SELECT DISTINCT query_id, token
        FROM (SELECT query_id, unnest(w) AS token FROM x_title_queries)""",
    "x_title_slots": f"""SELECT query_id, {hash_slots("array_to_string(w, ' ')")} AS slots
        FROM x_title_queries""",
    "x_title_vectors": f"""SELECT query_id,
          list_transform(v, lambda x: (x / n)::FLOAT::DOUBLE) AS q
        FROM (SELECT query_id, v, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n
              FROM (SELECT query_id, {SIGNED_COUNTS} AS v FROM x_title_slots))""",
    "x_title_similar": """SELECT query_id, video_id, chunk_index, lexical_score,
          (round_even(list_dot_product(embedding::DOUBLE[], q) * 10000000, 0) / 10000000 + 0.0)::FLOAT
            AS cosine
        FROM (SELECT query_id, video_id, chunk_index, sum(score) AS lexical_score
              FROM x_bm25 JOIN x_title_tokens USING (token) GROUP BY ALL)
        JOIN x_vectors USING (video_id, chunk_index) JOIN x_title_vectors USING (query_id)""",
    "x_pairs": f"""SELECT d.*, title, "start", "end", chunk, corrected,
          list_distinct({query_words('corrected')}) AS wanted,
          array_to_string({query_words('corrected')}, ' ') AS phrase,
          {query_words("lower(title) || ': ' || chunk")} AS seen
        FROM x_dense d JOIN x_knowledge k USING (video_id, chunk_index)
        JOIN x_prepared p USING (query_id)""",
    "x_scored": f"""SELECT *, (1 / (1 + exp(-(
            len(list_intersect(wanted, seen)) / greatest(len(wanted), 1) * {COVERAGE_WEIGHT}
            + (CASE WHEN contains(' ' || array_to_string(seen, ' ') || ' ', ' ' || phrase || ' ')
                    THEN 1.0 ELSE 0.0 END) * {PHRASE_WEIGHT} + {BIAS})::DOUBLE)))::FLOAT
          AS relevance FROM x_pairs""",
    "x_relevant": f"""SELECT * FROM x_scored
        WHERE relevance >= {SEARCH.threshold}::FLOAT""",
    "x_top": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY relevance DESC, video_id, chunk_index) AS rank FROM x_relevant)
        WHERE rank <= {SEARCH.k}""",
    "x_results": f"""SELECT query_id, rank, title, '{SEARCH.url_prefix}' || video_id AS url,
          "start", "end", chunk AS excerpt FROM x_top""",
    "x_context": f"""SELECT query_id, string_agg(
          'TITLE: ' || title || chr(10) || 'URL: ' || url || chr(10)
          || 'START: ' || "start"::VARCHAR || chr(10) || 'END: ' || "end"::VARCHAR || chr(10)
          || 'EXCERPT: ' || excerpt, chr(10) || '{DELIMITER}' || chr(10) ORDER BY rank) AS context
        FROM x_results GROUP BY query_id""",
    "x_answers": """SELECT l.doc_id AS query_id,
          CASE WHEN toxic = 1 THEN 'length' ELSE 'stop' END AS finish_reason,
          CASE WHEN quality = 0 THEN '' ELSE title END AS content
        FROM labels l JOIN x_transcripts t ON l.doc_id::VARCHAR = t.video_id""",
    "x_planted": """SELECT query_id, video_id FROM x_queries, x_transcripts
        WHERE contains(transcript, query)""",
    "x_audit_chunks": """SELECT * FROM x_chunks WHERE video_id NOT IN
        (SELECT video_id FROM x_labels WHERE quality = 0)""",
}

DENSE = """SELECT query_id, video_id, chunk_index, dense_rank, round(cosine::DOUBLE, 6) AS cosine,
    round(lexical_score, 6) AS lexical_score FROM x_dense"""

STREAMED = f"""SELECT t.video_id, creation_date::VARCHAR AS creation_date, title,
    {clean('s.text')} AS transcript
    FROM x_transcripts t JOIN x_texts s ON t.video_id = s.video_id
    WHERE trim(s.text, '{WHITESPACE}') <> '' AND title <> ''"""

TITLES_TOP = f"""SELECT query_id, video_id, chunk_index, dense_rank,
    round(cosine::DOUBLE, 6) AS cosine, round(lexical_score, 6) AS lexical_score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY cosine DESC, video_id, chunk_index) AS dense_rank
      FROM x_title_similar WHERE cosine > 0) WHERE dense_rank <= {SEARCH.dense_cut}"""

KNOWLEDGE = f"""SELECT video_id, chunk_index, title, "start", "end", chunk,
    {WIDTH} AS embedding_width FROM x_knowledge"""

AUDIT = f"""
    SELECT DISTINCT 'chunk_without_transcript' AS issue, video_id,
           0::SMALLINT AS chunk_index
    FROM x_audit_chunks WHERE video_id IN (SELECT video_id FROM x_labels WHERE toxic = 1)
    UNION ALL SELECT 'transcript_without_chunk', video_id, 0 FROM x_transcripts
    WHERE len({words('transcript')}) > 0
      AND video_id NOT IN (SELECT video_id FROM x_labels WHERE toxic = 1)
      AND video_id NOT IN (SELECT video_id FROM x_audit_chunks)
    UNION ALL SELECT 'chunk_without_score', video_id, chunk_index FROM x_audit_chunks
    WHERE video_id IN (SELECT video_id FROM x_labels)
      AND len(list_filter({tokens('chunk')}, lambda x: x <> '')) > 0"""

FUSION = f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY round_even(lexical_score * 1e9, 0) DESC, video_id, chunk_index) AS r FROM x_similar),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY cosine DESC, video_id, chunk_index) AS r FROM x_similar)
    SELECT query_id, video_id, chunk_index, round(sum(1 / ({FUSION_CONSTANT} + r)), 6) AS score
    FROM (SELECT query_id, video_id, chunk_index, r FROM l WHERE r <= 250 UNION ALL
          SELECT query_id, video_id, chunk_index, r FROM c WHERE r <= 250) GROUP BY ALL"""

LEXICAL_TOP = """SELECT query_id, video_id, chunk_index, lexical_rank,
    round(round_even(lexical_score * 1e9, 0) / 1e9, 6) AS lexical_score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY round_even(lexical_score * 1e9, 0) DESC, video_id, chunk_index) AS lexical_rank
          FROM x_lexical) WHERE lexical_rank <= 250"""

STATEMENTS: dict[str, str] = {
    "a1_parquet_scan": "SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'en'",
    "a2_listing_json": """SELECT channel_id, video_id, published_at, title, 'video' AS kind
        FROM x_items""",
    "a2_listing_rejects": """WITH l AS (
          SELECT channel_id, title, video_id::BIGINT // 50 AS p FROM x_items),
        pages AS (SELECT DISTINCT channel_id, p FROM l)
        SELECT '' AS channel_id, 'malformed_json' AS reason, count(*) AS n FROM pages
        WHERE p % 4 = 0 HAVING count(*) > 0
        UNION ALL SELECT channel_id, 'wrong_type', count(*) FROM pages WHERE p % 4 = 1
        GROUP BY channel_id
        UNION ALL SELECT channel_id, 'listed', count(*) FROM l WHERE p % 4 IN (2, 3)
        GROUP BY channel_id
        UNION ALL SELECT channel_id, 'missing_title', count(*) FROM l
        WHERE p % 4 IN (2, 3) AND title = '' GROUP BY channel_id
        UNION ALL SELECT channel_id, 'bad_date', count(*) FROM l
        WHERE p % 4 = 2 AND title <> '' GROUP BY channel_id""",
    "a3_typed_empty_table": """SELECT video_id, creation_date::VARCHAR AS creation_date, title,
        length(transcript) AS n_chars FROM x_transcripts""",
    "a4_append_chunks": "SELECT video_id, chunk_index, chunk FROM x_chunks",
    "a4_append_chunks_co_bucketed": "SELECT video_id, chunk_index, chunk FROM x_chunks",
    "a5_rebuild_bm25": """SELECT token, count(*) AS n_chunks, round(sum(score), 4) AS total_score
        FROM x_bm25 GROUP BY token""",
    "a5_append_bm25": """SELECT token, count(*) AS n_chunks, round(sum(score), 4) AS total_score
        FROM x_bm25 GROUP BY token""",
    "a6_append_transcripts": """SELECT video_id, creation_date::VARCHAR AS creation_date, title,
        transcript FROM x_transcripts""",
    "a7_atomic_publish": """SELECT 'transcripts' AS table_name, count(*) AS n_rows
        FROM x_transcripts UNION ALL SELECT 'chunks', count(*) FROM x_chunks
        UNION ALL SELECT 'bm25', count(*) FROM x_terms""",
    "a8_publish_gates": """SELECT count(*) AS n_rows, 1 AS first_version, 1 AS second_version
        FROM x_terms""",
    "a9_index_audit": AUDIT,
    "a9_audit_by_hashes": AUDIT,
    "i1_newest_per_channel": """SELECT channel_id, video_id, published_at, title FROM x_items
        QUALIFY row_number() OVER (PARTITION BY channel_id
                                   ORDER BY published_at DESC, video_id) <= 20""",
    "i2_required_fields": """SELECT channel_id, video_id, published_at, c.text AS title
        FROM x_items i JOIN conversations c ON i.video_id = c.conv_id::VARCHAR AND c.turn = 0
        WHERE c.text <> '' AND published_at <> '' AND video_id <> ''""",
    "i3_already_ingested": """SELECT video_id, channel_id, published_at, title FROM x_items
        WHERE video_id NOT IN (SELECT video_id FROM x_known)""",
    "i4_snippet_assembly": "SELECT video_id, text FROM x_texts",
    "i5_item_outcomes": "SELECT channel_id, video_id, outcome FROM x_outcomes",
    "i6_timestamp_parse": """SELECT video_id, CASE
          WHEN video_id LIKE '%3' THEN 'rejected'
          WHEN video_id LIKE '%1' THEN (creation_date - INTERVAL 2 HOUR)::VARCHAR
          WHEN video_id LIKE '%2' THEN (creation_date + INTERVAL 330 MINUTE)::VARCHAR
          ELSE creation_date::VARCHAR END AS creation_date FROM x_transcripts""",
    "i7_whitespace_collapse": f"""SELECT page_id,
        regexp_replace(replace(replace(html, '<', chr(10)), '>', chr(10)), '{SPACE}{{2,}}', ' ',
                       'g') AS collapsed FROM pages""",
    "i8_entity_decode": """SELECT page_id, replace(replace(replace(html, '&#39;', ''''),
        '&quot;', ''''), '&amp;', '&') AS decoded FROM pages""",
    "i9_union_of_channels": """SELECT video_id, creation_date::VARCHAR AS creation_date, title,
        transcript FROM x_new""",
    "i10_channel_outcomes": """SELECT channel_id, count(*) AS n_items,
        count(*) FILTER (outcome = 'missing_field') AS n_missing_field,
        count(*) FILTER (outcome = 'existing') AS n_existing,
        count(*) FILTER (outcome = 'unavailable') AS n_unavailable,
        count(*) FILTER (outcome = 'empty') AS n_empty,
        count(*) FILTER (outcome = 'rejected') AS n_rejected,
        count(*) FILTER (outcome = 'new') AS n_new FROM x_outcomes GROUP BY channel_id""",
    "b1_truncate_documents": f"""SELECT video_id,
        array_to_string(list_slice({words('transcript')}, 1, 100), ' ') AS transcript
        FROM x_transcripts""",
    "b2_windows": "SELECT video_id, chunk_index, chunk FROM x_chunks",
    "b2_windows_default_size": windows(IndexSettings(chunk_size=CHUNK_SIZE)),
    "b3_chunk_strip": f"""SELECT video_id, chunk_index,
        trim(chunk, '{WHITESPACE}') = chunk AS is_stripped FROM x_chunks""",
    "b4_documents_without_chunks": f"""SELECT video_id FROM x_transcripts
        WHERE len({words("translate(lower(transcript), 'abcdefghijklmnopqrstuvwxyz.,', '"
                         + " " * 28 + "')")}) = 0""",
    "b5_context_prompts": f"""SELECT c.video_id, chunk_index, md5({template(
            CONTEXT_TEMPLATE,
            transcript=f"array_to_string(list_slice({words('transcript')}, 1, "
                       f"{MAX_DOCUMENT_TOKENS}), ' ')",
            chunk='chunk')}) AS prompt_md5
        FROM x_chunks c JOIN x_transcripts t ON c.video_id = t.video_id""",
    "b6_context_merge": """SELECT video_id, chunk_index, chunk, bare_chunk, is_fallback
        FROM x_contextual""",
    "b7_fallback_rate": """SELECT video_id, count(*) AS n_chunks,
        count(*) FILTER (is_fallback) AS n_fallbacks,
        round(avg(is_fallback::INT), 6) AS fallback_rate FROM x_contextual GROUP BY video_id""",
    "b8_task_prefix": f"""SELECT video_id, chunk_index,
        '{DOCUMENT_PREFIX}' || chunk AS document_text, '{QUERY_PREFIX}' || chunk AS query_text
        FROM x_chunks""",
    "b9_chunk_embedding": """SELECT * FROM (SELECT video_id, chunk_index,
          generate_subscripts(embedding, 1) - 1 AS position,
          round(unnest(embedding)::DOUBLE, 6) AS value FROM x_vectors) WHERE value <> 0""",
    "b10_l2_normalise": """SELECT vec_id, generate_subscripts(v, 1) - 1 AS position,
          round((unnest(v) / n)::FLOAT::DOUBLE, 6) AS value
        FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n
              FROM (SELECT vec_id, list_transform(embedding,
                      lambda x: (x::DOUBLE * (label + 2))::FLOAT)::DOUBLE[] AS v FROM embeddings))""",
    "b11_chunk_record": f"""SELECT video_id, chunk_index, chunk, {WIDTH} AS embedding_width
        FROM x_chunks""",
    "b12_ordered_chunks": """SELECT video_id, chunk_index, length(chunk) AS n_chars
        FROM x_chunks""",
    "b13_vector_width": "SELECT vec_id, len(embedding) AS width FROM embeddings",
    "l1_stop_words": f"""SELECT token, count(*) AS n_dropped
        FROM (SELECT unnest({raw_tokens('chunk')}) AS token FROM x_chunks)
        WHERE list_contains({STOP_WORDS}, token) GROUP BY token""",
    "l2_tokens": """SELECT video_id, chunk_index, array_to_string(tokens, ' ') AS tokens
        FROM x_tokens""",
    "l3_chunk_length": "SELECT video_id, chunk_index, n_tokens FROM x_tokens",
    "l4_corpus_statistics": """SELECT round(avg_n_tokens, 6) AS avg_n_tokens, n_chunks
        FROM x_stats""",
    "l5_term_frequency": "SELECT video_id, chunk_index, n_tokens, token, tf FROM x_terms",
    "l6_idf": "SELECT token, df, round(idf, 6) AS idf FROM x_idf",
    "l7_bm25_scores": "SELECT video_id, chunk_index, token, round(score, 6) AS score FROM x_bm25",
    "l7_bm25_of_versions": """SELECT video_id, chunk_index, token, round(score, 6) AS score
        FROM x_bm25""",
    "k1_chunk_count": "SELECT video_id, chunk_count FROM x_counts",
    "k2_title_join": """SELECT video_id, chunk_index, title FROM x_knowledge WHERE video_id NOT IN
        (SELECT video_id FROM x_labels WHERE toxic = 1)""",
    "k3_marks": 'SELECT video_id, chunk_index, "start", "end" FROM x_knowledge',
    "k4_knowledge_base": KNOWLEDGE,
    "k4_knowledge_base_co_bucketed": KNOWLEDGE,
    "q1_query_punctuation": f"""SELECT query_id,
        translate(query, '{PUNCTUATION}', '{BLANKS}') AS query FROM x_queries""",
    "q2_query_words": "SELECT query_id, position, word FROM x_query_words",
    "q3_spelling": best_correction("x_asked"),
    "q3_spelling_stored": best_correction("x_asked"),
    "q4_corrected_query": "SELECT query_id, query, corrected FROM x_prepared",
    "r1_token_membership": """SELECT query_id, video_id, chunk_index, token
        FROM x_bm25 JOIN x_query_tokens USING (token)""",
    "r2_lexical_score": """SELECT query_id, video_id, chunk_index,
        round(lexical_score, 6) AS lexical_score FROM x_lexical""",
    "r2_lexical_score_of_postings": """SELECT query_id, video_id, chunk_index,
        round(lexical_score, 6) AS lexical_score FROM x_lexical""",
    "r2_lexical_top_pruned": LEXICAL_TOP,
    "r3_passages": """SELECT query_id, video_id, chunk_index, title, "start", "end",
        length(chunk) AS n FROM x_lexical JOIN x_knowledge USING (video_id, chunk_index)""",
    "r4_cosine_of_vectors": """WITH m AS (
          SELECT label, list(x ORDER BY position) AS v FROM (
            SELECT label, position, avg(round(x::DOUBLE, 6)) AS x FROM (
              SELECT label, generate_subscripts(embedding, 1) AS position, unnest(embedding) AS x
              FROM embeddings) GROUP BY label, position) GROUP BY label),
        n AS (SELECT label, list_transform(v, lambda x: (x / s)::FLOAT::DOUBLE) AS mean
              FROM (SELECT *, sqrt(list_dot_product(v, v)) AS s FROM m))
        SELECT vec_id, e.label, round(list_dot_product(embedding::DOUBLE[], mean), 6) AS cosine
        FROM embeddings e JOIN n ON e.label = n.label""",
    "r4_cosine_similarity": """SELECT query_id, video_id, chunk_index,
        round(cosine::DOUBLE, 6) AS cosine FROM x_similar""",
    "r5_positive_similarity": """SELECT * FROM (SELECT query_id, video_id, chunk_index,
        round(cosine::DOUBLE, 6) AS cosine FROM x_similar) WHERE cosine > 0""",
    "r6_dense_top": DENSE,
    "r6_dense_top_in_place": DENSE,
    "r6_dense_top_by_tiles": TITLES_TOP,
    "r6_dense_top_by_bounds": TITLES_TOP,
    "r7_titled_passage": """SELECT video_id, chunk_index, lower(title) || ': ' || chunk
        AS titled_chunk FROM x_knowledge""",
    "r8_rerank_score": """SELECT query_id, video_id, chunk_index,
        round(relevance::DOUBLE, 6) AS relevance FROM x_scored""",
    "r9_relevance_threshold": """SELECT query_id, video_id, chunk_index,
        round(relevance::DOUBLE, 6) AS relevance FROM x_relevant""",
    "r10_top_k": "SELECT query_id, rank, video_id, chunk_index FROM x_top",
    "r11_result_columns": "SELECT * FROM x_results",
    "r12_search": "SELECT * FROM x_results",
    "r12_search_by_joins": "SELECT * FROM x_results",
    "r12_search_by_tiles": "SELECT * FROM x_results",
    "p1_context_blocks": "SELECT query_id, context FROM x_context",
    "p2_user_prompts": f"""SELECT q.query_id, {template(
            USER_TEMPLATE, context="coalesce(context, '')", query='query')} AS prompt
        FROM x_queries q LEFT JOIN x_context c ON q.query_id = c.query_id""",
    "p3_system_prompts": f"""SELECT query_id, {template(
            SYSTEM_TEMPLATE, delimiter=text(DELIMITER), youtube_search_url=text(VIDEO_SEARCH_URL),
            query='query')} AS prompt FROM x_queries""",
    "p4_template_contract": """SELECT query_id, '{' || '{query} ' || query || '}' AS prompt
        FROM x_queries""",
    "p5_answers": f"""SELECT q.query_id,
        CASE WHEN coalesce(content, '') = '' THEN {text(EMPTY_ANSWER)} ELSE content END AS answer,
        coalesce(content, '') <> '' AND coalesce(finish_reason, '') = 'length' AS is_truncated
        FROM x_queries q LEFT JOIN x_answers a ON q.query_id = a.query_id""",
    "p6_context_stripped": """SELECT video_id, chunk_index,
        list_last(string_split(chunk, chr(10))) AS last_line FROM x_contextual""",
    "p7_search_links": f"""SELECT query_id, '{VIDEO_SEARCH_URL}=' ||
        replace(replace(url_encode(query), '+', '%20'), '~', '%7E') AS link FROM x_queries
        WHERE query_id NOT IN (SELECT query_id FROM x_results)""",
    "e1_recall": """WITH best AS (
          SELECT query_id, video_id, min(r) AS best_rank FROM (
            SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id
              ORDER BY relevance DESC, video_id, chunk_index) AS r FROM x_scored) GROUP BY ALL),
        per AS (SELECT k, query_id, count(*) AS n, count(*) FILTER (best_rank <= k) AS found
          FROM x_planted LEFT JOIN best USING (query_id, video_id), (VALUES (1), (3), (10)) t(k)
          GROUP BY ALL)
        SELECT k, count(*) AS n_queries, round(avg(found / n), 6) AS recall,
               round(avg((found > 0)::INT), 6) AS hit_rate FROM per GROUP BY k""",
    "e2_threshold_sweep": """WITH t AS (
          SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9, 0.99])::DOUBLE AS threshold),
        best AS (SELECT query_id, video_id, max(relevance) AS relevance FROM x_scored GROUP BY ALL),
        r AS (SELECT threshold, avg(coalesce(relevance >= threshold::FLOAT, false)::INT) AS recall
              FROM x_planted LEFT JOIN best USING (query_id, video_id), t GROUP BY threshold)
        SELECT t.threshold, round(r.recall, 6) AS recall,
               (SELECT count(*) FROM x_scored WHERE relevance >= t.threshold::FLOAT) AS n_kept
        FROM t JOIN r ON t.threshold = r.threshold""",
    "e3_rank_fusion": FUSION,
    "e3_rank_fusion_pruned": FUSION,
    "u1_model_embedder": """SELECT video_id, generate_subscripts(v, 1) - 1 AS position,
          round((unnest(v) / n)::FLOAT::DOUBLE, 6) AS value
        FROM (SELECT video_id, v, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n FROM (
          SELECT video_id, list_transform(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], lambda c:
            (length(transcript) - length(replace(transcript, c, '')))::DOUBLE) AS v
          FROM x_transcripts))""",
    "u2_model_reranker": """SELECT video_id,
        round((1 / (1 + abs(length(title) - length(transcript))))::FLOAT::DOUBLE, 6) AS relevance
        FROM x_transcripts""",
    "u3_completion_merge": "SELECT video_id, chunk_index, chunk FROM x_contextual",
    "s1_streamed_ingest": STREAMED,
    "s1_transcript_stream": STREAMED,
}


def with_relations(statement: str) -> str:
    """The statement with the relations it needs, in the order of their definition."""
    needed: set[str] = set()
    pending = [statement]
    while pending:
        found = set(re.findall(r"\bx_\w+", pending.pop())) & RELATIONS.keys()
        pending += [RELATIONS[name] for name in found - needed]
        needed |= found
    if not needed:
        return statement
    relations = ", ".join(
        f"{name} AS MATERIALIZED ({body})" for name, body in RELATIONS.items() if name in needed
    )
    return f"WITH {relations} SELECT * FROM ({statement})"


ORACLES = {name: with_relations(statement) for name, statement in STATEMENTS.items()}
