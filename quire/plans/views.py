"""The same views in DuckDB's SQL, put before each oracle query."""

VIEWS = r"""
chapters AS (SELECT doc_id AS id, source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS chapter_number, left(split_part(text, chr(10), 1), 80) AS title,
  text AS content, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS word_count, sha256(text) AS content_hash, lang FROM documents),
books AS (SELECT book_id AS id, 'Book ' || book_id AS title, 'Author ' || (substr(book_id, 4)::INT % 7) AS author, sum(word_count)::BIGINT AS word_count FROM chapters GROUP BY book_id),
chunks AS (SELECT vec_id AS id, vec_id // 4 AS chapter_id, vec_id % 4 AS chunk_index, embedding::DOUBLE[] AS embedding, label FROM embeddings),
search_rows AS (SELECT k.id, k.chapter_id, d.source AS book_id, k.chunk_index, k.embedding, 'Book ' || d.source AS book_title FROM chunks k JOIN documents d ON d.doc_id = k.chapter_id),
chunks_orphaned AS (SELECT vec_id AS id, vec_id * 3 AS chapter_id FROM embeddings),
ev AS (SELECT *, CASE event_type WHEN 'signup' THEN 'detected' WHEN 'view' THEN 'hashing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'needs_retry' END AS to_state FROM events),
history AS (SELECT event_id AS id, user_id AS pipeline_id, lag(to_state) OVER w AS from_state, to_state, lag(ts) OVER w AS since, ts AS created_at, value FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
pipelines AS (SELECT user_id AS id, arg_max(to_state, (ts, event_id)) AS state, (user_id % 10)::INT AS priority, round(arg_max(value, (ts, event_id)) / 500, 3) AS confidence,
  '/in/b' || user_id || CASE WHEN user_id % 2 = 0 THEN '.epub' ELSE '.pdf' END AS source_path, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS retry_count, min(ts) AS created_at, max(ts) AS updated_at FROM ev GROUP BY user_id),
feedback AS (SELECT d.doc_id AS id, d.source AS book_id, d.lang AS book_type, (d.doc_id % 21 + 80) / 100.0::DOUBLE AS confidence, CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS decision, toxic FROM documents d JOIN labels USING (doc_id)),
reading AS (SELECT book_id, chapter_number, CASE WHEN quality = 1 THEN 'read' ELSE 'reading' END AS status, id AS chapter_id, toxic FROM chapters JOIN labels ON labels.doc_id = chapters.id)
"""


def sql(query: str, extra: str = "") -> str:
    """The query after the views; extra: further common tables, each followed by a comma."""
    return f"WITH RECURSIVE {VIEWS.strip()}{',' + extra.strip().rstrip(',') if extra else ''}\n{query.strip()}"
