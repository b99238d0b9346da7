"""More registered queries: maintenance, scans and small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import fulltext as X
from ..operators import governance as G
from ..operators import learning as L
from ..operators import maintenance as M
from ..operators import services as W
from .queries import _TOK, query


@query("SELECT id, CASE WHEN id % 2 = 0 THEN source_path ELSE '/lib/' || substr(source_path, 5) END AS path FROM pipelines")
def path_resolution(lib):
    raw = F.when(F.col("id") % 2 == 0, F.col("source_path")).otherwise(F.concat(F.lit("data/books/"), F.substring("source_path", 5, 100)))
    return lib.pipelines.select("id", M.resolve_path(raw, "/lib/").alias("path"))


@query("SELECT id, CASE WHEN starts_with(source_path, '/in/b1') THEN '/new/b1' || substr(source_path, 7) ELSE source_path END AS path FROM pipelines")
def path_prefix_rewrite(lib):
    return lib.pipelines.select("id", M.rewrite_prefix(F.col("source_path"), "/in/b1", "/new/b1").alias("path"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'textbook' ELSE 'unknown' END AS kind FROM chapters")
def type_coercion(lib):
    return lib.chapters.select("id", M.coerce_type(F.when(F.col("id") % 3 == 0, "  TextBook ").otherwise(F.col("lang"))).alias("kind"))


@query("SELECT id, CASE WHEN c >= 0.7 THEN false WHEN c < 0.4 THEN true ELSE id % 2 = 0 AND c < 0.6 END AS ask FROM (SELECT id, (id % 10) / 10.0::DOUBLE AS c FROM chapters)")
def fallback_trigger(lib):
    c = (F.col("id") % 10) / 10.0
    return lib.chapters.select("id", M.needs_fallback(c, F.when(F.col("id") % 2 == 0, "rule").otherwise("model"), 0.4).alias("ask"))


@query("SELECT id FROM chunks WHERE id % 3 <> 0")
def model_mismatch(lib):
    return M.other_model(lib.chunks.select("id", F.when(F.col("id") % 3 == 0, "m2").when(F.col("id") % 3 == 1, "m1").alias("embedding_model")), "m2").select("id")


@query("SELECT book_id, chapter_number, CASE WHEN chapter_number <= 3 THEN 'T' || chapter_number ELSE title END AS title FROM chapters")
def toc_titles(lib):
    return M.positional_titles(lib.chapters, lib.books.select(F.col("id").alias("book_id"), F.array(F.lit("T1"), F.lit("T2"), F.lit("T3")).alias("titles")))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN source_path WHEN id % 3 = 1 THEN '/archive/' || split_part(source_path, '/', 3) END AS path FROM pipelines")
def source_resolution(lib):
    p = lib.pipelines.select("id", "source_path", F.sha2("source_path", 256).alias("content_hash"))
    k = F.col("id") % 3
    files = p.select(F.when(k == 0, F.col("source_path")).otherwise(F.concat(F.lit("/archive/"), F.substring_index("source_path", "/", -1))).alias("path"), F.when(k == 2, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return M.resolve_sources(p, files)


@query("SELECT path, CASE WHEN k = 0 THEN 'f' || g || '.pdf' ELSE 'f' || g || '_' || k || '.pdf' END AS archived FROM (SELECT path, g, row_number() OVER (PARTITION BY g ORDER BY path) - 1 AS k FROM (SELECT '/d' || id || '/f' || id % 20 || '.pdf' AS path, id % 20 AS g FROM pipelines))")
def archive_names(lib):
    i = F.col("id").cast("string")
    return M.archive_names(lib.pipelines.select(F.concat(F.lit("/d"), i, F.lit("/f"), (F.col("id") % 20).cast("string"), F.lit(".pdf")).alias("path")))


@query(
    "SELECT id, CASE WHEN id % 4 = 0 THEN 'archived' ELSE state END AS state, priority, CASE WHEN id % 4 = 0 THEN 'archived:' || id || ':' || h ELSE h END AS content_hash FROM p UNION ALL SELECT -id, 'detected', 3, h FROM p WHERE id % 4 = 0",
    "p AS (SELECT id, state, priority, sha256(source_path) AS h FROM pipelines)",
)
def reingest(lib):
    p = lib.pipelines.select("id", "state", "priority", F.sha2("source_path", 256).alias("content_hash"))
    return M.prepare_reingest(p, p.filter("id % 4 = 0"))


@query("SELECT id, CASE WHEN state = 'hashing' THEN 'approve' ELSE 'skipped' END AS outcome, false AS dry_run FROM pipelines")
def batch_approve(lib):
    p = lib.pipelines.select("id", F.when(F.col("state") == "hashing", "pending_approval").otherwise(F.col("state")).alias("state"))
    return M.batch_decide(p, p, "approve")[1]


@query("SELECT book_id, sha256('Title: ' || any_value(b.title) || chr(10) || 'Author: ' || any_value(author) || chr(10) || 'Contents:' || chr(10) || string_agg(c.title, chr(10) ORDER BY chapter_number) || chr(10) || 'Excerpt:' || chr(10) || arg_min(left(content, 2000), chapter_number)) AS h FROM chapters c JOIN books b ON b.id = book_id GROUP BY book_id")
def classification_text(lib):
    return M.classification_text(lib.books, lib.chapters).select("book_id", F.sha2("text", 256).alias("h"))


@query(r"SELECT id, array_to_string(w[o + 1:o + 40], ' ') AS passage FROM (SELECT id, w, ('0x' || left(sha256('5:' || id), 8))::BIGINT % greatest(1, len(w) - 39) AS o FROM (SELECT id, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS w FROM chapters))")
def passage_sample(lib):
    return M.passages(lib.chapters.select("id", "content"), 40, 5)


@query("SELECT lang AS phase, round(CASE WHEN lang = 'en' THEN 4 + 1.5 * count(*) ELSE 2 + 0.75 * count(*) END, 2)::DOUBLE AS hours FROM chapters GROUP BY lang")
def learning_hours(lib):
    p = lib.chapters.groupBy(F.col("lang").alias("phase")).agg(F.count("*").cast("double").alias("chapters")).withColumn("kind", F.when(F.col("phase") == "en", "learn").otherwise("do"))
    return M.learning_hours(p)


@query()
def chapter_sections(lib):
    return M.split_sections(lib.chapters.select("id", "content"), 1000)


@query("SELECT count(*) AS n, max(created_at) AS newest FROM history")
def staleness_marker(lib):
    return lib.history.agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))


@query("SELECT count(*) AS n FROM history WHERE to_state = 'complete' AND created_at::DATE = DATE '2024-01-15'")
def daily_cap_count(lib):
    return W.done_on(lib.history, "2024-01-15")


@query("SELECT book_id, arg_max(decision, id) AS decision FROM feedback GROUP BY book_id")
def latest_feedback(lib):
    return lib.feedback.groupBy("book_id").agg(F.max_by("decision", "id").alias("decision"))


@query("SELECT id % 40 AS base, arg_max(id, (updated_at, id)) AS newest FROM pipelines GROUP BY ALL")
def newest_by_basename(lib):
    return lib.pipelines.groupBy((F.col("id") % 40).alias("base")).agg(F.max_by("id", F.struct("updated_at", "id")).alias("newest"))


@query(r"SELECT id, regexp_matches(title, '(?i)^preface$|^foreword$|^introduction$|^appendix') AS front, regexp_matches(title, '(?i)page\s+\d+|\bpp?\.\s*\d+|<[^>]+>') AS artifact FROM chapters")
def title_classes(lib):
    t = F.col("title")
    return lib.chapters.select("id", t.rlike(T.NON_CHAPTER_TITLE).alias("front"), t.rlike(T.ARTIFACT_TITLE).alias("artifact"))


@query("SELECT k.id, k.chapter_id, d.source AS book_id FROM chunks k JOIN documents d ON d.doc_id = k.chapter_id WHERE k.embedding IS NOT NULL")
def embedding_scan(lib):
    return lib.search_rows.filter(F.col("embedding").isNotNull()).select("id", "chapter_id", "book_id")


@query("SELECT id, score_p AS score, p AS paragraph FROM (SELECT id, trim(content) AS t, left(trim(content), 500) AS p, (CASE WHEN contains(lower(content), 'the') THEN 10 ELSE 0 END + CASE WHEN contains(lower(content), 'tion') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(content), 'is a |refers to|allows you|enables|provides') THEN 5 ELSE 0 END)::INT AS score_p, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS w FROM chapters) WHERE length(t) >= 40 AND len(w) >= 5 AND len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) / len(w) < 0.5".replace("\\\\", "\\"))
def best_paragraph(lib):
    return L.best_paragraph(lib.chapters, "the tion")


@query("SELECT id, title FROM (SELECT id, title, row_number() OVER (PARTITION BY lower(title) ORDER BY id) AS r FROM chapters) WHERE r = 1 ORDER BY id LIMIT 20")
def related_concepts(lib):
    return W.related_concepts(lib.chapters)


def renewed(chapters):
    """The texts after one document has got another one."""
    return chapters.select("id", "title", F.when(F.col("id") == 3, "a renewed text of the document").otherwise(F.col("content")).alias("content"))


def synced(lib):
    """The stored index, in a fork of its own, after one document is replaced: a segment of that document is added."""
    index = lib.index()
    return index.fork(f"{index.root}-sync").sync(renewed(lib.chapters).filter("id = 3"))


@query("SELECT count(DISTINCT id) AS documents FROM chapters")
def fts_sync(lib):
    """Documents all of whose words are in the index after the sync, and no others. Those without words have no postings, and
    rows of one id are one document."""
    own = renewed(lib.chapters).select("id", F.size(X.tokens(F.concat_ws(" ", "title", "content"))).alias("n")).groupBy("id").agg(F.sum("n").alias("n"))
    return own.join(synced(lib).lengths, "id", "left").filter("coalesce(dl, 0) = n").agg(F.count("id").alias("documents"))


@query("SELECT term, count(*) AS documents, sum(tf)::BIGINT AS tf FROM post GROUP BY term", _TOK.replace("content), '", "CASE WHEN id = 3 THEN 'a renewed text of the document' ELSE content END), '"))
def fts_sync_terms(lib):
    """The whole index after the sync, by term."""
    return synced(lib).postings.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("tf"))


@query("SELECT id, CASE WHEN q = 1 AND t = 0 THEN 'approved' ELSE 'rejected' END AS decision FROM (SELECT doc_id AS id, quality AS q, toxic AS t FROM labels)")
def spot_check_writeback(lib):
    return W.spot_check_results(lib.table("labels"))


def rechunked(chapters):
    """chapter_id, chunks, last, words, reused: chunks of all chapters, with the vectors of stored chunks of equal hash (those of even chapters)."""
    from ..operators.integrity import reuse_vectors

    fresh = C.chunks(chapters.select("id", "content"))
    stored = fresh.filter("chapter_id % 2 = 0").select("chapter_id", "content_hash", F.col("chunk_index").alias("id"), F.lit(1.0).alias("embedding"))
    each = reuse_vectors(fresh, stored).groupBy("chapter_id")
    return each.agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last"), F.sum("word_count").alias("words"), F.count("embedding").alias("reused"))


@query("SELECT count(DISTINCT chapter_id) AS chapters FROM (SELECT id AS chapter_id FROM chapters WHERE word_count > 0)")
def staged_rechunk(lib):
    """Chapters whose chunks are numbered without a gap, hold no fewer words than the text and have all the vectors stored for them."""
    own = lib.chapters.select(F.col("id").alias("chapter_id"), F.col("word_count").alias("own"))
    whole = (F.col("chunks") == F.col("last") + 1) & (F.col("words") >= F.col("own")) & (F.col("reused") == F.when(F.col("chapter_id") % 2 == 0, F.col("chunks")).otherwise(0))
    return rechunked(lib.chapters).join(own, "chapter_id").filter(whole).agg(F.count("*").alias("chapters"))


@query()
def staged_rechunk_chapters(lib):
    """What the re-chunk makes, by chapter; SQL cannot express the fold over sentences."""
    return rechunked(lib.chapters).drop("last")


@query("SELECT book_type, count(*) AS n, count(*) FILTER (WHERE decision = 'approved') AS correct, round(count(*) FILTER (WHERE decision = 'approved') / count(*), 4) AS accuracy FROM feedback GROUP BY book_type")
def accuracy_by_type(lib):
    return lib.feedback.groupBy("book_type").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "approved").alias("correct"), F.round(F.avg((F.col("decision") == "approved").cast("double")), 4).alias("accuracy"))


@query("SELECT state, count(*) AS n FROM pipelines WHERE state IN ('complete', 'needs_retry') GROUP BY state")
def in_list_counts(lib):
    return W.count_states(lib.pipelines, ("complete", "needs_retry")).drop("terminal")


@query(f"SELECT state, count(*) AS n, bool_or(state IN {G.TERMINAL}) AS terminal FROM pipelines GROUP BY state")
def terminal_states(lib):
    return W.count_states(lib.pipelines, terminal=G.TERMINAL)
