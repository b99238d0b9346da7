"""Registered queries of the services: approvals, classification, embedding, excerpts, findings and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import chunking as C
from ..operators import embedding as B
from ..operators import excerpts as P
from ..operators import governance as G
from ..operators import learning as L
from ..operators import services as S
from ..operators import templates as D
from ..sources import reports as R
from ..sources.library import NOW
from .queries import ROLL, _AUD, audited, query

_REQ = """req AS (SELECT id, state0 AS state, CASE id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'rollback' ELSE 'retry' END AS action, CASE WHEN id % 8 = 0 THEN 'auto:partial' ELSE 'me' END AS actor, confidence, lang
  FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'pending_approval' ELSE state END AS state0, confidence, CASE WHEN id % 5 = 0 THEN 'en' ELSE 'fr' END AS lang FROM pipelines)),
pol AS (SELECT id, CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1 THEN 'invalid_confidence' WHEN id % 7 = 0 THEN 'validation_failed' WHEN id % 11 = 0 THEN 'needs_review' WHEN lang = 'fr' AND confidence < 0.2 THEN 'below_threshold' WHEN lang = 'en' THEN 'no_threshold' ELSE 'approve' END AS p
  FROM req WHERE action = 'approve' AND actor = 'auto:partial' AND state = 'pending_approval'),
cap AS (SELECT id FROM pol WHERE p = 'approve' ORDER BY id LIMIT 2),
dec AS (SELECT req.id, action, actor, state, CASE WHEN action = 'approve' AND state <> 'pending_approval' THEN 'not_pending'
  WHEN NOT (action = 'approve' OR (action = 'reject' AND state IN ('classifying', 'processing', 'validating', 'pending_approval', 'needs_retry', 'embedding'))
    OR (action = 'retry' AND state NOT IN ('duplicate', 'needs_retry', 'complete', 'rejected', 'archived', 'failed')) OR (action = 'rollback' AND state IN ('complete', 'rejected', 'failed'))) THEN 'illegal_transition'
  WHEN p <> 'approve' THEN 'auto_approval_denied:' || p WHEN p = 'approve' AND req.id NOT IN (SELECT id FROM cap) THEN 'auto_approval_denied:daily_cap' END AS error,
  CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'retry' THEN 'needs_retry' ELSE 'archived' END AS target FROM req LEFT JOIN pol USING (id))"""


def _decided(lib):
    i = F.col("id")
    p = lib.pipelines.select("id", F.when(i % 3 == 0, "pending_approval").otherwise(F.col("state")).alias("state"), F.when(i % 5 == 0, "en").otherwise("fr").alias("book_type"), "confidence", (i % 7 != 0).alias("valid"), (i % 11 == 0).alias("needs_review"))
    r = p.select("id", F.element_at(F.array(*map(F.lit, ("approve", "reject", "rollback", "retry"))), (i % 4 + 1).cast("int")).alias("action"), F.when(i % 8 == 0, "auto:partial").otherwise("me").alias("actor"), F.lit("why").alias("reason"))
    thresholds = lib.spark.range(1).select(F.lit("fr").alias("book_type"), F.lit(0.2).alias("threshold"))
    return p, S.decisions(p, r, thresholds, "partial", daily_cap=50, used_today=48)


@query("SELECT id, action, error IS NULL AS success, error, CASE WHEN error IS NULL THEN target ELSE state END AS after_state FROM dec", _REQ)
def approval_decisions(lib):
    return _decided(lib)[1].select("id", "action", "success", "error", "after_state")


@query("SELECT id AS pipeline_id, CASE action WHEN 'approve' THEN 'approved' WHEN 'rollback' THEN 'rollback' ELSE 'rejected' END AS action, actor, state AS before_state, target AS after_state FROM dec WHERE error IS NULL", _REQ)
def approval_audit(lib):
    return S.audit_rows(_decided(lib)[1], NOW).select("pipeline_id", "action", "actor", "before_state", "after_state")


@query("SELECT id, CASE WHEN error IS NULL THEN target ELSE state END AS state FROM dec", _REQ)
def approval_states(lib):
    return S.apply_decisions(*_decided(lib)).select("id", "state")


@query("SELECT id AS pipeline_id, book_type, confidence, CASE WHEN id % 2 = 0 THEN 'auto_approved' ELSE 'human_review' END AS original_decision, CASE WHEN id % 2 = 0 THEN 'pending_review' ELSE decision END AS human_decision FROM feedback")
def decision_records(lib):
    rows = lib.feedback.withColumn("actor", F.when(F.col("id") % 2 == 0, "auto:full").otherwise("me"))
    return S.feedback_rows(rows, NOW).drop("created_at")


_REF = f"""fb AS (SELECT * FROM feedback WHERE book_type <> 'de' OR id % 7 = 0), sw AS (SELECT unnest([{", ".join(map(str, G.SWEEP))}]::DOUBLE[]) AS t),
ok AS (SELECT book_type, t FROM fb, sw WHERE confidence >= t GROUP BY ALL HAVING count(*) >= 10 AND avg((decision = 'approved')::INT) >= 0.85),
cal AS (SELECT book_type, count(*) AS n, round(avg((decision = 'approved')::INT), 4) AS acc FROM fb GROUP BY book_type HAVING count(*) >= 50)"""


@query("SELECT book_type, (SELECT max(t) FROM ok WHERE ok.book_type = cal.book_type) AS threshold, n AS samples, acc AS accuracy FROM cal UNION ALL SELECT * FROM (VALUES ('de', 0.5::DOUBLE, 1::BIGINT, 0.25::DOUBLE), ('old', 0.7, 2, 0.75)) v(k, t, n, a) WHERE k NOT IN (SELECT book_type FROM cal)", _REF)
def threshold_refresh(lib):
    fb = lib.feedback.filter("book_type <> 'de' OR id % 7 = 0")
    old = lib.spark.sql("SELECT * FROM VALUES ('de', 0.5D, 1L, 0.25D), ('old', 0.7D, 2L, 0.75D) AS v(book_type, threshold, samples, accuracy)")
    return S.refresh_thresholds(fb, old, 0.85, 50)


_KINDS = (("textbook", ("data", "ip")), ("manual", ("license",)))


@query(
    "SELECT id, CASE WHEN known THEN 'cached' WHEN c LIKE '%data%' OR c LIKE '%ip%' THEN 'textbook' WHEN c LIKE '%license%' THEN 'manual' WHEN c LIKE '%the%' THEN 'novel' ELSE 'unknown' END AS book_type, "
    "CASE WHEN known THEN 'cache' WHEN c LIKE '%data%' OR c LIKE '%ip%' OR c LIKE '%license%' THEN 'primary' WHEN c LIKE '%the%' THEN 'fallback' ELSE 'none' END AS source FROM (SELECT *, lower(left(content, 2000)) AS c, id % 7 <> 3 AND content_hash IN (SELECT content_hash FROM kn) AS known FROM chapters)",
    "kn AS (SELECT DISTINCT content_hash FROM chapters WHERE id % 6 = 0)",
)
def classify_books(lib):
    """By the first 2,000 characters; every seventh chapter has no hash, and so is in no cache."""
    every = lib.chapters.select("id", "content_hash", F.col("content").alias("text"))
    rows = every.withColumn("content_hash", F.when(F.col("id") % 7 != 3, F.col("content_hash")))
    known = every.filter("id % 6 = 0").select("content_hash").distinct().select("content_hash", F.lit("cached").alias("book_type"), F.lit(0.9).alias("confidence"))
    return S.classify(rows, known, S.KeywordClassifier(_KINDS), S.KeywordClassifier((("novel", ("the",)),), 0.4), sample=2000).select("id", "book_type", "source")


@query("SELECT c.id, CASE WHEN c.id % 9 = 0 THEN 'PDF document: b' || c.id || '.PDF' ELSE left(content, 40000) END AS sample FROM chapters c")
def classification_samples(lib):
    path = F.when(F.col("id") % 9 == 0, F.concat(F.lit("/in/b"), F.col("id").cast("string"), F.lit(".PDF"))).otherwise("/in/x.epub")
    return S.classification_sample(lib.chapters.select("id", "content", path.alias("source_path")))


@query("SELECT id, title FROM chapters WHERE id NOT IN (SELECT chapter_id FROM chunks WHERE id % 3 = 0)")
def chapters_not_staged(lib):
    return S.absent(lib.chapters.select("id", "title"), lib.chunks.filter("id % 3 = 0"))


_TYPED = "SELECT id, CASE WHEN right(id, 1) IN ('1', '2', '3') THEN NULL ELSE 'textbook' END AS book_type, CASE WHEN right(id, 1) = '1' THEN 'manual' WHEN right(id, 1) = '2' THEN 'unknown' END AS profile FROM books"


def _typed(lib):
    end = F.substring("id", -1, 1)
    return lib.books.select("id", F.when(~end.isin("1", "2", "3"), "textbook").alias("book_type")), lib.books.select("id", F.when(end == "1", "manual").when(end == "2", "unknown").alias("book_type"))


@query("SELECT id AS book_id, profile AS profile_type, coalesce(profile = 'manual', false) AS fixable FROM t WHERE book_type IS NULL", f"t AS ({_TYPED})")
def null_type_books(lib):
    return S.null_types(*_typed(lib), ("textbook", "manual", "unknown"))


@query("SELECT id, CASE WHEN book_type IS NULL AND profile = 'manual' THEN 'manual' ELSE book_type END AS book_type FROM t", f"t AS ({_TYPED})")
def null_type_fixes(lib):
    books, profiles = _typed(lib)
    return S.fix_types(books, S.null_types(books, profiles, ("textbook", "manual", "unknown")))


@query(
    "SELECT 'null_content_hash' AS category, count(*) AS n, count(*) FILTER (WHERE id % 2 = 0) AS fixable FROM chapters WHERE id % 10 = 0 UNION ALL SELECT 'null_book_type', count(*), count(*) FILTER (WHERE profile = 'manual') FROM t WHERE book_type IS NULL "
    "UNION ALL SELECT 'orphaned_chunks', count(*), count(*) FROM chunks_orphaned o WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.id = o.chapter_id)", f"t AS ({_TYPED})",
)
def doctor_findings(lib):
    from ..operators import integrity as I

    hashed = lib.chapters.select("id", F.when(F.col("id") % 10 != 0, F.col("content_hash")).alias("content_hash"))
    return S.findings({
        "null_content_hash": (I.null_hashes(hashed), F.col("id") % 2 == 0),
        "null_book_type": (S.null_types(*_typed(lib), ("textbook", "manual", "unknown")), F.col("fixable")),
        "orphaned_chunks": (I.orphan_chunks(lib.chunks_orphaned, lib.chapters.select("id")), F.lit(True)),
    })


@query("SELECT id, CASE WHEN id % 10 = 0 THEN sha256(content) ELSE content_hash END AS content_hash FROM chapters")
def backfilled_hashes(lib):
    from ..operators import integrity as I

    return I.backfill_hashes(lib.chapters.select("id", "content", F.when(F.col("id") % 10 != 0, F.col("content_hash")).alias("content_hash"))).select("id", "content_hash")


@query("SELECT book_id, round(chapters / e, 4) AS ratio, CASE WHEN chapters / e > 1.5 THEN 'over_count' WHEN chapters / e < 0.65 THEN 'under_count' END AS issue FROM (SELECT book_id, chapters, 20 + substr(book_id, 4)::INT * 5 AS e FROM roll)", ROLL)
def toc_count_ratio(lib):
    rollup = A.book_rollup(lib.chapters, lib.chunks.select("chapter_id").distinct())
    return S.toc_ratio(rollup, lib.books.select(F.col("id").alias("book_id"), (F.substring("id", 4, 9).cast("int") * 5 + 20).alias("entries")))


@query("SELECT book_id, round(words / nullif(s, 0), 4) AS coverage, coalesce(words / nullif(s, 0) >= 0.5, true) AS passed FROM (SELECT book_id, words, substr(book_id, 4)::INT * 5000 AS s FROM roll)", ROLL)
def source_coverage(lib):
    rollup = A.book_rollup(lib.chapters, lib.chunks.select("chapter_id").distinct())
    return S.source_coverage(rollup, lib.books.select(F.col("id").alias("book_id"), (F.substring("id", 4, 9).cast("int") * 5000).alias("source_words")))


@query("SELECT severity, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share FROM (SELECT ['ok', 'warning', 'bad'][list_max(s) + 1] AS severity FROM i) GROUP BY severity", _AUD)
def severity_distribution(lib):
    return S.severity_counts(audited(lib))


@query("SELECT id, CASE id % 4 WHEN 0 THEN '/r/' || id WHEN 1 THEN '/d/books/' || book_id || '/chapters/' || n || '-dir' WHEN 2 THEN '/d/books/' || book_id || '/chapters/' || n || '-a.md' ELSE '/d/processed/' || book_id || '/chapters/' || n || '-b.txt' END AS path, id % 4 = 1 AS is_folder FROM (SELECT *, CASE WHEN chapter_number < 10 THEN '0' ELSE '' END || chapter_number AS n FROM chapters)")
def chapter_paths(lib):
    c = lib.chapters.select("id", "book_id", "chapter_number")
    n = F.when(F.col("chapter_number") < 10, F.concat(F.lit("0"), F.col("chapter_number").cast("string"))).otherwise(F.col("chapter_number").cast("string"))
    at = lambda root, end: F.concat(F.lit(f"/d/{root}/"), "book_id", F.lit("/chapters/"), n, F.lit(end))
    k, own = F.col("id") % 4, F.concat(F.lit("/r/"), F.col("id").cast("string"))
    file = lambda condition, path, folder=False: F.struct(F.when(condition, path).alias("path"), F.lit(folder).alias("is_folder"))
    has = F.array(file(k == 0, own), file(k <= 1, at("books", "-dir"), True), file(k.isin(1, 2), at("books", "-a.md")), file(k == 2, at("books", "-0.txt")), file(k >= 2, at("processed", "-b.txt")))
    files = c.select(F.inline(has)).filter("path IS NOT NULL")
    return S.find_chapter_paths(c.withColumn("file_path", own), files)


@query("SELECT id, title FROM (SELECT id, title, CASE WHEN id = 'src1' THEN 0 ELSE 1 END AS p FROM books WHERE id = 'src1' OR contains(lower(title), 'src1')) ORDER BY p, title, id LIMIT 1")
def book_by_id(lib):
    return S.resolve_book(lib.books.select("id", "title"), "src1")[0]


@query("SELECT id, title FROM books WHERE contains(lower(title), 'book src1') ORDER BY title, id LIMIT 1")
def book_by_slug(lib):
    return S.resolve_book(lib.books.select("id", "title"), "Book-SRC1")[0]


@query("SELECT id, title FROM books WHERE contains(lower(title), 'book') ORDER BY title, id LIMIT 3")
def book_suggestions(lib):
    return S.resolve_book(lib.books.select("id", "title"), "book-unheard-of")[1]


@query("SELECT pipeline_id, actor, action, id FROM (SELECT pipeline_id, 'a' || id % 3 AS actor, to_state AS action, created_at AS performed_at, id FROM history) WHERE actor = 'a1' AND action = 'complete' AND performed_at >= TIMESTAMP '2024-01-11' ORDER BY performed_at DESC, id LIMIT 50")
def audit_trail(lib):
    rows = lib.history.select("pipeline_id", F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("actor"), F.col("to_state").alias("action"), F.col("created_at").alias("performed_at"), "id")
    return S.audit_trail(rows, actor="a1", action="complete", since="2024-01-11", limit=50).drop("performed_at")


@query("SELECT title AS concept, k AS key, a AS analogy FROM (SELECT title, k, a, row_number() OVER (PARTITION BY title ORDER BY CASE WHEN k = lower(title) THEN 0 ELSE 1 END, place) AS r FROM (SELECT DISTINCT title FROM chapters) LEFT JOIN (VALUES (1, 'the', 'x'), (2, 'tion', 'y'), (3, 'of the', 'z')) v(place, k, a) ON contains(lower(title), k) OR contains(k, lower(title))) WHERE r = 1")
def analogies(lib):
    known = lib.spark.sql("SELECT * FROM VALUES (1, 'the', 'x'), (2, 'tion', 'y'), (3, 'of the', 'z') AS v(place, key, analogy)")
    return S.analogy(lib.chapters.select(F.col("title").alias("concept")).distinct(), known)


@query("SELECT id, round(score, 1) AS score, CASE WHEN round(score, 1) < 20 THEN 'simple' WHEN round(score, 1) < 40 THEN 'moderate' ELSE 'complex' END AS level FROM (SELECT id, 2.0 * (id % 7) + (word_count // 50) // 5 + 1.5 * (id % 4) + 2.0 * (id % 3) + id % 5 AS score FROM chapters)")
def complexity_scores(lib):
    i = F.col("id")
    return S.complexity(lib.chapters.select("id", (i % 7).alias("phases"), F.expr("word_count div 50").alias("days"), (i % 4).alias("components"), (i % 3).alias("integrations"), (i % 5).alias("decisions")))


@query("SELECT id, CASE WHEN chapter_number % 10 = 3 THEN 'New ' || chapter_number ELSE title END AS title FROM chapters")
def title_updates(lib):
    c = lib.chapters.select("id", "book_id", "chapter_number", "title")
    new = c.filter("chapter_number % 10 = 3").select("book_id", "chapter_number", F.concat(F.lit("New "), F.col("chapter_number").cast("string")).alias("new_title"))
    return S.retitle(c, new).select("id", "title")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = "ln AS (SELECT id, split_part(content, chr(10), 1) AS a, split_part(content, chr(10), 2) AS b, split_part(content, chr(10), 3) AS c FROM chapters)"


@query("SELECT id, CASE id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' ELSE 'text' END AS language, CASE WHEN left(trim(a || chr(10)), 100) <> left(trim(b || chr(10)), 100) THEN 2 ELSE 1 END::BIGINT AS n FROM ln", _LINES)
def code_language_counts(lib):
    """The first line of each text as a block twice, the second once."""
    name = F.element_at(F.array(F.lit("Python"), F.lit("sql"), F.lit("")), (F.col("id") % 3 + 1).cast("int"))
    line = lambda k: F.coalesce(F.get(F.split("content", "\n"), F.lit(k)), F.lit(""))
    block = lambda body: F.concat(F.lit("```"), name, F.lit("\n"), body, F.lit("\n```\n"))
    text = F.concat(block(line(0)), F.lit("between\n"), block(line(0)), block(line(1)))
    return S.language_counts(L.code_blocks(lib.chapters.select("id", text.alias("content"))))


_EX = f"""{_LINES}, pc AS (SELECT id, 0 AS k, 'sql' AS language, 'fenced' AS format, trim(b, {_WS}) AS code, trim(a, {_WS}) AS t, 200 AS n FROM ln
  UNION ALL SELECT id, 1, 'bash', 'inline', trim('$ ' || c, {_WS}), '', 150 FROM ln WHERE regexp_matches(c, '^\\s*\\S') AND len(trim('$ ' || c, {_WS})) > 10
  UNION ALL SELECT id, 2, 'bash', 'inline', 'docker run ' || id || chr(10) || '  --name x', 'Then', 150 FROM ln),
ex AS (SELECT *, row_number() OVER (PARTITION BY id, left(code, 100) ORDER BY k) AS r FROM pc)"""


@query("SELECT id, language, format, code, (len(code) - len(replace(code, chr(10), '')) + 1)::INT AS line_count FROM ex WHERE r = 1", _EX)
def code_examples(lib):
    """The second line of each text in a fence, the third after a $, and a command over two lines, by SQL with LATERAL."""
    from ..functions import table

    table.register(lib.spark)
    line = lambda k: F.coalesce(F.get(F.split("content", "\n"), F.lit(k)), F.lit(""))
    told = F.concat(line(0), F.lit("\n```SQL\n"), line(1), F.lit("\n```\n$ "), line(2), F.lit("\nThen docker run "), F.col("id").cast("string"), F.lit("\n  --name x\nend."))
    return lib.spark.sql("SELECT id, x.language, x.format, x.code, x.line_count FROM {docs}, LATERAL quire_code(content) x", docs=lib.chapters.select("id", told.alias("content")))


@query("SELECT book_id, words FROM (SELECT book_id, CASE WHEN right(book_id, 1) <> '4' THEN words END AS words FROM roll) ORDER BY words DESC NULLS LAST, book_id LIMIT 19", ROLL)
def largest_books(lib):
    rollup = A.book_rollup(lib.chapters, lib.chunks.select("chapter_id").distinct())
    return S.by_size(rollup.select("book_id", F.when(F.substring("book_id", -1, 1) != "4", F.col("words")).alias("words")), 19)


@query("SELECT id, chapter_id FROM chunks WHERE id % 2 = 0")
def staged_eval_rows(lib):
    staging = lib.chunks.withColumn("embedding", F.when(F.col("id") % 2 == 0, F.col("embedding")))
    return R.evaluated_rows({"chunks": lib.chunks, "chunks_staging": staging}, "chunks_staging").select("id", "chapter_id")


# -- vectors and excerpts ----------------------------------------------------------------------------------------


class _Picky(B.HashEmbedder):
    """An embedder that refuses texts with bold marks: errors of single texts."""

    def __call__(self, texts):
        if any("**" in t for t in texts):
            raise ValueError("a text is refused")
        return super().__call__(texts)


def _tracked(lib):
    i, h = F.col("id"), F.col("content_hash")
    now = lib.chapters.select("id", "content", F.lit(10).alias("mtime"), h.alias("hash"))
    old = lib.chapters.filter("id % 5 <> 0").select("id", F.when(i % 5 == 1, 10).when(i % 5 != 4, 5).alias("mtime"), F.when(i % 5 == 2, "other").otherwise(h).alias("hash"))
    return now, old


_CHANGE = "ch AS (SELECT id, CASE id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'modified' WHEN 3 THEN 'touched' ELSE 'no_tracking' END AS change, contains(content, '**') OR trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS bad FROM chapters)"


@query("SELECT id, change, bad AS failed FROM ch WHERE change NOT IN ('unchanged', 'touched')", _CHANGE)
def incremental_embed(lib):
    return B.incremental(*_tracked(lib), _Picky()).select("id", "change", F.col("error").isNotNull().alias("failed"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE w AND NOT bad) AS updated, count(*) FILTER (WHERE w AND bad) AS errors, count(*) FILTER (WHERE NOT w) AS skipped FROM (SELECT *, change NOT IN ('unchanged', 'touched') AS w FROM ch)", _CHANGE)
def embed_report(lib):
    now, old = _tracked(lib)
    return B.sync_report(now, B.incremental(now, old, _Picky()))


@query("SELECT id, CASE WHEN change IN ('unchanged', 'touched') OR bad THEN 'old' ELSE 'hash-64' END AS embedding_model FROM ch WHERE NOT (change = 'new' AND bad)", _CHANGE)
def embedding_sink(lib):
    now, old = _tracked(lib)
    stored = lib.chapters.filter("id % 5 <> 0").select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("old").alias("embedding_model"), F.to_timestamp(F.lit("2024-01-01")).alias("updated_at"))
    return B.store_vectors(stored, B.incremental(now, old, _Picky()), "hash-64", NOW).select("id", "embedding_model")


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TITLED = r"NOT contains(x.b, chr(10)) AND regexp_matches(x.b, '^#{1,6}\s+\S')"
_FOLDED = rf"""bl AS (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(regexp_replace(content, '(?m)^(\S+ \S+)$', '## \1', 'g'), chr(10), chr(10) || chr(10)), '(?m)^(#{{1,6}}\s)', chr(10) || chr(10) || '\1', 'g'), '\n\n+'),
  lambda b: trim(b, {_WHITE})), lambda b: b <> '') AS b FROM chapters),
fo AS (SELECT id, list_reduce(list_transform(b, lambda b: {{'b': b, 'c': '', 'o': []::VARCHAR[]}}), lambda a, x: {{'b': x.b,
  'c': CASE WHEN {_TITLED} THEN x.b || chr(10) WHEN length(a.c || x.b) >= 50 THEN '' ELSE a.c || x.b || ' ' END,
  'o': CASE WHEN NOT ({_TITLED}) AND length(a.c || x.b) >= 50 THEN list_append(a.o, a.c || x.b) ELSE a.o END}}, {{'b': '', 'c': '', 'o': []::VARCHAR[]}}) AS r FROM bl),
pa AS (SELECT id, CASE WHEN trim(r.c, {_WHITE}) = '' THEN r.o WHEN len(r.o) = 0 THEN [trim(r.c, {_WHITE})] ELSE list_append(r.o[1:len(r.o) - 1], r.o[len(r.o)] || ' ' || trim(r.c, {_WHITE})) END AS p FROM fo)"""


@query("SELECT id, unnest(range(0, len(p)))::INT AS para, unnest(p) AS paragraph FROM pa", _FOLDED)
def paragraphs_for_excerpts(lib):
    """Every line is a block and lines of two words are titles: titles lead their paragraphs, short blocks are put together."""
    text = F.replace(F.regexp_replace("content", r"(?md)^(\S+ \S+)$", "## $1"), F.lit("\n"), F.lit("\n\n"))
    return P.paragraph_rows(lib.chapters.select("id", text.alias("content")))


@query()
def relevant_excerpts(lib):
    """The best paragraph of every chapter for one query; tests hold the operator against a brute-force version."""
    embedder = B.HashEmbedder()
    return P.relevant_excerpts(lib.chapters.select("id", F.replace("content", F.lit("\n"), F.lit("\n\n")).alias("content")), embedder(["the license of the data"])[0], embedder).select("id", "excerpt")


@query()
def token_limited_chunks(lib):
    """Chunks of all chapters, none of more than 300 tokens."""
    return C.chunks(lib.chapters.select("id", "content"), max_tokens=300).groupBy("chapter_id").agg(F.count("*").alias("n"), F.max("word_count").alias("most"))


#: Phases of the kinds that `plan_documents` tells apart; the third kind has none.
_PHASES = (("first", 1, "learn", 5), ("first", 2, "build | test", 12), ("second", 1, "write", 3))
_PLANS = "kinds AS (SELECT item_id, text, CASE WHEN a + b = 0 THEN 'generic' WHEN a >= b THEN 'first' ELSE 'second' END AS kind FROM (SELECT item_id, text, contains(lower(text), 'the ')::INT AS a, contains(lower(text), ' de ')::INT AS b FROM benchmark)), ph AS (SELECT * FROM (VALUES " + ", ".join(map(str, _PHASES)) + """) AS v(kind, position, phase, days)),
dated AS (SELECT item_id, position, phase, days, DATE '2024-03-01' + coalesce(sum(days + 1) OVER (PARTITION BY item_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS starts FROM kinds JOIN ph USING (kind)),
body AS (SELECT item_id, '| Phase | Days | Starts | Ends |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || replace(phase, '|', '\\|') || ' | ' || days || ' | ' || starts || ' | ' || (starts + days::INT) || ' |', chr(10) ORDER BY position) AS body FROM dated GROUP BY item_id)"""


@query("SELECT item_id, '# Plan: ' || coalesce(text, '') || chr(10) || chr(10) || 'Kind: ' || kind || chr(10) || chr(10) || coalesce(body, '') || chr(10) AS document FROM kinds LEFT JOIN body USING (item_id)", _PLANS)
def plan_documents(lib):
    """A plan for every benchmark text, taken as a goal."""
    b = lib.table("benchmark")
    goals = L.detect_kind(b, {"first": ("the ",), "second": (" de ",)}).select("item_id", F.col("text").alias("goal"), "kind")
    return D.plans(goals, lib.spark.createDataFrame(_PHASES, "kind string, position int, phase string, days int"), "2024-03-01", "item_id")
