"""What the library's services decide: approvals with their records, thresholds, classification, findings, small look-ups.

All are set-based: requests are a table, and so are the outcomes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.executors import map_arrow
from .governance import TRANSITIONS, auto_approval, calibration, threshold_sweep

#: State that a request leads to.
TARGET = {"approve": "approved", "reject": "rejected", "retry": "needs_retry", "rollback": "archived"}
# Names of actions in audit rows.
ACTION = {"approve": "approved", "reject": "rejected", "retry": "rejected", "rollback": "rollback"}


def _map(of: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), key)


def decisions(pipelines: DataFrame, requests: DataFrame, thresholds: DataFrame, mode: str = "supervised", escape_hatch: bool = False, used_today: int = 0, daily_cap: int = 50) -> DataFrame:
    """id, action, actor, reason, success, error, before_state, after_state of each request.

    pipelines: id, state, book_type, confidence, valid, needs_review. requests: id, action (approve, reject, retry, rollback),
    actor, reason. Of several requests for a pipeline the first by action and actor counts. Only legal transitions succeed, and
    approvals only from pending_approval; what an automatic actor asks for is put to the policy again. The cap counts this
    batch, in order of id, on top of used_today.
    """
    first = F.row_number().over(Window.partitionBy("id").orderBy("action", "actor"))
    asked = requests.select("id", "action", "actor", "reason").withColumn("_r", first).filter("_r = 1").drop("_r")
    j = asked.join(pipelines.select("id", "state", "book_type", "confidence", "valid", "needs_review"), "id", "left")
    auto = j.filter((F.col("action") == "approve") & F.startswith("actor", F.lit("auto:")) & (F.col("state") == "pending_approval"))
    policy = auto_approval(auto.select("id", "book_type", "confidence", "valid", "needs_review"), thresholds, mode, escape_hatch, used_today, daily_cap).select("id", F.col("decision").alias("_policy"))
    # At most daily_cap rows are allowed: the first by id.
    allowed = policy.filter("_policy = 'approve'").orderBy("id").limit(max(0, daily_cap - used_today)).select("id", F.lit(True).alias("_allowed"))
    j = j.join(policy, "id", "left").join(allowed, "id", "left")
    legal = F.array_contains(F.element_at(F.create_map(*(x for s, to in TRANSITIONS.items() for x in (F.lit(s), F.array(*map(F.lit, to)).cast("array<string>")))), F.col("state")), _map(TARGET, F.col("action")))
    error = (
        F.when(F.col("state").isNull(), "not_found").when(~F.col("action").isin(*TARGET), "unknown_action").when((F.col("action") == "approve") & (F.col("state") != "pending_approval"), "not_pending")
        .when(~F.coalesce(legal, F.lit(False)), "illegal_transition").when(F.col("_policy").isNotNull() & (F.col("_policy") != "approve"), F.concat(F.lit("auto_approval_denied:"), "_policy"))
        .when(F.col("_policy").isNotNull() & F.col("_allowed").isNull(), "auto_approval_denied:daily_cap")
    )
    j = j.withColumn("error", error)
    return j.select("id", "action", "actor", "reason", F.col("error").isNull().alias("success"), "error", F.col("state").alias("before_state"), F.when(F.col("error").isNull(), _map(TARGET, F.col("action"))).otherwise(F.col("state")).alias("after_state"))


def apply_decisions(pipelines: DataFrame, decided: DataFrame) -> DataFrame:
    """pipelines after the successful decisions; a row whose state is no longer the one decided on stays as it is."""
    d = decided.filter("success").select("id", F.col("before_state").alias("_before"), F.col("after_state").alias("_after"))
    same = F.col("state") == F.col("_before")
    return pipelines.join(d, "id", "left").withColumn("state", F.when(same & F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("state"))).select(pipelines.columns)


def audit_rows(decided: DataFrame, now: str) -> DataFrame:
    """pipeline_id, action, actor, reason, before_state, after_state, performed_at: one for each success. To be stored before
    the pipelines are."""
    d = decided.filter("success")
    return d.select(F.col("id").alias("pipeline_id"), _map(ACTION, F.col("action")).alias("action"), "actor", "reason", "before_state", "after_state", F.to_timestamp(F.lit(now)).alias("performed_at"))


def feedback_rows(approvals: DataFrame, now: str) -> DataFrame:
    """Records for the autonomy measures of (id, book_type, confidence, decision, actor): what an automatic actor approved waits for review."""
    auto = F.startswith("actor", F.lit("auto:"))
    return approvals.select(
        F.col("id").alias("pipeline_id"), F.coalesce("book_type", F.lit("unknown")).alias("book_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(auto, "auto_approved").otherwise("human_review").alias("original_decision"), F.when(auto, "pending_review").otherwise(F.col("decision")).alias("human_decision"), F.to_timestamp(F.lit(now)).alias("created_at"),
    )


def refresh_thresholds(feedback: DataFrame, old: DataFrame, target: float = 0.95, least: int = 50) -> DataFrame:
    """book_type, threshold, samples, accuracy: measured anew for types with enough decisions, as they were for the others."""
    own = feedback.filter(F.col("decision").isin("approved", "rejected") & F.col("book_type").isNotNull())
    fresh = calibration(own, least).select("book_type", F.col("n").alias("samples"), "accuracy").join(threshold_sweep(own, target), "book_type", "left").select("book_type", "threshold", "samples", "accuracy")
    return old.select(fresh.columns).join(fresh.select("book_type"), "book_type", "left_anti").unionByName(fresh)


# -- classification ----------------------------------------------------------------------------------------------------

#: (type, confidence) of a text, or an exception.
Classifier = Callable[[str], tuple[str, float]]


class KeywordClassifier:
    """The default without any service: the first type one of whose words stands in the text."""

    def __init__(self, words: Sequence[tuple[str, Sequence[str]]], confidence: float = 0.6):
        self.words, self.confidence = [(t, [w.lower() for w in ws]) for t, ws in words], confidence

    def __call__(self, text: str) -> tuple[str, float]:
        low = text.lower()
        for kind, words in self.words:
            if any(w in low for w in words):
                return kind, self.confidence
        raise LookupError("no type fits")


def classify(rows: DataFrame, known: DataFrame, primary: Classifier, fallback: Classifier | None = None, sample: int = 40_000) -> DataFrame:
    """id, book_type, confidence, source (cache, primary, fallback, none): one row for each row.

    rows: id, content_hash, text. known: content_hash, book_type, confidence, one row a hash. The classifiers see the first
    `sample` characters, which alone are moved, once for each hash that isn't known. A row without hash is never known; such
    rows are told apart by the hashes of their samples. Where both classifiers fail the type is unknown and the confidence 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for source, model in (("primary", primary), ("fallback", fallback)):
                    try:
                        kind, confidence = model(text or "")  # a missing fallback fails, too
                        out.append((h, kind, float(confidence), source))
                        break
                    except Exception:
                        continue
                else:
                    out.append((h, "unknown", 0.0, "none"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.float64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.string(), pa.float64(), pa.string())], names=["_key", "book_type", "confidence", "source"])

    text = F.substring(F.coalesce("text", F.lit("")), 1, sample)
    own = F.coalesce("content_hash", F.concat(F.lit("sample "), F.sha2(text, 256)))
    keyed = rows.select("id", "content_hash", own.alias("_key"), text.alias("_sample"))
    cache = known.filter(F.col("content_hash").isNotNull()).select(F.col("content_hash").alias("_key"), "book_type", "confidence", F.lit("cache").alias("source"))
    fresh = keyed.join(cache.select("_key"), "_key", "left_anti").groupBy("_key").agg(F.first("_sample").alias("_sample"))
    made = map_arrow(fresh.select("_key", "_sample"), run, "_key string, book_type string, confidence double, source string")
    return keyed.select("id", "_key").join(cache.unionByName(made), "_key").select("id", "book_type", "confidence", "source")


def classification_sample(docs: DataFrame, n: int = 40_000, path: str = "source_path", text: str = "content") -> DataFrame:
    """id, sample: the first n characters; for a PDF, whose text is read elsewhere, a line that names the file."""
    name = F.concat(F.lit("PDF document: "), F.substring_index(path, "/", -1))
    return docs.select("id", F.when(F.lower(path).endswith(".pdf"), name).otherwise(F.substring(F.coalesce(text, F.lit("")), 1, n)).alias("sample"))


# -- findings ------------------------------------------------------------------------------------------------------


def absent(chapters: DataFrame, staged: DataFrame, key: str = "chapter_id") -> DataFrame:
    """Chapters of which the staged table has nothing."""
    return chapters.join(staged.select(F.col(key).alias("id")), "id", "left_anti")


def null_types(books: DataFrame, profiles: DataFrame, valid: Sequence[str]) -> DataFrame:
    """book_id, profile_type, fixable: books without type, and whether their profile has a valid one."""
    p = profiles.select(F.col("id").alias("book_id"), F.col("book_type").alias("profile_type"))
    ok = F.coalesce(F.col("profile_type").isin(*valid) & (F.col("profile_type") != "unknown"), F.lit(False))
    return books.filter(F.col("book_type").isNull()).select(F.col("id").alias("book_id")).join(p, "book_id", "left").select("book_id", "profile_type", ok.alias("fixable"))


def fix_types(books: DataFrame, found: DataFrame) -> DataFrame:
    """books with the types of fixable findings; a book that has got a type meanwhile keeps it."""
    f = found.filter("fixable").select(F.col("book_id").alias("id"), "profile_type")
    return books.join(f, "id", "left").withColumn("book_type", F.coalesce("book_type", "profile_type")).select(books.columns)


def findings(named: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """category, n, fixable: a row for each check. named: the rows of a check, and which of them can be mended."""
    out = None
    for category, (rows, fixable) in named.items():
        one = rows.agg(F.lit(category).alias("category"), F.count("*").alias("n"), F.count_if(fixable).alias("fixable"))
        out = one if out is None else out.unionByName(one)
    return out.select("category", "n", "fixable")


# -- look-ups ------------------------------------------------------------------------------------------------------


def find_chapter_paths(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """id, path, is_folder: the recorded path if it exists; else of books/<book>/chapters, then processed/<book>/chapters, the
    first folder, then .md file, then any file whose name starts with the chapter's two-digit number and a dash.

    chapters: id, book_id, chapter_number, file_path. files: path, is_folder.
    """
    at = files.select("path", "is_folder", F.regexp_extract("path", r"(?:^|/)(books|processed)/([^/]+)/chapters/([0-9]{2,})-[^/]*$", 1).alias("root"), F.regexp_extract("path", r"(?:^|/)(?:books|processed)/([^/]+)/chapters/", 1).alias("book_id"), F.regexp_extract("path", r"/([0-9]{2,})-[^/]*$", 1).alias("number"))
    own = chapters.select("id", F.col("file_path").alias("path")).join(files.select("path", "is_folder"), "path").select("id", "path", "is_folder", F.lit(0).alias("rank"))
    kind = F.when(F.col("is_folder"), 1).when(F.col("path").endswith(".md"), 2).otherwise(3)
    near = chapters.select("id", "book_id", F.lpad(F.col("chapter_number").cast("string"), F.greatest(F.lit(2), F.length(F.col("chapter_number").cast("string"))), F.lit("0")).alias("number")).join(at.filter("root <> ''"), ["book_id", "number"])
    near = near.select("id", "path", "is_folder", (kind + F.when(F.col("root") == "books", 0).otherwise(3)).alias("rank"))
    best = F.row_number().over(Window.partitionBy("id").orderBy("rank", "path"))
    return own.unionByName(near).withColumn("_r", best).filter("_r = 1").select("id", "path", "is_folder")


def search_titles(rows: DataFrame, text: str, columns: Sequence[str] = ("title",), limit: int = 10, order: str = "title") -> DataFrame:
    """Rows one of whose columns holds the text, whatever its case; % and _ stand for themselves."""
    like = f"%{T.like_escape(text)}%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(like), F.lit(False))
    return rows.filter(hit).orderBy(order, "id").limit(limit)


def reading_totals(reading: DataFrame, status: str = "read") -> DataFrame:
    """n_read, books: chapters of that status, and books with any mark."""
    return reading.agg(F.count_if(F.col("status") == status).alias("n_read"), F.count_distinct("book_id").alias("books"))


def done_on(history: DataFrame, day: str, state: str = "complete") -> DataFrame:
    """n: transitions into the state on that day, for a daily cap."""
    return history.filter((F.col("to_state") == state) & (F.to_date("created_at") == F.to_date(F.lit(day)))).agg(F.count("*").alias("n"))


def count_states(pipelines: DataFrame, states: Sequence[str] | None = None, terminal: Sequence[str] = ()) -> DataFrame:
    """state, n, terminal of the pipelines, of those states only if any are named."""
    rows = pipelines if states is None else pipelines.filter(F.col("state").isin(*states))
    return rows.groupBy("state").agg(F.count("*").alias("n")).withColumn("terminal", F.col("state").isin(*terminal) if terminal else F.lit(False))


def spot_check_results(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, decision: what a spot check of labelled rows writes back. Good ones that aren't toxic are approved."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return labels.select(F.col(id_col).alias("id"), F.when(good, "approved").otherwise("rejected").alias("decision"))


def related_concepts(chapters: DataFrame, limit: int = 20) -> DataFrame:
    """id, title: the first chapters by id, one of each title whatever its case."""
    first = F.row_number().over(Window.partitionBy(F.lower("title")).orderBy("id"))
    return chapters.select("id", "title", first.alias("_r")).filter("_r = 1").orderBy("id").limit(limit).select("id", "title")


def resolve_book(books: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(the book, suggestions). An id is taken as it is; else dashes are spaces and the first title by name that holds the
    words wins; without any, up to three titles that hold the first word are suggested."""
    exact = books.filter(F.col("id") == text)
    words = text.lower().replace("-", " ").strip()
    holds = lambda w: F.contains(F.lower("title"), F.lit(w))
    found = books.filter(holds(words)).orderBy("title", "id").limit(5)
    one = exact.withColumn("_p", F.lit(0)).unionByName(found.withColumn("_p", F.lit(1))).orderBy("_p", "title", "id").limit(1).drop("_p")
    first = words.split()[0] if words else ""
    return one, books.filter(holds(first)).orderBy("title", "id").limit(3)


def audit_trail(rows: DataFrame, book_id: object | None = None, actor: str | None = None, action: str | None = None, since: str | None = None, limit: int = 100) -> DataFrame:
    """Audit rows (pipeline_id, actor, action, performed_at, id) by any of the conditions, newest first."""
    for column, value in (("pipeline_id", book_id), ("actor", actor), ("action", action)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    rows = rows if since is None else rows.filter(F.col("performed_at") >= F.to_timestamp(F.lit(since)))
    return rows.orderBy(F.desc("performed_at"), "id").limit(limit)


#: Entries that a table of analogies may have: they become part of the plan.
MAX_ANALOGIES = 10_000


def analogy(concepts: DataFrame, known: DataFrame) -> DataFrame:
    """concept, key, analogy: the entry of that name, else the first by place whose key is part of the concept or has it as part.

    known: place, key (lower case), analogy; a dimension of at most MAX_ANALOGIES rows.
    """
    rows = known.orderBy("place").limit(MAX_ANALOGIES + 1).collect()
    if len(rows) > MAX_ANALOGIES:
        raise ValueError(f"more than {MAX_ANALOGIES} analogies")
    entries = F.array(*(F.struct(F.lit(r.key).alias("key"), F.lit(r.analogy).alias("analogy")) for r in rows)) if rows else F.array().cast("array<struct<key: string, analogy: string>>")
    low = F.lower("concept")
    same, part = F.filter(entries, lambda e: e["key"] == low), F.filter(entries, lambda e: F.contains(low, e["key"]) | F.contains(e["key"], low))
    best = F.coalesce(F.get(same, F.lit(0)), F.get(part, F.lit(0)))
    return concepts.select("concept", best.alias("_e")).select("concept", F.col("_e.key").alias("key"), F.col("_e.analogy").alias("analogy"))


def complexity(projects: DataFrame) -> DataFrame:
    """id, score, level. projects: id, phases, days, components, integrations, decisions."""
    score = F.round(2.0 * F.col("phases") + F.floor(F.col("days") / 5) + 1.5 * F.col("components") + 2.0 * F.col("integrations") + F.col("decisions"), 1)
    return projects.select("id", score.alias("score")).withColumn("level", F.when(F.col("score") < 20, "simple").when(F.col("score") < 40, "moderate").otherwise("complex"))


def retitle(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """chapters with new titles. titles: book_id, chapter_number, new_title, one row a chapter."""
    j = chapters.join(titles.select("book_id", "chapter_number", "new_title"), ["book_id", "chapter_number"], "left")
    return j.withColumn("title", F.coalesce("new_title", "title")).select(chapters.columns)


def language_counts(blocks: DataFrame) -> DataFrame:
    """id, language, n of code blocks."""
    return blocks.groupBy("id", "language").agg(F.count("*").alias("n"))


def by_size(rollup: DataFrame, limit: int) -> DataFrame:
    """The largest first; rows without a size come last."""
    return rollup.orderBy(F.col("words").desc_nulls_last(), "book_id").limit(limit)


def toc_ratio(rollup: DataFrame, toc: DataFrame, over: float = 1.5, under: float = 0.65) -> DataFrame:
    """book_id, ratio, issue: chapters for each entry of the table of contents. toc: book_id, entries."""
    j = rollup.select("book_id", "chapters").join(toc, "book_id")
    ratio = F.when(F.col("entries") > 0, F.col("chapters") / F.col("entries")).otherwise(F.lit(0.0))
    return j.select("book_id", F.round(ratio, 4).alias("ratio"), F.when(ratio > over, "over_count").when(ratio < under, "under_count").alias("issue"))


def severity_counts(audited: DataFrame) -> DataFrame:
    """severity, n, share in percent, of chapter audits."""
    g = audited.groupBy("severity").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("_t"))  # a row
    return g.join(F.broadcast(total)).select("severity", "n", F.round(F.col("n") * 100.0 / F.col("_t"), 1).alias("share"))


def source_coverage(rollup: DataFrame, source: DataFrame, least: float = 0.5) -> DataFrame:
    """book_id, coverage, passed: words kept of those of the source file. source: book_id, source_words; null or 0 is not judged."""
    j = rollup.select("book_id", "words").join(source, "book_id", "left")
    coverage = F.when(F.col("source_words") > 0, F.col("words") / F.col("source_words"))
    return j.select("book_id", F.round(coverage, 4).alias("coverage"), F.coalesce(coverage >= least, F.lit(True)).alias("passed"))
