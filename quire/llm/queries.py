"""The queries of this subpackage: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontam, divergence, jaccard, licenses, lines, packing, quality, rules, sharding, suffixes, urls, warc
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP1_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS i FROM t),
s AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l),
p AS (SELECT r, doc_id, i, k, row_number() OVER (PARTITION BY r ORDER BY i) AS pos FROM s WHERE k <> ''),
w AS (SELECT r, doc_id, i, pos, k AS a, lead(k, 1) OVER o AS b, lead(k, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY pos)),
f AS (SELECT *, c IS NOT NULL AND (doc_id > min(doc_id) OVER (PARTITION BY a, b, c) OR pos > min(pos) OVER (PARTITION BY r, a, b, c)) AS later FROM w),
g AS (SELECT r, i, bool_or(later) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM f),
u AS (SELECT s.r, string_agg(line, chr(10) ORDER BY s.i) FILTER (WHERE NOT coalesce(gone, false)) AS text,
             count(gone)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed FROM s LEFT JOIN g USING (r, i) GROUP BY s.r)
SELECT doc_id, CASE WHEN n_removed = 0 THEN t.text ELSE coalesce(u.text, '') END AS text, n_lines, n_removed FROM t JOIN u USING (r)
"""


def tokenizer_path() -> str:
    """The public byte-level vocabulary; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_pack_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.ledger(table(spark, sf_dir, "documents"))
    base = ~rules.passes(rules.BASE)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & rules.passes(rules.STRICT)).alias("kept"), "fail_bits", F.lit(rules.STRICT.version).alias("policy"),
    )


OP3_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT r, i, w[i:i+4] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(5, nxt - i)) AS n FROM (SELECT r, i, lead(i, 1, i + 5) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')))::BIGINT AS n_capitals
      FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
       + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
       + CASE WHEN 100 * n_capitals > 30 * word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, '2' AS policy FROM b
"""


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, n_failed, n_only, seen_with: what each rule of the strict policy costs, from the ledger's bits alone."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")), rules.STRICT)


ABLATIONS_SQL = (
    OP3_SQL.rsplit("SELECT doc_id", 1)[0]
    + ", e AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(rules.RULES))
    + """) AS v(rule, bit))
SELECT rule, coalesce(sum(CASE WHEN fail_bits & bit <> 0 THEN 1 ELSE 0 END), 0)::BIGINT AS n_failed, coalesce(sum(CASE WHEN fail_bits = bit THEN 1 ELSE 0 END), 0)::BIGINT AS n_only,
       coalesce(bit_or(fail_bits) FILTER (WHERE fail_bits & bit <> 0), 0)::BIGINT AS seen_with FROM b, e GROUP BY rule
"""
)


def op4_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_word, n_words, source_doc_id: every passage of 50 words or more that occurs again."""
    return suffixes.repeats(table(spark, sf_dir, "documents"))


_WORDS4 = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP4_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS4} AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
c AS (SELECT k, min(doc_id) AS src FROM win GROUP BY k HAVING count(*) > 1),
h AS (SELECT r, doc_id, i, src, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev FROM win JOIN c USING (k)),
g AS (SELECT *, sum(CASE WHEN i <= prev + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM h)
SELECT doc_id, (min(i) - 1)::BIGINT AS start_word, (max(i) + 50 - min(i))::BIGINT AS n_words, arg_min(src, i) AS source_doc_id FROM g GROUP BY r, doc_id, run
"""


def op5_edit_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, ends_at: every benchmark item found in a document."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), urls.rules_frame(spark, (*urls.LISTED, *urls.OWN)))
    return judged.withColumn("version", F.lit(urls.VERSION))


_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = rf"""
WITH u AS (SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS v(h, p, action)),
j AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC NULLS LAST) AS k
      FROM u LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(action, CASE WHEN {" OR ".join(f"regexp_matches(host || path, '{x.pattern}')" for x in urls.OWN)} THEN 'block' ELSE 'allow' END) AS verdict,
       '{urls.VERSION}' AS version
FROM j WHERE k = 1
"""


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.NearDuplicates(table(spark, sf_dir, "documents"), width=4, threshold=85).clusters().select("doc_id", "n_shingles", "component_id", "class_rep")


OP7_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS4.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS kind FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS id, doc_id AS root FROM t UNION SELECT e.b, root FROM reach JOIN e ON e.a = reach.id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id,
       CASE WHEN kind IS NULL THEN t.doc_id ELSE min(t.doc_id) OVER (PARTITION BY kind) END AS class_rep FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) m ON m.id = t.doc_id
"""


def op8_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_key")


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    index = warc.write_bundles(table(spark, sf_dir, "pages"), folder)
    return warc.read_bundles(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM d
"""


def op11_license_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every document, and the places of the base phrases among the verified spans."""
    found = licenses.Scan(table(spark, sf_dir, "documents")).labelled()
    phrases = F.filter("spans", lambda s: s["template"] < len(licenses.PHRASES))
    names = F.array(*(F.lit(t.label) for t in licenses.PHRASES))
    base = F.array_sort(F.array_distinct(F.transform(phrases, lambda s: F.get(names, s["template"]))))
    starts = F.transform(phrases, lambda s: s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(phrases).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that set each source apart."""
    return divergence.Audit(table(spark, sf_dir, "documents")).report()


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
z AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS m FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
w AS (SELECT z.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY z.lang, source) + 2 * v) AS p,
             1 + (1000000000::HUGEINT * (m + 2)) // (total + 2 * v) AS q FROM z JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM w WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10
"""


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after three rounds, with the inertias and the final centroid's hash."""
    return centroids.report(centroids.cluster(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def _op13_round(i: int) -> str:
    return f"""
a{i} AS (SELECT v.r, v.vec_id, v.q, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS d FROM v, c{i} c
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c.k) = 1),
s{i} AS (SELECT k, i, sum(q[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(i) GROUP BY k, i),
m{i} AS (SELECT k, list((s - (s % n + n) % n) // n ORDER BY i) AS q FROM s{i} GROUP BY k),
c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.q, c{i}.q)::BIGINT[] AS q FROM c{i} LEFT JOIN m{i} USING (k)),"""


OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT k - 1 AS k, q FROM (SELECT q, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) AS k FROM v) WHERE k <= 16),{"".join(map(_op13_round, range(4)))}
h AS (SELECT k, sha256(array_to_string(q, ',')) AS h FROM c3)
SELECT vec_id, a3.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a3.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a3 JOIN h USING (k)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_pack_curve, op3_rule_ledger, rule_ablations, op4_sparse_suffixes, op5_edit_decontam, op6_url_rules, op7_parity_join, op8_factor_quality, op9_minimax_shards, op10_warc_bundles, op11_license_votes, op12_source_divergence, op13_delta_lloyd)}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op3_rule_ledger": OP3_SQL, "rule_ablations": ABLATIONS_SQL, "op4_sparse_suffixes": OP4_SQL, "op6_url_rules": OP6_SQL, "op7_parity_join": OP7_SQL, "op10_warc_bundles": OP10_SQL, "op12_source_divergence": OP12_SQL, "op13_delta_lloyd": OP13_SQL}
