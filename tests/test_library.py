"""Operators of the library: pins, edges, and equality with DuckDB over the small tables."""

import io
import math
import os
import re
import tempfile
import zipfile
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import vectors as V
from quire.operators import auditing, chunking, evaluation, excerpts, fulltext, governance, integrity, learning, search
from quire.plans import queries_more, queries_services  # noqa: F401
from quire.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=str)
    if name in ORACLE_SQL:
        r = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        want = sorted((tuple(norm(row[names.index(c)]) for c in columns) for row in r.fetchall()), key=str)
        assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("n", [1, 1000, 2100])
def test_every_gold_query_is_ranked(spark, tmp_path, n):
    """More gold queries than one block holds, exactly one block, and one query that has only itself."""
    rng = np.random.default_rng(5)
    rows = [(25 * i, [float(x) for x in rng.normal(size=8).astype(np.float32)], int(rng.integers(40))) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path if t == 'embeddings' else DATA}/{t}.parquet{'/*.parquet' if t == 'embeddings' else ''}'")
    r = c.execute(ORACLE_SQL["eval_hit_mrr"])
    want = dict(zip((d[0] for d in r.description), r.fetchone(), strict=True))
    assert want["n"] == n and QUERIES["eval_hit_mrr"](spark, str(tmp_path)).first().asDict() == want


def test_nearest_is_brute_force(spark):
    """Ties (copies, vectors of length 0) by id, over slices and partitions; a vector is not its own neighbour."""
    vectors = [(i, [float(i % 7), float(i % 5), 1.0] if i % 11 else [0.0, 0.0, 0.0]) for i in range(300)]
    df = spark.createDataFrame(vectors, "id long, v array<float>").repartition(3)
    rows = V.nearest(df, vectors[::20], "id", "v", 10, rows=16).collect()
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    for q, v in vectors[::20]:
        want = sorted((-round(float(unit(v) @ unit(x)), 12), i) for i, x in vectors if i != q)[:10]
        assert sorted((-r.similarity, r.id) for r in rows if r.query_id == q)[:10] == want
    assert V.nearest(df, [], "id", "v", 10).count() == 0


class Shelf:
    """A library of these chapters only."""

    def __init__(self, spark, texts):
        rows = [(i, f"title {i}", t, len((t or "").split())) for i, t in texts.items()]
        self.chapters = spark.createDataFrame(rows, "id long, title string, content string, word_count int")

    def index(self):
        return fulltext.Index.build(self.chapters, "file://" + tempfile.mkdtemp())


def test_rechunk_keeps_every_chunk_and_vector(spark, monkeypatch):
    para = lambda i, n: " ".join(f"Sentence {i} {k} of this text." for k in range(n))
    texts = {1: "\n\n".join(para(i, 40) for i in range(9)), 2: "\n\n".join(para(i, 60) for i in range(7)), 4: "\n\n".join([para(0, 90)] * 6), 5: para(5, 700), 6: para(6, 700), 7: "word", 8: "", 9: None}
    parts = {i: chunking.chunk(t or "") for i, t in texts.items()}
    assert all(s in " ".join(parts[i]) for i, t in texts.items() for s in (t or "").replace("\n\n", " ").split(". "))
    want = {(i, len(p), sum(len(x.split()) for x in p), len(p) if i % 2 == 0 else 0) for i, p in parts.items() if p}
    shelf = Shelf(spark, texts)
    got = queries_more.staged_rechunk_chapters(shelf).select("chapter_id", "chunks", "words", "reused").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and queries_more.staged_rechunk(shelf).first().chapters == 6
    made, reuse = chunking.chunks, integrity.reuse_vectors
    for lost in ("chunk_index <> 1", "NOT (chapter_id = 5 AND chunk_index > 1)"):
        monkeypatch.setattr(chunking, "chunks", lambda d, lost=lost: made(d).filter(lost))
        assert queries_more.staged_rechunk(shelf).first().chapters < 6
    monkeypatch.setattr(chunking, "chunks", made)
    monkeypatch.setattr(integrity, "reuse_vectors", lambda f, s: reuse(f, s.filter("id > 0")))
    assert queries_more.staged_rechunk(shelf).first().chapters < 6


def test_rechunk_keeps_words_of_sentences_beyond_the_token_limit(spark):
    """One sentence of more tokens than a chunk may have, alone and after others; a run of spaces that fills a piece of its own."""
    texts = {1: "Word " * 9000, 2: "A first sentence of it. " + ("long" * 50 + " ") * 400, 3: "a" + " " * 150_000 + "b"}
    shelf = Shelf(spark, texts)
    assert queries_more.staged_rechunk(shelf).first().chapters == 3
    made = chunking.chunks(shelf.chapters).orderBy("chapter_id", "chunk_index").collect()
    for i, t in texts.items():
        parts = [r.content for r in made if r.chapter_id == i]
        assert "".join("".join(parts).split()) == "".join(t.split()) and all(p.strip() and len(excerpts.words_as_tokens(p)) <= chunking.MAX_TOKENS + 1 for p in parts)


def same_as_sql(spark, folder, name, rows):
    """Whether a query gives the rows of its SQL on documents of these (doc_id, text) alone."""
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, 'en', 'src1', 0)", rows)
    c.execute(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")
    for t in ("embeddings", "events", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = c.execute(ORACLE_SQL[name])
    columns = [d[0] for d in r.description]
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*columns).collect()), key=str) == sorted(r.fetchall(), key=str)


#: Texts that no given table holds.
ODD_TEXTS = (
    "", "   ", None, "\n", "-- ... --", "A title\n\nThe text is here. And more of it.", "\n\nOne. Two.\n\n\nThree", "One two.\x0bThree is a key four", "One. \u00a0Two. Three", "\u00a0One. Two\u2003",
    "One two.\x01three. Four", "\x01", "Zero. One. " + "It İs so. " * 3 + " ".join(f"Plain number {i}." for i in range(9)), " ".join(f"Sentence {i} of the approach." for i in range(3000)), "e\u0301 " * 60 + ". Two!\t\r\nThree? four",
)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("repeated", [False, True])
def test_summaries_of_odd_texts_equal_sql(spark, tmp_path, repeated):
    """Empty texts, blank lines, rare white space and marks; ids that stand in two rows, or in none."""
    rows = list(enumerate(ODD_TEXTS))
    long = " ".join(f"Number {i} is {'a key ' * (i % 3)}thing." for i in range(40))
    assert same_as_sql(spark, tmp_path, "extractive_summary", rows + ([*rows[3:], (99, long), (99, long), (99, long), (None, "One. Two."), (None, "One. Two.")] if repeated else []))


def test_sync_replaces_all_postings_of_a_document(spark, monkeypatch):
    texts = {1: "the cat and the dog", 2: "a dog", 3: "the old text old", 4: "cat"}
    shelf = Shelf(spark, texts)
    words = [(i, w) for i, t in (texts | {3: "a renewed text of the document"}).items() for w in f"title {i} {t}".split()]
    want = {(w, len({i for i, x in words if x == w}), sum(x == w for _, x in words)) for _, w in words}
    got = queries_more.fts_sync_terms(shelf).select("term", "documents", "tf").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and queries_more.fts_sync(shelf).first().documents == 4
    made = fulltext.postings
    monkeypatch.setattr(fulltext, "postings", lambda d, *names: made(d, *names).filter("term <> 'dog' AND term <> 'renewed'"))
    assert queries_more.fts_sync(shelf).first().documents == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("ids", [(), (2, 3, 5, 90), (None,)])
def test_sync_counts_documents_without_words(spark, tmp_path, ids):
    """Empty texts and those of marks alone count as in SQL; so do ids that stand in two rows, or in none."""
    assert same_as_sql(spark, tmp_path, "fts_sync", [*enumerate(ODD_TEXTS), (90, "more words"), *((i, f"again {i}") for i in ids)])


def test_sync_finds_words_that_should_be_gone(spark, monkeypatch):
    """A document that has no words any more must have none in the index."""
    shelf = Shelf(spark, {1: "the cat", 2: "a dog", 3: "the old text"})
    made = queries_more.renewed
    kept = F.col("id") != 2
    monkeypatch.setattr(queries_more, "renewed", lambda c: made(c).select("id", F.when(kept, F.col("title")).alias("title"), F.when(kept, F.col("content")).alias("content")))
    assert queries_more.fts_sync(shelf).first().documents == 2


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column).collect()]


def test_text_functions(spark):
    x = T.F.col("x")
    assert one(spark, T.word_count(x), "a b c\n\td", "", None, "  ") == [4, 0, 0, 0]
    assert one(spark, T.topics(x), "Docker and SQL", "nothing here", None) == [["DevOps", "Databases"], ["General"], ["General"]]
    assert one(spark, T.sentences(x, True), "One. two. Three! 4") == [["One. two.", "Three! 4"]]
    assert one(spark, T.truncate_words(x, 7), "one two three", "short") == ["one...", "short"]
    assert one(spark, T.truncate_tokens(x, 5), "aaaa bbbb cccc d\n\nee ff gg", "aaaa bbbb cccc dd. eeee", "a" * 30, "tiny") == ["aaaa bbbb cccc d", "aaaa bbbb cccc dd.", "a" * 20, "tiny"]
    assert one(spark, T.clean_markdown(x), "---\na: b\n---\n# T\n\n\n\n\nx ") == ["# T\n\n\nx"]
    assert one(spark, T.html_text(x), "<p>a &lt;b&gt;</p><script>no</script>") == ["a <b>"]
    assert one(spark, T.html_title(x), "<h1></h1><h2>Two <b>x</b></h2>", f"<h1>{'x' * 300}</h1><title>t</title>") == ["Two x", "t"]
    assert one(spark, T.json_object(x), 'Sure:\n```json\n{"a": 1} // c\n```', "none") == ['{"a": 1}', None]
    assert one(spark, x.rlike(T.glob_pattern("/in/b[12]*.ep?b")), "/in/b1x.epub", "/in/b3x.epub", "/in/B1.epub") == [True, False, False]
    assert one(spark, auditing.suspicious(x), "a.zip", "Table 3", "12", "/usr/x", "Chapter one") == [True, True, True, True, False]


def test_query_language(spark):
    docs = spark.createDataFrame([(1, "", "Jakob's law of zone.js change detection"), (2, "", "python async await"), (3, "", "python pythons only"), (4, "", "foo-bar a:b caret^ law")], "id long, title string, content string")
    index = fulltext.postings(docs).cache()
    hits = lambda q: sorted(r.id for r in fulltext.match(index, q).collect())
    assert hits("zone.js change detection") == [1] and hits("Jakob's law") == [1]
    assert hits("python AND async") == [2] and hits("pytho*") == [2, 3] and hits("python NOT async") == [3]
    assert hits("law OR async") == [1, 2, 4] and hits("foo-bar") == [4] and hits('"async await"') == [2] and hits('"await async"') == []
    assert hits("a:b caret^") == [4] and hits("missing") == []
    for bad in ("", "AND", "law AND", "NOT"):
        with pytest.raises(ValueError):
            fulltext.Query(bad)
    best = fulltext.bm25(index, "python", 1).first()
    assert best.id in (2, 3) and fulltext.bm25(index, "law", where=spark.createDataFrame([(4,)], "id long")).first().id == 4
    assert fulltext.snippet("a b c python d", ["python"], 3) == "...b c **python**..."


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")])
def test_stemmer_follows_the_paper(word, want):
    assert fulltext.stem(word) == want


def test_vectors_and_fusion(spark):
    rows = spark.createDataFrame([(0, 0, "a", [1.0, 0.0]), (1, 0, "a", [0.9, 0.1]), (2, 1, "b", [0.0, 1.0]), (3, 1, "b", [0.0, 0.0]), (4, 2, "b", None)], "id long, chapter_id long, book_id string, embedding array<float>")
    top = search.top_chunks(rows, [1.0, 0.0], 10).collect()
    assert [r.id for r in top] == [0, 1, 2, 3] and top[3].similarity == 0
    assert [r.id for r in search.search_chapters(rows, [1.0, 0.0], 2, 0.0).collect()] == [0]
    assert search.top_chunks(rows, [0.0, 0.0], 3).count() == 0
    with pytest.raises(ValueError):
        search.top_chunks(rows, [1.0, 0.0], 0)
    a = spark.createDataFrame([(1, 1), (2, 2)], "chapter_id long, pos int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "chapter_id long, pos int")
    fused = search.rrf(a, b).orderBy(T.F.desc("rrf_score")).collect()
    assert fused[0].chapter_id == 2 and fused[0].sources == "fts,semantic"
    assert {r.query_id for r in V.nearest(rows, [(5, [1.0, 0.0])], "id", "embedding", 2, own=True).collect()} == {5}
    pairs = search.similar_pairs(spark.createDataFrame([(i, f"b{i % 2}", [float(i % 3), 1.0]) for i in range(20)], "id long, book_id string, embedding array<float>"), 0.99)
    assert pairs.count() == sum(1 for i in range(20) for j in range(i) if i % 2 != j % 2 and i % 3 == j % 3)


def test_mmr_prefers_other_clusters():
    near = np.array([[1, 0.0], [0.99, 0.02], [0.98, 0.03], [0.5, 0.8], [0.45, 0.85]])
    relevance = np.array([1, 0.99, 0.98, 0.6, 0.55])
    assert sum(i < 3 for i in search.mmr_order(relevance, near, 0.3, 3)) <= 2
    assert search.mmr_order(relevance, near, 1.0, 3) == [0, 1, 2]


def test_chunker_pins():
    para = lambda n: " ".join(["w"] * n)
    assert chunking.chunk("") == [] and len(chunking.chunk(para(600))) == 1
    text = "\n\n".join(para(250) for _ in range(8))
    parts = chunking.chunk(text)
    assert len(parts) > 2 and all(chunking.count(p) <= 1000 for p in parts)
    sentences = [f"This is sentence number {i} of the text." for i in range(400)]
    parts = chunking.windows(" ".join(sentences))
    assert all(any(s in p for p in parts) for s in sentences)
    assert all(a.split(". ")[-1].rstrip(".") in b for a, b in zip(parts, parts[1:]))


def test_governance(spark):
    p = spark.createDataFrame([(1, "en", 0.97, True, False), (2, "en", 0.5, True, False), (3, None, 0.99, True, False), (4, "fr", 0.99, True, False), (5, "en", float("nan"), True, False), (6, "en", 0.99, False, False), (7, "en", 0.99, True, True)], "id long, book_type string, confidence double, valid boolean, needs_review boolean")
    t = spark.createDataFrame([("en", 0.9)], "book_type string, threshold double")
    run = lambda **k: {r.id: r.decision for r in governance.auto_approval(p, t, **({"mode": "autonomous", "escape_hatch": False, "used_today": 0, "daily_cap": 5} | k)).collect()}
    assert run() == {1: "approve", 2: "below_threshold", 3: "unknown_type", 4: "no_threshold", 5: "invalid_confidence", 6: "validation_failed", 7: "needs_review"}
    assert set(run(escape_hatch=True).values()) == {"escape_hatch"} and set(run(mode="supervised").values()) == {"supervised"} and run(used_today=5)[1] == "daily_cap"
    paths = {r.state: r.path for r in governance.shortest_path(spark).collect()}
    assert paths["complete"] == "detected>needs_retry>embedding>complete" and len(paths) == 15


def test_integrity_and_learning(spark):
    old = spark.createDataFrame([(1, 1, "h", 10), (2, 1, "h", 20)], "id long, chapter_id long, content_hash string, embedding int")
    new = spark.createDataFrame([(1, "h", 0), (1, "h", 1), (1, "h", 2)], "chapter_id long, content_hash string, chunk_index int")
    assert [r.embedding for r in integrity.reuse_vectors(new, old).orderBy("chunk_index").collect()] == [20, 10, None]
    parts = spark.createDataFrame([(1, "02-b.md", "B"), (1, "01-a.md", "A"), (1, "_x.md", "no"), (1, "notes.md", "no"), (2, "z.md", "Z")], "chapter_id long, name string, text string")
    assert {r.chapter_id: r.content for r in integrity.merge_split_chapters(parts).collect()} == {1: "A\n\nB", 2: "Z"}
    docs = spark.createDataFrame([(1, "Intro text.\n\n```python\nx = 1\n```\n\n**Term** : a thing that is long enough. **term** again"), (2, None)], "id long, content string")
    assert [(r.language, r.code.startswith("x = 1")) for r in learning.code_blocks(docs).collect()] == [("python", True)]
    assert [r.term for r in learning.bold_terms(docs).collect()] == ["Term"]
    assert learning.extractive_summary(docs).count() >= 1
    ranked = spark.createDataFrame([(1, 7, 2), (2, 8, 6), (3, 9, 1)], "query_id long, target long, place int")
    gold = spark.createDataFrame([(1, 7), (2, 8), (3, 5)], "query_id long, target long")
    m = evaluation.hit_mrr(ranked, gold, gold.select("query_id")).first()
    assert (m.n, round(m.hit_at_k, 3), round(m.mrr, 3)) == (3, 0.333, 0.222)


def epub(nav: bool) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        toc = '<item id="n" href="nav.xhtml" properties="nav"/>' if nav else '<item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/>'
        z.writestr("OPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{toc}<item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/nav.xhtml", '<nav><a href="a.xhtml">One</a><a href="a.xhtml#s">Two</a><a href="b.xhtml">Copyright</a></nav>')
        z.writestr("OPS/t.ncx", '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml"/><navPoint><navLabel><text>Two</text></navLabel><content src="a.xhtml#s"/></navPoint></navPoint></navMap></ncx>')
        z.writestr("OPS/a.xhtml", '<html><body><p>first words</p><h2 id="s">Two</h2><p>second words here</p><script>no</script></body></html>')
        z.writestr("OPS/b.xhtml", "<html><body><p>small print</p></body></html>")
    return out.getvalue()


@pytest.mark.parametrize("nav", [True, False])
def test_epub_source(spark, tmp_path, nav):
    from quire.sources import epub as S

    (tmp_path / "x.epub").write_bytes(epub(nav))
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    rows = S.read_epubs(spark, str(tmp_path)).collect()
    assert [(r.chapter_number, r.title, r.content) for r in rows if r.error is None] == [(1, "One", "first words"), (2, "Two", "Two second words here")]
    assert sum(r.error is not None for r in rows) == 1 and S.word_count(epub(nav)) >= 6


def test_titles_of_contents(spark, tmp_path):
    """NCX with points below points, NAV, headings where there is neither, and files that can't be read; from SQL, too."""
    from quire.functions import table
    from quire.sources import titles as S

    def book(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
        return out.getvalue()

    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest>{}<item id="a" href="t/a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="none"/></spine></package>'
    texts = {"O/t/a.xhtml": "<html><h1>First <i>one</i></h1><p>x</p></html>", "O/b.xhtml": "<html><h2>Second</h2></html>"}
    nav = '<html xmlns="http://www.w3.org/1999/xhtml"><nav></nav><nav><ol><li><a href="a">A &amp; B</a><ol><li><a href="b">Below</a></li></ol></li><li><a> </a></li></ol></nav><nav><a>no</a></nav></html>'
    ncx = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text> One </text></navLabel><navPoint><navLabel><text>One.a</text></navLabel><navPoint><navLabel><text>Deep</text></navLabel></navPoint></navPoint></navPoint><navPoint><navLabel><text/></navLabel></navPoint></navMap></ncx>'
    item = '<item id="n" href="nav.xhtml" properties="nav"/>'
    books = {
        "ncx.epub": book({"O/p.opf": opf.format(item), "O/nav.xhtml": nav, "O/t.ncx": ncx}), "nav.epub": book({"O/p.opf": opf.format(item), "O/nav.xhtml": nav} | texts), "plain.epub": book({"O/p.opf": opf.format("")} | texts),
        "none.epub": book({"O/p.opf": opf.format("")}), "bad.epub": b"no zip", "broken.epub": book({"O/p.opf": "<package", "O/x.ncx": "<ncx"}), "note.txt": b"x",
    }
    for name, data in books.items():
        (tmp_path / name).write_bytes(data)
    want = {
        "ncx.epub": [(1, 1, "One", "ncx"), (2, 2, "One.a", "ncx"), (3, 3, "Deep", "ncx")], "nav.epub": [(1, 1, "A & B", "nav"), (2, 2, "Below", "nav")], "plain.epub": [(1, 1, "First one", "headings"), (2, 1, "Second", "headings")],
        "bad.epub": [(None, None, None, None)], "broken.epub": [(None, None, None, None)],
    }
    table.register(spark)
    for df in (S.read_titles(spark, str(tmp_path)), spark.sql(f"SELECT path, x.* FROM binaryFile.`{tmp_path}`, LATERAL quire_titles(content) x WHERE path LIKE '%.epub'")):
        got = defaultdict(list)
        for r in sorted(df.collect(), key=lambda r: r.place or 0):
            got[r.path.rsplit("/", 1)[1]].append((r.place, r.level, r.title, r.source))
            assert (r.error is None) == (r.place is not None)
        assert got == want


def test_store_and_swap(spark, tmp_path):
    from quire.sources.store import Store, swap

    s = Store(spark, f"file://{tmp_path}/store")
    row = lambda *v: spark.createDataFrame(list(v), "id long, embedding int")
    assert s.write("t", row((1, 1))) == 1 and s.upsert("t", row((1, 2), (2, 2)), "id") == 2
    assert {tuple(r) for r in s.read("t").collect()} == {(1, 2), (2, 2)}
    with pytest.raises(ValueError):
        s.write("t", row((9, 9)), check=lambda d: False)
    assert s.versions("t") == [1, 2] and s.delete("t", T.F.col("id") == 1) == 3 and s.versions("t") == [2, 3]
    s.write("staged", row((5, None)))
    for passed in (False, True):
        with pytest.raises(ValueError):
            swap(s, "staged", "t", passed)
    s.write("staged", row((5, 5)))
    assert swap(s, "staged", "t", True) == 4 and s.read("t").first().id == 5


def test_export(spark, tmp_path):
    from quire.sources import export

    c = spark.createDataFrame([(1, "b", 2, "T2", "x", 1), (2, "b", 1, "T1", "y", 1), (3, "a", 1, "T", "z", 1)], "id long, book_id string, chapter_number int, title string, content string, word_count long")
    b = spark.createDataFrame([("a", "Z book"), ("b", "A book")], "id string, title string")
    text = [r.value for r in export.as_markdown(export.ordered(c, b)).collect()]
    assert text[0].startswith("# A book\n\n## 1. T1") and text[1].startswith("## 2.") and text[2].startswith("# Z book")
    export.write(export.ordered(c, b), f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out").count() == 3


def test_files_are_detected_once(spark, tmp_path):
    from quire.sources.store import Store
    from quire.streaming import ingest

    (tmp_path / "in").mkdir()
    for name, data in (("a.epub", b"1"), ("b.pdf", b"2"), ("c.epub", b"1"), ("d.txt", b"3")):
        (tmp_path / "in" / name).write_bytes(data)
    s = Store(spark, f"file://{tmp_path}/s")
    run = lambda: ingest.detect_files(spark, str(tmp_path / "in"), s, f"{tmp_path}/c").awaitTermination()
    run()
    (tmp_path / "in" / "e.pdf").write_bytes(b"2")
    (tmp_path / "in" / "f.pdf").write_bytes(b"4")
    run()
    assert s.read("pipelines").count() == 3


def test_state_machine_and_windows(spark, tmp_path):
    from quire.streaming import ingest

    rows = [(1, 1, 10.0, "detected"), (1, 2, 20.0, "hashing"), (1, 3, 25.0, "complete"), (1, 4, 30.0, "classifying"), (2, 5, 5.0, "detected")]
    spark.createDataFrame(rows, "pipeline_id long, event_id long, ts double, to_state string").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("pipeline_id long, event_id long, ts double, to_state string").json(f"{tmp_path}/in")
    q = ingest.track_states(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.pipeline_id, r.to_state): (r.legal, r.seconds) for r in spark.table("tracked").collect()}
    assert got == {(1, "detected"): (True, None), (1, "hashing"): (True, 10.0), (1, "complete"): (False, None), (1, "classifying"): (True, 10.0), (2, "detected"): (True, None)}
    log = spark.createDataFrame([("2024-01-01 01:00:00", "complete", "auto:x", "approved"), ("2024-01-01 02:00:00", "failed", "me", "approved")], "ts string, to_state string, actor string, action string").withColumn("ts", T.F.to_timestamp("ts"))
    assert ingest.failure_rate(log).agg(T.F.max("rate")).first()[0] == 1.0
    assert [r.n for r in ingest.daily_approvals(log).collect()] == [1]


def test_ages_of_a_stream_without_its_history(spark, tmp_path):
    """Sketches in the state store and in the table of batches, against the percentiles of all durations."""
    from quire.sources.store import Store
    from quire.streaming import ingest

    rng = np.random.default_rng(9)
    rows = [(k, 3 * k + j, float(j * 100 + rng.integers(1, 90)), s) for k in range(400) for j, s in enumerate(("detected", "hashing", "classifying"))]
    put = lambda some: spark.createDataFrame(some, "pipeline_id long, event_id long, ts double, to_state string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/s")
    read = lambda: spark.readStream.schema("pipeline_id long, event_id long, ts double, to_state string").json(f"{tmp_path}/in")
    for some in (rows[:700], rows[700:]):
        put(some)
        ingest.keep_ages(ingest.track_states(read()), store, f"{tmp_path}/c").awaitTermination()
    spent = defaultdict(list)
    for (a, _, t, s), (b, _, u, _) in zip(rows, rows[1:]):
        if a == b:
            spent[s].append(u - t)
    exact = lambda x, q: sorted(x)[max(0, math.ceil(q * len(x)) - 1)]
    want = {s: (len(x), exact(x, 0.5), exact(x, 0.95), max(x)) for s, x in spent.items()}
    found = lambda df: {r.state: tuple(r)[1:] for r in ingest.age_statistics(df).collect()}
    assert store.read("state_ages").count() > 2 and found(ingest.merged_ages(store.read("state_ages"))) == want
    store.update("state_ages", ingest.merged_ages)
    assert store.read("state_ages").count() == 2 and found(store.read("state_ages")) == want
    spark.createDataFrame([(s, x) for s, v in spent.items() for x in v], "state string, seconds double").write.json(f"{tmp_path}/d")
    q = ingest.age_sketches(spark.readStream.schema("state string, seconds double").json(f"{tmp_path}/d"), 64).writeStream.format("memory").queryName("ages").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    for s, (n, median, _, most) in found(spark.table("ages")).items():  # a small sketch: its ranks are a little off
        x = np.sort(spent[s])
        assert n == len(x) and most == x[-1] and abs(np.searchsorted(x, median) / n - 0.5) < 0.1


def test_only_a_silent_pipeline_is_stuck(spark, tmp_path):
    """Pipeline 1 moves on before its timer, to a final state; pipeline 2 stays. A timer that an arrival has ended reports nothing."""
    import time

    from quire.streaming import ingest

    schema = "pipeline_id long, event_id long, ts double, to_state string"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    put("a", [(1, 1, 1.0, "approved"), (2, 2, 1.0, "approved")])
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    q = ingest.track_states(stream, timers=True, pace=0.1).writeStream.format("memory").queryName("stuck").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(processingTime="1 second").start()
    try:
        wait = lambda f, s: next((True for _ in range(s * 2) if f() or time.sleep(0.5)), False)
        assert wait(lambda: spark.table("stuck").count() >= 2, 60)
        put("b", [(1, 3, 2.0, "embedding"), (1, 4, 3.0, "complete")])
        assert wait(lambda: spark.table("stuck").filter("to_state = 'complete'").count() == 1, 60)
        assert wait(lambda: spark.table("stuck").filter("to_state = 'stuck'").count() > 0, 60)
        time.sleep(4)
        assert [(r.pipeline_id, r.from_state) for r in spark.table("stuck").filter("to_state = 'stuck'").collect()] == [(2, "approved")]
    finally:
        q.stop()


def test_appended_parts_and_compaction(spark, tmp_path):
    from quire.sources.store import Store

    s = Store(spark, f"file://{tmp_path}/s")
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    for tag, i in (("x-1", 1), ("x-2", 2), ("x-2", 9)):
        s.append("t", one(i), tag)
    assert sorted(r.id for r in s.read("t").collect()) == [1, 2] and s.compact("t") == 1 and not s.appended("t")
    s.append("t", one(3), "x-3")
    assert sorted(r.id for r in s.read("t").collect()) == [1, 2, 3] and sorted(r.id for r in s.read("t", 1).collect()) == [1, 2]
    s.write("t", one(7))
    assert [r.id for r in s.read("t").collect()] == [7]


def ids_of(df):
    return sorted(r.id for r in df.collect())


def test_writers_that_meet(spark, tmp_path):
    """Of two writers from one version one wins; appended rows are never lost, whoever compacts meanwhile."""
    from quire.sources.store import Conflict, Store

    s, other = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    s.write("t", rows(1, 2))
    base = s.entry("t")["entry"]
    assert other.write("t", rows(3), base=base) == 2
    with pytest.raises(Conflict):
        s.write("t", rows(4), base=base)
    assert ids_of(s.read("t")) == [3] and s.vacuum("t", 0) == 0
    seen = []

    def change(old):
        seen.append(ids_of(old))
        if len(seen) == 1:
            other.write("t", rows(5))
        return old.unionByName(rows(6))

    assert s.update("t", change) == 4 and seen == [[3], [5]] and ids_of(s.read("t")) == [5, 6]
    s.append("t", rows(7), "a")
    real = s._part

    def meanwhile(name, df, partition_by=()):
        part = real(name, df, partition_by)
        s._part = real
        other.append("t", rows(8), "b")
        return part

    s._part = meanwhile
    s.compact("t")
    assert ids_of(s.read("t")) == [5, 6, 7, 8] and len(s.appended("t")) == 1
    s.append("t", rows(9), "a")
    s.append("t", rows(9), "stream", 3)
    s.compact("t")
    for n in (2, 3):
        s.append("t", rows(9), "stream", n)
    assert ids_of(s.read("t")) == [5, 6, 7, 8, 9]


@pytest.mark.parametrize("by_link", (True, False))
def test_an_entry_is_published_once(spark, tmp_path, by_link):
    from quire.sources.store import EMPTY, Store

    s = Store(spark, f"file://{tmp_path}/s")
    s._links = by_link  # False: the way of other file systems
    assert s._publish("t", {**EMPTY, "entry": 1}) and not s._publish("t", {**EMPTY, "entry": 1, "version": 9}) and s.entry("t")["version"] == 0
    assert s.entries("t") == [1] and not [n for n in s._names(f"{s.root}/t/_log") if "staged" in n]


@pytest.mark.parametrize("step", ("_part", "_publish", "_forget", "after"))
@pytest.mark.parametrize("work", ("compact", "append", "write", "upsert"))
def test_a_crash_leaves_the_table_before_or_after(spark, tmp_path, step, work):
    from quire.sources.store import Store

    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    s = Store(spark, f"file://{tmp_path}/s")
    s.write("t", rows(1, 2, 3))
    s.append("t", rows(4), "x-1")
    s.append("t", rows(5), "x-2")
    crash = Store(spark, f"file://{tmp_path}/s")
    real = getattr(crash, "_publish" if step == "after" else step)

    def fail(*a, **b):
        if step in ("_part", "after"):
            real(*a, **b)  # done, and then the writer dies
        raise SystemExit

    setattr(crash, "_publish" if step == "after" else step, fail)
    run = {"compact": lambda t: t.compact("t"), "append": lambda t: t.append("t", rows(6), "x-3"), "write": lambda t: t.write("t", rows(7)), "upsert": lambda t: t.upsert("t", rows(5, 6), "id")}[work]
    with pytest.raises(SystemExit):
        run(crash)
    new = {"compact": [1, 2, 3, 4, 5], "append": [1, 2, 3, 4, 5, 6], "write": [7], "upsert": [1, 2, 3, 4, 5, 6]}[work]
    assert ids_of(s.read("t")) == (new if step in ("_forget", "after") else [1, 2, 3, 4, 5])
    s.vacuum("t", 0)
    assert ids_of(s.read("t")) == (new if step in ("_forget", "after") else [1, 2, 3, 4, 5])
    run(s)
    assert ids_of(s.read("t")) == new


def test_history_is_bounded(spark, tmp_path):
    from quire.sources.store import HISTORY, Store

    s = Store(spark, f"file://{tmp_path}/s")
    for i in range(HISTORY + 6):
        s.write("t", spark.createDataFrame([(i,)], "id long"))
    assert len(s.entries("t")) == HISTORY and ids_of(s.read("t", s.versions("t")[0])) == [HISTORY + 4]
    assert ids_of(s.read("t", entry=s.entries("t")[0])) == [6] and len(os.listdir(f"{tmp_path}/s/t")) <= HISTORY + 2


def test_compare_and_set(spark, tmp_path):
    from quire.sources.store import Store

    s = Store(spark, f"file://{tmp_path}/s")
    s.write("p", spark.createDataFrame([(1, "hashing", 5), (2, "hashing", 6), (3, "complete", 7), (4, None, 8)], "id long, state string, n int"))
    moves = spark.createDataFrame([(1, "hashing", "classifying"), (2, "detected", "hashing"), (3, "complete", "archived"), (3, "complete", "failed"), (4, None, "detected"), (9, "a", "b")], "id long, expected string, target string")
    got = sorted((r.id, r.target, r.moved) for r in s.transition("p", moves).collect())
    assert got == [(1, "classifying", True), (2, "hashing", False), (3, "archived", False), (3, "failed", False), (4, "detected", True), (9, "b", False)]
    assert sorted((r.id, r.state, r.n) for r in s.read("p").collect()) == [(1, "classifying", 5), (2, "hashing", 6), (3, "complete", 7), (4, "detected", 8)]


@pytest.mark.parametrize("least", (0.3, 0.7, 0.95, 1.0))
def test_similar_pairs_are_brute_force(spark, least):
    """Clusters, equal vectors, opposite ones, zeros and nulls; in cells and blocks of a few rows."""
    import numpy as np

    from quire.operators import overlap

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    v = [(centres[i % 6] + rng.normal(scale=0.25, size=8)).astype(np.float32) for i in range(150)]
    v += [v[0]] * 30 + [-v[1], np.zeros(8, np.float32)] + [2 * v[2]]
    rows = [(i, f"b{i % 4}", f"t{i % 3}", x.tolist()) for i, x in enumerate(v)] + [(900, "b9", "t9", None)]
    df = spark.createDataFrame(rows, "id long, book_id string, book_title string, embedding array<float>")
    unit = np.array([x / max(np.linalg.norm(x), 1e-300) for x in np.array(v, float)])
    m = unit @ unit.T
    every = [(round(float(m[a, b]), 3), a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if a % 4 != b % 4 and a % 3 != b % 3 and m[a, b] >= least]
    edge = {(a, b) for a in range(len(v)) for b in range(len(v)) if abs(m[a, b] - least) < 1e-9}
    for pivots, block in ((None, 2048), (1, 16), (12, 16), (40, 7)):
        got = {(r.a, r.b) for r in overlap.similar_pairs(df, least, block, ("book_id", "book_title"), pivots=pivots).collect()}
        assert got - edge == {(a, b) for _, a, b in every} - edge
        best = overlap.similar_pairs(df, least, block, ("book_id", "book_title"), limit=25, pivots=pivots).collect()
        if least < 1:
            assert [(round(r.similarity, 3), r.a, r.b) for r in best] == sorted(every, key=lambda x: (-x[0], x[1], x[2]))[:25]
    assert overlap.similar_pairs(df.filter("id < 0"), least).isEmpty()
    with pytest.raises(ValueError):
        overlap.similar_pairs(df, 0.0)


def test_far_cells_are_not_visited():
    """Copies grow with the pairs that are left: of tight clusters no vector visits another."""
    import numpy as np

    from quire.operators import overlap

    rng = np.random.default_rng(1)
    unit = overlap._unit(np.repeat(np.eye(16), 50, 0) + rng.normal(scale=0.01, size=(800, 16)))
    cells = object.__new__(overlap.Cells)
    cells.pivots, cells.tau = overlap.far_apart(unit, 16), float(np.arccos(0.9))
    angle = overlap._angles(unit, cells.pivots)
    own = angle.argmin(1)
    cells.n = np.bincount(own, minlength=16)
    cells.low, cells.high = (np.array([f(angle[own == c], 0) for c in range(16)]) for f in (np.min, np.max))
    assert len(cells.pivots) == 16 and sum(len(x) for x in cells.visits(unit)[1]) == 0
    cells.tau = 1.7
    assert sum(len(x) for x in cells.visits(unit)[1]) == sum(15 - c for c in own)


def test_duplicate_coverage_by_topic(spark):
    from quire.operators import overlap

    titles = ["Python basics", "More python", "Docker", "python again", "Poems", "Kernel and shell"]
    chapters = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id long, title string")
    rows = spark.createDataFrame([(10 * i, i, f"b{i}", f"t{i}", [1.0, 0.1 * (i % 3)]) for i in range(6)] + [(7, None, "b0", "t0", [0.0, 1.0])], "id long, chapter_id long, book_id string, book_title string, embedding array<float>")
    got = overlap.duplicate_coverage(rows, chapters, 0.9, most=14, each=2).collect()
    by = {r.topic: (r.overlap_count, r.high_overlap) for r in got}
    assert sum(n for n, _ in by.values()) == 14 and by["Python"] == (max(n for n, _ in by.values()), True) and max(r.place for r in got) == 2
    assert all(r.title_a == titles[r.chapter_a] and r.a == 10 * r.chapter_a for r in got)


def test_json_in_answers(spark):
    """Against a reference scanner that tries every brace and every end, on answers with all that may stand in strings."""
    import json
    import random

    fixed = {
        "none": None, "": None, None: None, "[1]": None, '{"a": 1': None, '{ see } {"a": {"b": [1]}} ': {"a": {"b": [1]}}, '{"first": 1}\n```json\n{"second": 2}\n```': {"second": 2},
        '{"a": "}{ // no ``` /* x */"} and {"b": 2}': {"a": "}{ // no ``` /* x */"}, '{"a": 1, // c }\n "b": "x\\"}" /* { */}': {"a": 1, "b": 'x"}'}, 'He said "{" then {"k": 1}': {"k": 1},
        '```\n{"x": "```"}\n``` {"y": 1}': {"x": "```"}, '{"u": "http://x.y"}': {"u": "http://x.y"}, 'see http://x {"a": 1}': {"a": 1}, '{a {"z": 1}': {"z": 1},
    }
    rng, rows = random.Random(3), list(fixed.items())
    for _ in range(300):
        value = {rng.choice('ab{"/`'): rng.choice(["}{", "// x", "/* y */", "```", 'q"q', 3, None, [1, {"c": "{"}], {"d": "\\\\"}]) for _ in range(rng.randrange(1, 4))}
        told = json.dumps(value, indent=rng.choice((None, 2)))
        if "\n" in told and rng.random() < 0.5:
            told = told.replace(',\n', ', // and "more" }\n').replace('{\n', '{ /* { */\n', 1)
        rows.append((rng.choice(("", "Sure, here: ", "```json\n", "It is (no braces) ")) + told + rng.choice(("", "\n```", " done {", " {}")), value))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", T.json_object(T.F.col("t")).alias("j")).collect()}
    for i, (t, want) in enumerate(rows):
        assert (None if got[i] is None else json.loads(got[i])) == want, t


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_searches_leave_texts_where_they_are(spark):
    """Below no exchange of a search's plan stands a text, but for the broadcast of what was found."""
    from quire.api import Tools

    t = Tools(spark, DATA, embedder=lambda texts: [[1.0] + [0.0] * 63 for _ in texts])
    one = [1.0] + [0.0] * 63
    for df in (t.text_search("the", 5), t.text_search("the", 5, "src1"), t.hybrid_search("the", one, 5)[0], t.relevant_excerpts(t.semantic_search(one, 5, 0.0), one)):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        deep = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
        for k, line in enumerate(lines):
            if re.search(r"\bExchange (hash|range|Single)", line):
                below = lines[k + 1 :]
                end = next((j for j, x in enumerate(below) if deep(x) <= deep(line)), len(below))
                scans = [x for x in below[:end] if "FileScan" in x]
                assert not any(re.search(r"ReadSchema: struct<[^>]*text:", x) for x in scans), line
    assert t.lib.chapters_at(spark.createDataFrame([(3,), (3,), (-1,)], "id long")).collect() == t.lib.chapters.filter("id = 3").collect()


def test_nearest_of_many_queries_is_brute_force(spark):
    """Blocks of a few rows, ties, equal vectors, zeros and nulls; vectors and groups of them."""
    rng = np.random.default_rng(7)
    v = [rng.integers(-2, 3, 4).astype(float).tolist() for _ in range(70)] + [[0.0] * 4, None]
    df = spark.createDataFrame([(i, i // 4, x) for i, x in enumerate(v)], "id long, g long, embedding array<double>")
    q = df.filter("id % 3 = 0").select(F.col("id").alias("query_id"), "embedding")
    unit = {i: np.array(x) / max(np.linalg.norm(x), 1e-300) for i, x in enumerate(v) if x is not None}
    for own in (True, False):
        near = {a: [(-round(float(unit[a] @ unit[b]), 12) + 0.0, b) for b in unit if own or a != b] for a in unit if a % 3 == 0}
        for rows in (1024, 5):
            got = defaultdict(list)
            for r in V.nearest_each(df, q, 6, own=own, query_rows=rows, vector_rows=2 * rows).collect():
                got[r.query_id].append((-r.similarity + 0.0, r.id))
            assert {a: sorted(x) for a, x in got.items()} == {a: sorted(x)[:6] for a, x in near.items()}
            got = defaultdict(list)
            for r in V.nearest_each(df, q, 4, own=own, group="g", query_rows=rows, vector_rows=2 * rows).collect():
                got[r.query_id].append((-r.similarity + 0.0, r.g))
            best = {a: sorted({g: min(s for s, b in x if b // 4 == g) for g in {b // 4 for _, b in x}}.items(), key=lambda t: (t[1], t[0]))[:4] for a, x in near.items()}
            assert {a: sorted(x) for a, x in got.items()} == {a: sorted((s, g) for g, s in x) for a, x in best.items()}
    assert V.nearest_each(df.filter("id < 0"), q, 3).isEmpty() and V.nearest_each(df, q.filter("query_id < 0"), 3).isEmpty()
    plans = [V.nearest_each(df, x, 3, query_rows=4)._jdf.queryExecution().executedPlan().toString().count("\n") for x in (q, q.unionByName(q).limit(12))]
    assert plans[0] < 60 and abs(plans[0] - plans[1]) < 20  # one plan, whatever the number of queries


@pytest.mark.parametrize("stemmed", (False, True))
def test_words_of_many_queries(spark, tmp_path, stemmed):
    import random

    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "", " ".join(rng.choices(("alpha", "betas", "gamma", "running", "eps"), k=rng.randrange(1, 9)))) for i in range(50)], "id long, title string, content string")
    index = fulltext.Index.build(docs, f"file://{tmp_path}/i", stemmed)
    asked = ["alpha", "alpha betas", "Beta, beta!", "gamma running eps", "none", "", None, "alpha none"]
    got = defaultdict(list)
    for r in fulltext.bm25_each(index, spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), 7).collect():
        got[r.query_id].append((-r.score, r.id))
    for i, t in enumerate(asked):
        words = list(dict.fromkeys(index.analyse(t or "")))
        want = [(-round(r.score, 9), r.id) for r in index.search(" ".join(words)).collect()] if words else []
        assert sorted(got[i]) == sorted(want)[:7]


def test_words_of_many_queries_move_no_hits(spark, tmp_path, monkeypatch):
    """Over blocks of a few documents and queries, a stored index and plain texts; every query holds the commonest word. Rows that
    move or are made grow with postings and with queries, not with their product."""
    import random

    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "", None if i == 7 else " ".join(["the"] + rng.choices([f"w{j}" for j in range(9)], k=rng.randrange(4)))) for i in range(300)], "id long, title string, content string")
    index = fulltext.Index.build(docs, f"file://{tmp_path}/i")
    asked = [f"the w{i % 10}" for i in range(200)] + ["the", "w1 w2 the"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    want = {t: sorted((-round(r.score, 9), r.id) for r in index.search(t).collect())[:3] for t in set(asked)}
    for docs_rows, asked_rows in ((8192, 65_536), (40, 65_536), (40, 3)):
        monkeypatch.setattr(fulltext, "DOC_ROWS", docs_rows)
        monkeypatch.setattr(fulltext, "ASKED_ROWS", asked_rows)
        for source in (index, docs):
            made = fulltext.bm25_each(source, queries, 3)
            got = defaultdict(list)
            for r in made.collect():
                got[r.query_id].append((-r.score, r.id))
            assert all(sorted(got[i]) == want[t] for i, t in enumerate(asked))
    plan = fulltext.bm25_each(docs, queries, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "places" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_evaluation_builds_no_index(spark, monkeypatch):
    """Neither the gate, which wants vectors alone, nor the report, which counts the asked words."""
    monkeypatch.setattr(fulltext.Index, "build", None)
    monkeypatch.setattr("quire.sources.library.Library.index", None)
    assert QUERIES["eval_gate"](spark, DATA).first() and QUERIES["eval_report"](spark, DATA).count() == 4


def test_evaluation_and_gate(spark):
    gold = spark.createDataFrame([(1, "auto", 10, "a"), (2, "auto", 11, "a"), (3, "manual", None, "b"), (4, "manual", None, None)], "query_id long, source string, chapter_id long, book_id string")
    lists = [(1, "semantic", 12, "a", 1), (1, "semantic", 10, "a", 2), (2, "semantic", 11, "a", 7), (3, "semantic", 30, "c", 1), (3, "semantic", 31, "b", 4), (4, "semantic", 5, None, 1), (1, "hybrid", 10, "a", 1)]
    ranked = spark.createDataFrame(lists, "query_id long, mode string, chapter_id long, book_id string, place int")
    got = {(r.source, r.mode): (r.n, r.hit_at_k, r.mrr) for r in evaluation.evaluate(gold, ranked).collect()}
    assert got == {("auto", "semantic"): (2, 0.5, round((1 / 2 + 1 / 7) / 2, 6)), ("manual", "semantic"): (2, 0.5, 0.125), ("auto", "hybrid"): (2, 0.5, 0.5), ("manual", "hybrid"): (2, 0.0, 0.0)}
    cells = lambda *rows: spark.createDataFrame([(s, "semantic", 9, h, m) for s, h, m in rows], "source string, mode string, n long, hit_at_k double, mrr double")
    live = cells(("auto", 0.5, 0.4), ("manual", 0.3, 0.2))
    for staged, passed in ((cells(("auto", 0.5, 0.4), ("manual", 0.4, 0.1)), True), (cells(("auto", 0.5, 0.4), ("manual", 0.3, 0.9)), False), (cells(("auto", 0.5, 0.3), ("manual", 0.9, 0.9)), False), (cells(("auto", 0.9, 0.9)), False)):
        assert evaluation.passes(live, staged).first().passed is passed


def test_paragraphs_are_trimmed_of_spaces_alone(spark):
    """Not of the digits of their own places."""
    assert one(spark, T.paragraphs(F.col("x")), "007 zero \n\n 11 one 1\n\n\n \n\n3 three 3") == [["007 zero", "11 one 1", "3 three 3"]]


def test_code_examples():
    from quire.operators import codeblocks as C

    text = "\n".join(["Intro one. Use it so:", "```Python", "x = 1", "FROM nothing", "$ not shell but python", "```", "A file:", "FROM alpine:3", "RUN apk add git", "", "CMD x", "", "Prose goes on.", "$ ls -la /tmp", "$ cd /tmp", "$ ls", "Run docker run -it x", "   --rm y", "z", "```", "open fence"])
    got = [(e.language, e.format, e.code, e.context, e.line_count, e.at) for e in C.code_examples(text)]
    assert got == [
        ("python", "fenced", "x = 1\nFROM nothing\n$ not shell but python", "Use it so:", 3, 1),
        ("dockerfile", "inline", "FROM alpine:3\nRUN apk add git", "Use it so:\n```Python\nx = 1\nFROM nothing\n$ not shell but python\n```\nA file:", 2, 7),
        ("bash", "inline", "$ ls -la /tmp\n$ cd /tmp\n$ ls", "", 3, 13),
        ("bash", "inline", "docker run -it x\n   --rm y", "$ ls -la /tmp\n$ cd /tmp\n$ ls", 2, 16),
    ]
    assert C.code_examples(None) == [] and C.code_examples("$ ls") == [] and [e.code for e in C.code_examples("$ ls -la /tmp\n\n$ ls -la /tmp")] == ["$ ls -la /tmp"]
    assert [e.language for e in C.code_examples(text, "Bash")] == ["bash", "bash"] and C.code_examples("```\n\n```")[0].language == "unknown"
    assert C.context_before("One. Two three", 200) == "Two three" and C.context_before("x" * 300, 150) == "x" * 150


def test_table_functions(spark):
    """In SQL with LATERAL, against the functions themselves; arguments are checked when the query is analysed."""
    from pyspark.errors import AnalysisException

    from quire.functions import table
    from quire.operators.codeblocks import code_examples
    from quire.operators.maintenance import sections

    table.register(spark)
    texts = ["para one is here\n\n" * 300, None, "", "## A\n" + "a " * 4000 + "\n## B\n" + "b " * 4000 + "\n## C\n" + "c " * 4000, "```sql\nselect 1\n```\n$ ls -la /tmp"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    rows = lambda sql: [tuple(r) for r in spark.sql(sql, docs=docs).collect()]
    got = rows("SELECT id, x.chunk_index, x.content FROM {docs}, LATERAL quire_chunks(content, 120) x")
    assert sorted(got) == sorted((i, k, c) for i, t in enumerate(texts) for k, c in enumerate(chunking.chunk(t or "", 120)))
    got = rows("SELECT id, x.section, x.title, x.tokens FROM {docs}, LATERAL quire_sections(content) x")
    assert sorted(got) == sorted((i, k, a, len(b) // 4) for i, t in enumerate(texts) for k, (a, b) in enumerate(sections(t or ""), 1))
    got = rows("SELECT id, x.* FROM {docs}, LATERAL quire_code(content) x")
    assert sorted(got) == sorted((i, *e) for i, t in enumerate(texts) for e in code_examples(t))
    for bad in ("quire_chunks(id)", "quire_chunks(content, 0)", "quire_chunks(content, id)"):
        with pytest.raises(AnalysisException):
            rows(f"SELECT x.* FROM {{docs}}, LATERAL {bad} x")


def test_versioned_caches():
    from quire.sources.cache import Cache

    now, gone, made = [0.0], [], []
    c = Cache(most=2, ttl_s=10, release=gone.append, clock=lambda: now[0])
    get = lambda name, version: c.get(name, version, lambda: made.append((name, version)) or f"{name}{version}")
    assert [get("a", 1), get("b", 1), get("a", 1), get("c", 1)] == ["a1", "b1", "a1", "c1"] and gone == ["b1"]  # b is the longest unused
    assert get("a", 2) == "a2" and gone == ["b1", "a1"] and get("c", 1) == "c1"
    now[0] = 10.0
    assert get("c", 1) == "c1" and gone[-1] == "c1" and made.count(("c", 1)) == 2
    s = c.stats()
    assert (s["size"], s["hits"], s["misses"], s["evicted"], s["outdated"], s["expired"], s["hit_rate"]) == (2, 2, 5, 1, 1, 1, round(2 / 7, 4))
    assert c.clear("a") == 1 and c.clear("a") == 0 and c.clear() == 1 and c.stats()["size"] == 0
    with pytest.raises(ValueError):
        Cache(0)
    with pytest.raises(KeyError):
        c.get("x", 1, lambda: {}["missing"])
    assert c.stats()["size"] == 0  # a value that can't be made leaves nothing


def test_cached_frames_follow_the_store(spark, tmp_path):
    from quire.sources import cache
    from quire.sources.store import Store

    s, c = Store(spark, f"file://{tmp_path}/s"), cache.frames(4)
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    s.write("t", one(1))
    first = cache.stored(c, s, "t", lambda df: df.withColumn("twice", F.col("id") * 2))
    assert first.is_cached and first is cache.stored(c, s, "t") and cache.data_version(s, "t", "none") == (1, 0)
    stream = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(lambda b, n: s.append("t", one(10 + n), "stream", n)).trigger(once=True).option("checkpointLocation", f"{tmp_path}/c").start()
    stream.awaitTermination()
    later = cache.stored(c, s, "t")
    assert not first.is_cached and ids_of(later) == [1, 10] and c.stats()["outdated"] == 1
    c.clear()
    assert not later.is_cached


def test_rerank_falls_back(spark):
    rows = spark.createDataFrame([(1, 0.9, "a"), (2, 0.8, "b"), (3, 0.7, "c")], "id long, similarity double, content string")
    ids = lambda model: [r.id for r in search.rerank(rows, model, 2).collect()]

    def broken(_):
        raise RuntimeError("no service")

    assert ids(None) == ids(broken) == ids(lambda r: [1.0]) == [1, 2] and ids(lambda r: [x["id"] for x in r]) == [3, 2]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stored_index_is_the_computed_one(spark):
    from quire.operators import fulltext as X
    from quire.sources.library import Library

    lib = Library(spark, DATA)
    texts = lib.chapters.select("id", "title", "content")
    for stemmed, make in ((False, X.postings), (True, X.stemmed_postings)):
        key = lambda df: sorted((r.id, r.term, r.tf) for r in df.select("id", "term", "tf").collect())
        assert key(lib.index(stemmed).postings) == key(make(texts)) and lib.index(stemmed) is lib.index(stemmed)
    for q in ("the haon", "haon OR onsh", "haon NOT was", "haon*", '"of the"', "the NOT (", "nothinglikeit"):
        a, b = lib.index().search(q), X.bm25(X.postings(texts), q)
        assert {(r.id, round(r.score, 9)) for r in a.collect()} == {(r.id, round(r.score, 9)) for r in b.collect()}
        assert {r.id for r in lib.index().match(q).collect()} == {r.id for r in a.collect()}


@pytest.mark.parametrize("stemmed", (False, True))
def test_index_in_segments_is_the_rebuilt_index(spark, tmp_path, stemmed):
    """Replaced, added, emptied and deleted documents, through merges of segments; a fork leaves its origin alone."""
    import random

    from quire.operators import fulltext as X

    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(("alpha", "beta", "gammas", "the", "running", "of", "rare", "delta")) for _ in range(rng.randrange(1, 12)))
    docs = {i: (f"title {i}", text()) for i in range(400)}
    frame = lambda some: spark.createDataFrame([(i, *docs[i]) for i in some], "id long, title string, content string")
    rows = lambda df: sorted((r.id, r.term, r.tf, tuple(r.places)) for r in df.select("id", "term", "tf", "places").collect())
    index = X.Index.build(frame(docs), f"file://{tmp_path}/i", stemmed)
    base, first = index.segments[0]["at"], rows(index.postings)
    fork = index.fork(f"file://{tmp_path}/f").sync(frame([1]).withColumn("content", T.F.lit("only in the fork")))
    assert fork.segments[0]["at"] == base and len(fork.segments) == 2 and rows(index.postings) == first
    for step in range(7):
        changed = [rng.randrange(420) for _ in range(3)] if step != 4 else list(range(120))
        gone = [rng.choice([d for d in docs if d not in changed])] if step % 2 else []
        for i in changed:
            docs[i] = (f"title {i}", text() if rng.random() < 0.8 else None)
        for i in gone:
            del docs[i]
        index = index.sync(frame(set(changed)), delete=spark.createDataFrame([(i,) for i in gone], "id long"))
        assert step > 2 or index.segments[0]["at"] == base  # the large segment isn't written again for a few documents
    fresh = (X.stemmed_postings if stemmed else X.postings)(frame(docs))
    assert rows(index.postings) == rows(fresh) and len(index.segments) <= 4
    n, mean = X.lengths(fresh).agg(T.F.count("*"), T.F.avg("dl")).first()
    assert index.stats[0] == n and abs(index.stats[1] - mean) < 1e-9 and index.lengths.count() == n
    for q in ("alpha", "the AND beta", '"of the" OR rare', "gam* NOT delta", "title"):
        a, b = ({r.id: round(r.score, 9) for r in x.collect()} for x in (index.search(q), X.bm25(fresh, q, analyse=index.analyse)))
        assert a == b and {r.id for r in index.match(q).collect()} == set(b)
    again = X.Index(spark, f"file://{tmp_path}/i", stemmed)
    assert again.segments == index.segments
    only = index.sync(None, delete=spark.createDataFrame([(i,) for i in docs], "id long"))
    assert only.lengths.isEmpty() and only.stats == (0, 1.0) and only.search("alpha").isEmpty()
    with pytest.raises(FileNotFoundError):
        X.Index(spark, f"file://{tmp_path}/none")


def test_sync_reads_what_has_changed(spark, tmp_path):
    """One more document: the postings of others are neither read nor written, and a search reads the files of its terms."""
    from quire.operators import fulltext as X

    docs = spark.range(3000).select("id", T.F.concat(T.F.lit("t"), "id").alias("title"), T.F.concat(T.F.lit("word"), (T.F.col("id") % 50).cast("string")).alias("content"))
    index = X.Index.build(docs, f"file://{tmp_path}/i")
    before = {os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs}
    index = index.sync(docs.filter("id = 7").withColumn("content", T.F.lit("changed")))
    new = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs if os.path.join(d, f) not in before)
    assert new < 30_000 and index.stats[0] == 3000 and len(index.segments) == 2
    plan = index.rows(("changed",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 and plan.count("PushedFilters: [IsNotNull(term), EqualTo(term,changed)") == 2
    assert [r.id for r in index.search("changed").collect()] == [7] and 7 not in {r.id for r in index.search("word7").collect()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_tools(spark, tmp_path):
    from quire.api import InputError, Tools
    from quire.sources.store import Store

    one = [1.0] + [0.0] * 63
    t = Tools(spark, DATA, embedder=lambda texts: [one for _ in texts], store=Store(spark, f"file://{tmp_path}/s"))
    assert t.list_books().count() == 20 and t.get_chapter("src1", 1, 50)
    assert t.text_search("the", 5).count() == 5 and t.semantic_search("anything", 5, 0.0).count() >= 1
    # The index is stemmed: another form of the word finds the same chapters.
    assert {r.id for r in t.text_search("licenses", 50).collect()} == {r.id for r in t.text_search("licensed", 50).collect()} != set()
    found, stats = t.hybrid_search("the", one, 5)
    rows = found.collect()
    assert len(rows) == 5 and all(r.excerpt for r in rows) and stats["fts"] > 0
    diverse = t.hybrid_search("the", one, 5, diverse=True)[0].collect()
    assert 0 < len(diverse) <= 5 and [r.place for r in diverse] == sorted(r.place for r in diverse)
    assert t.semantic_context("the license", one).startswith(("Relevant context", "No relevant context"))
    assert t.get_library_statistics().first() == t.get_library_statistics().first() and t.library_status().count() == 20
    assert t.get_cache_stats()["hits"] == 2 and t.clear_cache() == 1
    assert t.create_study_guide(0).startswith("# ") and t.health().count() == 1 and t.find_related_content(0, 3).count() >= 0
    assert t.summarize_book("src1", 3).count("## ") >= 3 and t.audit_report("table").startswith("book_id")
    t.audit_report("csv", f"file://{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r").count() == 20
    t.mark("src1", 1, "reading")
    t.mark("src1", 1, "read")
    t.add_bookmark("src1", 2, "a")
    t.add_bookmark("src1", 2, "b")
    assert [r.status for r in t.reading_marks().collect()] == ["read"] and [r.note for r in t.bookmarks("src1").collect()] == ["b"]
    t.remove_bookmark("src1", 2)
    assert t.bookmarks().count() == 0
    t.update_title("book-src1", 1, "Anew")
    assert t.chapters().filter("title = 'Anew'").count() == 1 and t.chapters().count() == t.lib.chapters.count()
    p = spark.createDataFrame([(1, "pending_approval", "x", 0.9, True, False), (2, "complete", "x", 0.9, True, False), (3, "hashing", None, None, True, False)], "id long, state string, book_type string, confidence double, valid boolean, needs_review boolean")
    r = spark.createDataFrame([(1, "approve", "auto:full", "a"), (2, "rollback", "me", "b"), (3, "approve", "me", "c"), (9, "reject", "me", "d")], "id long, action string, actor string, reason string")
    out = {x.id: (x.success, x.error, x.after_state) for x in t.decide(r, p, spark.createDataFrame([("x", 0.8)], "book_type string, threshold double"), "full").collect()}
    assert out == {1: (True, None, "approved"), 2: (True, None, "archived"), 3: (False, "not_pending", "hashing"), 9: (False, "not_found", None)}
    assert sorted((x.pipeline_id, x.action) for x in t.audit_log().collect()) == [(1, "approved"), (2, "rollback")] and t.audit_log(actor="me").count() == 1
    assert {x.id: x.state for x in t.store.read("pipelines").collect()} == {1: "approved", 2: "archived", 3: "hashing"}
    for bad in (lambda: t.text_search("x"), lambda: t.text_search("AND OR"), lambda: t.get_chapter("src1", 0), lambda: t.audit_chapter_quality("odd"), lambda: Tools(spark, DATA).semantic_search("words"), lambda: t.mark("src1", 1, "odd"), lambda: Tools(spark, DATA).bookmarks()):
        with pytest.raises(InputError):
            bad()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_commands(spark, tmp_path):
    from quire.__main__ import run

    go = lambda *a: run(spark, ["--data", DATA, "--store", f"file://{tmp_path}/s", *a])
    assert go("books").count("Book src") == 20 and go("stats").startswith("books") and go("toc", "src1").startswith("chapter_number")
    assert len(go("search", "the", "--limit", "3").splitlines()) == 5 and go("study", "0").startswith("# ")
    assert go("mark", "src1", "1", "read") == "version 1" and go("retitle", "book-src1", "1", "Anew") == "version 1"
    assert go("export", f"file://{tmp_path}/e").startswith("written") and any("Anew" in f.read_text() for f in (tmp_path / "e").glob("part-*"))
    assert run(spark, ["--data", DATA, "--csv", f"file://{tmp_path}/c", "audit", "bad"]).startswith("written")


def test_pdf(spark, tmp_path):
    import zlib

    from quire.sources import pdf

    shown = b"BT " + b" ".join(b"(word%d and \\(more\\)) Tj" % i for i in range(60)) + b" [(sp) -20 (lit)] TJ ET"
    body = lambda data: b"<< /Length 1 >>\nstream\n" + data + b"\nendstream\n"
    head = b"%PDF-1.4\n/Title (One \\(1\\)) /Title (\\376\\377\\000T\\000w\\000o)\n"
    for name, data in (("a.pdf", head + body(zlib.compress(shown))), ("b.pdf", body(shown)), ("scan.pdf", b"%PDF" + body(b"\x00\x01"))):
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): (r.words, r.titles) for r in pdf.words_and_titles(pdf.files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": (181, ["One (1)", "Two"]), "b.pdf": (181, []), "scan.pdf": (None, [])}
    assert pdf.simple_text(body(shown)).endswith("split")

    def broken(_):
        raise OSError

    assert {r.words for r in pdf.words_and_titles(pdf.files(spark, str(tmp_path)), broken).collect()} == {None}


def test_chunks_lose_nothing():
    """Every sentence is in some chunk, chunks follow the text, and only a long sentence makes one too long."""
    import random

    rng = random.Random(5)
    for _ in range(60):
        paras = [" ".join(f"s{p}x{k} " + "w " * rng.choice((3, 20, 90)) + "end." for k in range(rng.randrange(1, 40))) for p in range(rng.randrange(1, 12))]
        out = chunking.chunk("\n\n".join(paras))
        marks = [w for p in paras for w in p.split() if w[:1] == "s"]
        at = {m: [i for i, c in enumerate(out) if m in c.split()] for m in marks}
        assert all(at.values()) and [at[m][0] for m in marks] == sorted(at[m][0] for m in marks)
        assert all(len(v) <= 3 for v in at.values()) and all(len(c.split()) <= chunking.HUGE + 100 for c in out)


def best_of(text, vector, embedder, n):
    """The excerpt of one text, by brute force."""
    from quire.operators import excerpts as P

    parts = P.excerpt_paragraphs(text or "")
    if not parts:
        return P.NO_CONTENT
    scores = [0.0] * len(parts)
    if len(parts) > 1:
        try:
            vectors = embedder(parts)
            dot, size = (lambda a, b: sum(x * y for x, y in zip(a, b))), (lambda a: sum(x * x for x in a) ** 0.5)
            scores = [round(dot(v, vector) / (size(v) * size(vector)), 12) if size(v) * size(vector) else 0.0 for v in vectors]
        except RuntimeError:
            pass
    best = parts[scores.index(max(scores))]
    return best if len(best) <= n else best[:n].strip() + "..."


def test_excerpts(spark):
    from quire.operators import excerpts as P
    from quire.operators.embedding import HashEmbedder

    long = "x" * 60
    assert P.excerpt_paragraphs(f"# One\n\n{long}\n\nshort\n\n{long}\n## Two\n{long}\n\nend") == [f"# One\n{long}", f"short {long}", f"## Two\n{long} end"]
    assert P.excerpt_paragraphs("") == [] and P.excerpt_paragraphs("tiny") == ["tiny"] and P.excerpt_paragraphs("# a\n\n# b") == ["# b"]
    e = HashEmbedder()

    class Broken(HashEmbedder):
        def __call__(self, texts):
            if any("broken" in t for t in texts):
                raise RuntimeError
            return super().__call__(texts)

    text = "\n\n".join(["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "the quick brown fox jumps over the lazy dog near the river bank", "z " * 400])
    texts = [text, f"{text}\n\nbroken " + "y " * 40, " ", None, "z " * 400, "one\n\ntwo", "same words here again and again and again, at length\n\n" * 3, f"# T\n\n{long}\n\n" * 4]
    rows = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "id int, content string")
    for words, n in ((["quick fox river"], 500), (["z"], 10), (["alpha"], 30)):
        vector = e(words)[0]
        got = P.relevant_excerpts(rows, vector, Broken(), n)
        assert got.columns == ["id", "content", "excerpt"] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.content, r.excerpt) for r in got.collect()} == {(t, best_of(t, vector, Broken(), n)) for t in texts}
    nothing = {r.content: r.excerpt for r in P.relevant_excerpts(rows, [0.0] * 64, e).collect()}
    assert nothing[text].startswith("alpha") and nothing[None] == nothing[" "] == "[No content]" and nothing["z " * 400] == ("z " * 250).strip() + "..."


def test_token_split():
    from quire.operators import excerpts as P

    text = "One two. Three four five. " + "w " * 50 + "end. Last one."
    for most in (1, 3, 5, 20, 1000):
        parts = P.token_split(text, most)
        assert all(len(P.words_as_tokens(p)) <= most + len(P._SENTENCE.split(p)) for p in parts)
        if most == 1000:
            assert parts == [text]
    assert P.token_split("a b. c d. e f.", 4) == ["a b. c d.", "e f."] and P.token_split("", 5) == [""]
    assert P.token_split("a b c d e. f g.", 2) == ["a b", "f g."] and P.token_split("a b c d e. f g.", 2, whole=True) == ["a b", " c d", " e.", "f g."]
    assert "".join(P.words_as_tokens(text + "  ")) == text + "  "


def test_embedding_calls(spark):
    from quire.operators import embedding as B

    assert [list(r) for r in B.calls(["a" * 40] * 5, tokens=25)] == [[0, 1], [2, 3], [4]] and [list(r) for r in B.calls(["a"] * 5, most=2)] == [[0, 1], [2, 3], [4]]
    assert [list(r) for r in B.calls(["a" * 4000, "b"], tokens=10)] == [[0], [1]] and not list(B.calls([]))
    seen = []

    def picky(texts):
        seen.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0] for _ in texts]

    assert B.embed_texts(["a", "bad", "c"], picky) == [([1.0], None), (None, "ValueError: no"), ([1.0], None)] and seen == [3, 1, 1, 1]
    rows = B.embed(spark.createDataFrame([(1, "some words"), (2, None), (3, " ")], "id long, content string"), B.HashEmbedder(8)).collect()
    assert {r.id: (r.embedding is None, r.error) for r in rows} == {1: (False, None), 2: (True, "empty text"), 3: (True, "empty text")}
    v = B.HashEmbedder()
    assert v(["a b"]) == v(["b  a"]) and abs(sum(x * x for x in v(["a b c"])[0]) - 1) < 1e-9 and v([""]) == [[0.0] * 64]


def test_services_edges(spark):
    from quire.operators import services as S
    from quire.sources import reports as R

    empty = spark.createDataFrame([], "id long, content_hash string, text string")
    known = spark.createDataFrame([], "content_hash string, book_type string, confidence double")
    assert S.classify(empty, known, S.KeywordClassifier(())).count() == 0
    rows = spark.createDataFrame([(1, "h", "Data"), (2, "h", "Data"), (3, "g", None)], empty.schema)
    assert sorted((r.id, r.book_type, r.source) for r in S.classify(rows, known, S.KeywordClassifier((("t", ("data",)),))).collect()) == [(1, "t", "primary"), (2, "t", "primary"), (3, "unknown", "none")]
    bare = spark.createDataFrame([(1, None, "data"), (2, None, "other"), (3, None, "data"), (4, "h", "x" * 50 + "data"), (None, None, None)], "id int, content_hash string, text string")
    found = S.classify(bare, known, S.KeywordClassifier((("t", ("data",)),)), sample=50).collect()
    assert sorted((r.id or 0, r.book_type) for r in found) == [(0, "unknown"), (1, "t"), (2, "unknown"), (3, "t"), (4, "unknown")]
    a = S.analogy(spark.createDataFrame([("Docker image",), ("git",), ("x",)], "concept string"), spark.createDataFrame([(2, "docker", "d"), (1, "image", "i"), (3, "digit", "g")], "place int, key string, analogy string"))
    assert sorted(((r.concept, r.analogy) for r in a.collect()), key=str) == [("Docker image", "i"), ("git", "g"), ("x", None)]
    with pytest.raises(ValueError):
        R.evaluated_rows({}, "books")
    assert R.text_table(spark.createDataFrame([(1, None), (22, "b")], "a int, b string")).splitlines() == ["a   b", "--  -", "1", "22  b"]


def test_strategy_files(spark, tmp_path):
    from quire.sources import reports as R

    (tmp_path / "fast.json").write_text('{"chunk": 500}')
    (tmp_path / "slow.json").write_text('{"name": "careful", "chunk": 100}')
    assert {(r.name, r.chunk) for r in R.strategies(spark, str(tmp_path)).collect()} == {("fast", 500), ("careful", 100)}


def test_maintenance(spark):
    from quire.operators import maintenance as M

    p = spark.createDataFrame([(1, "pending_approval", 5, "h1"), (2, "complete", 5, "h2")], "id long, state string, priority int, content_hash string")
    after, report = M.batch_decide(p, p, "approve")
    assert {r.id: r.state for r in after.collect()} == {1: "approved", 2: "complete"} and {r.id: r.outcome for r in report.collect()} == {1: "approve", 2: "skipped"}
    assert {r.state for r in M.batch_decide(p, p, "reject", dry_run=True)[0].collect()} == {"pending_approval", "complete"}
    again = M.prepare_reingest(p, p.filter("id = 2")).collect()
    assert sorted((r.id, r.state, r.priority, r.content_hash) for r in again) == [(-2, "detected", 3, "h2"), (1, "pending_approval", 5, "h1"), (2, "archived", 5, "archived:2:h2")]
    text = "\n\n".join(f"## Part {c}\n" + "words and more " * 60 for c in "abcd")
    assert [t for t, _ in M.sections(text, threshold=100)] == ["Part a", "Part b", "Part c", "Part d"] and M.sections("short") == [("", "short")]
    assert [t for t, _ in M.sections("\n\n".join(["plain text " * 300] * 4), threshold=100)] == ["Part 1", "Part 2", "Part 3", "Part 4"]
    lost = spark.createDataFrame([(1, "/x/a.pdf", False), (2, "/x/b.pdf", True)], "id long, source_path string, live_copy boolean")
    assert [r.value for r in M.lost_manifest(lost).collect()] == ["- [ ] again: /x/b.pdf", "- gone: /x/a.pdf"]


def test_empty_tables(spark):
    """Every grouped operator gives its empty or zero result on no rows."""
    from quire.operators import analytics, integrity

    c = spark.createDataFrame([], "id long, book_id string, chapter_number int, title string, content string, word_count long, content_hash string")
    roll = analytics.book_rollup(c, spark.createDataFrame([], "chapter_id long"))
    assert roll.count() == 0 and tuple(analytics.totals(roll).first()) == (0, 0, 0, 0, 0.0)
    for f in (auditing.extraction_quality, auditing.chapter_audit, auditing.title_hygiene, learning.bold_terms, learning.extractive_summary, chunking.chunks, integrity.null_hashes, fulltext.postings):
        assert f(c).count() == 0
    p = spark.createDataFrame([], "id long, state string, updated_at timestamp, confidence double")
    assert governance.health(p, "2024-01-31").first().status == "idle" and governance.approval_stats(p).first().total == 0


def test_executors_without_the_package(tmp_path):
    """The package is only on the driver's path: operators with Python code send it along."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from quire.operators import chunking, embedding, fulltext, search
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
d = s.createDataFrame([(1, "t", "some words of a text. and more of them")], "id long, title string, content string")
print("rows", chunking.chunks(d).count(), fulltext.postings(d).count(), len(fulltext.stemmed_postings(d).collect()), embedding.embed(d, embedding.HashEmbedder(4)).filter("error IS NULL").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 1 9 9 1" in done.stdout, done.stderr[-2000:]


def test_templates(spark):
    from quire.operators import templates

    rows = spark.createDataFrame([(1, "speed", None), (2, "{depth} | x", "deep")], "id long, topic string, depth string")
    got = dict(map(tuple, templates.render(rows, "{topic}: {depth}, {topic}").collect()))
    assert got == {1: "speed: , speed", 2: "{depth} | x: deep, {depth} | x"}
    with pytest.raises(ValueError, match="hours, weeks"):
        templates.render(rows.withColumnRenamed("topic", "goal"), "reading")
    for text in templates.TEMPLATES.values():
        assert "{" not in text.replace("\n", " ").format_map(type("", (dict,), {"__missing__": lambda s, k: "x"})())
    assert dict(map(tuple, templates.table(rows, "id", {"T": "topic"}, "id").collect()))[2] == "| T |\n|---|\n| {depth} \\| x |"
    assert templates.plans(rows.select("id", F.col("topic").alias("goal"), F.lit("none").alias("kind")), spark.createDataFrame([], "kind string, position int, phase string, days int"), "2024-01-01").count() == 2
