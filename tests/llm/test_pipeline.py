"""The pipeline against the brute-force versions of its stages, on a small table of its own."""

import random
import zlib

import pytest

pytest.importorskip("quire.llm")
pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from test_operators import brute_components, brute_lines, prose, sellers  # noqa: E402

from quire.llm import decontam, queries, rules  # noqa: E402


def test_pipeline_is_brute_force(spark, tmp_path):
    rng = random.Random(9)
    item = prose(rng, 30)
    block = "\n".join(prose(rng, 6) for _ in range(4))
    docs = [prose(rng, n) for n in (5, 30, 60, 90)] + [None, "", f"{prose(rng, 40)}\n{item} {prose(rng, 10)}"]
    docs += [f"{prose(rng, 25)}\n{block}\n{prose(rng, 12)}" for _ in range(5)] + [docs[3] + " tail", block, block, "## ## ## " * 9]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    led = {r.doc_id: r.fail_bits for r in rules.ledger(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    left = [(i, t) for i, t in enumerate(docs) if led[i] == 0]
    left = [(i, t) for i, t, n in brute_lines(left) if not n or t.split()]
    keep = {c for _, _, c in brute_components(left, 5, 80)}
    left = [(i, t) for i, t in left if i in keep]
    left = [(i, t) for i, t in left if sellers(decontam.normal(item), decontam.normal(t)) > decontam.budget(len(decontam.normal(item)))]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path())
    want = {}
    for i, t in left:
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        want[i] = ids
    assert {r.doc_id for r in pieces} == set(want) and 3 < len(want) < len(docs)
    for r in pieces:
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in want[r.doc_id][r.start : r.start + r.length])) == r.ids_crc32
    assert sum(r.length for r in pieces) == sum(map(len, want.values()))


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "en", "s", 48)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 1


def test_stages_pass_columns_with_the_names_used_inside(spark, tmp_path):
    """A column that an operator would add itself, or uses inside, is carried on; so are nulls in every column."""
    text = "\n".join(f"line {i} of a text that is told once and then told again" for i in range(6))
    names = ("n_removed", "n_lines", "_id", "_hash", "tag", "_leaked", "fail_bits", "label", "key")
    rows = [(1, text, "en", "s", len(text), *range(9)), (2, text, None, None, None, *[None] * 9), (None, None, None, None, None, *[None] * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names))
    spark.createDataFrame([(None, None), (4, "an item that stands in no text of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(tuple(r) in rows for r in out.collect())
