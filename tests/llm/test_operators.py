"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quire.llm")
from quire.llm import decontam, jaccard, lines, packing, quality, queries, rules, sharding, suffixes, urls, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `row` int, label string, size int, places int, `_text` string, first int"


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those that the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", 1, None, 2, 3, "x", 4) for i, t in zip(ids, texts)], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta")) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 9, 40, 60, 80, 120, 200, 300)]
    out = [None, "", "   \n\t", "word", *base]
    for _ in range(40):
        w = rng.choice(base[3:]).split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
        out.append(" ".join(w))
    out += [base[5]] * 4 + [base[5].upper(), base[6] + "\u00a0tail", "é\x0bü " * 30]
    passage = prose(rng, 55)
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)]
    out.append(prose(rng, 30_000))
    return out


# -- op 1 --------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    blank = " \t\r\x0b\x0c"
    first, out = {}, []
    for i, t in rows:
        ls = [(n, x.strip(blank)) for n, x in enumerate((t or "").split("\n"))]
        ls = [(n, x) for n, x in ls if x]
        for p in range(len(ls) - 2):
            first.setdefault(tuple(x for _, x in ls[p : p + 3]), (i, p))
    for i, t in rows:
        ls = [(n, x.strip(blank)) for n, x in enumerate((t or "").split("\n"))]
        ls = [(n, x) for n, x in ls if x]
        gone = set()
        for p in range(len(ls) - 2):
            if first[tuple(x for _, x in ls[p : p + 3])] != (i, p):
                gone |= {n for n, _ in ls[p : p + 3]}
        out.append((i, t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone), len(gone)))
    return out


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(1)
    pool = [f"line {i}" for i in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(("", " ", "\t")) for _ in range(rng.randrange(14)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n\n"), (63, "a\nb"), (64, "A\n" * 400), (65, "\n".join(f"u{i}" for i in range(5000)))]
    got = lines.dedup(frame(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"]
    assert sorted((r.doc_id, r.text or "", r.n_removed) for r in got.collect()) == sorted((i, t or "", n) for i, t, n in brute_lines(rows))


def test_line_dedup_edges(spark):
    same = "a\nb\nc\nd"
    got = lines.dedup(frame(spark, [same, same, same, None], [5, 5, None, 7])).collect()
    assert sorted((r.doc_id is None, r.text) for r in got if r.text is not None) == [(False, same), (False, same), (True, "")]
    assert lines.dedup(frame(spark, [])).count() == 0
    many = lines.dedup(frame(spark, ["first\n" + same] + [same] * 500, [1] + [None] * 500)).collect()
    assert Counter((r.text, r.n_removed) for r in many) == {("first\n" + same, 0): 1, ("", 4): 500}


# -- op 2 --------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own = Tokenizer.from_file(path)
    docs = [*texts, "a <|endoftext|> b"]
    pieces = packing.pack(frame(spark, docs), path, capacity=256)
    by, seq = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in enumerate(docs):
        want = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == b"".join(x.to_bytes(4, "little") for x in want)
        assert all(r.doc_tokens == len(want) for r in parts)
    assert sorted(seq) == list(range(len(seq)))
    for s, parts in seq.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or s == len(seq) - 1
    assert packing.sequences(pieces).filter("n = 256").count() == sum(r.length for parts in by.values() for r in parts) // 256


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 300_000, "a" * 1_000_000, "!" * 300_000, "word " * 50_000 + " " * 200_000 + "x"])
def test_packing_of_long_runs(text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    run, _ = packing.encoder(path)
    assert run([text, "a b"]) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in (text, "a b")]


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of eight vocabularies, mixed: along the curve the next document is of the same one far more often than by chance."""
    rng = random.Random(4)
    docs = [" ".join(f"{'abcdefgh'[i % 8]}{rng.randrange(12)}" for _ in range(80)) for i in range(400)]
    pieces = packing.pack(frame(spark, docs), queries.tokenizer_path()).collect()
    order = [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sorted(order) == list(range(400)) and sum(a % 8 == b % 8 for a, b in zip(order, order[1:])) > 200


def test_packing_other_vocabulary_and_empty(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(frame(spark, ["Hello there", None, None], [1, 1, None]), path).count() == 3
    assert packing.pack(frame(spark, []), path).count() == 0


def test_packing_of_one_text_without_ids_is_dealt_out(spark, monkeypatch):
    """Equal rows without ids share a key, and still go to many ranges."""
    seen = []
    real = packing.map_arrow

    def watch(df, run, schema):
        if df.columns == ["range", "doc_id", "n", "ids"]:
            seen.extend(r[1] for r in df.groupBy("range").count().collect())
        return real(df, run, schema)

    monkeypatch.setattr(packing, "map_arrow", watch)
    texts = ["one text that comes again and again"] * 3000 + [f"another text {i}" for i in range(300)]
    got = packing.pack(frame(spark, texts, [None] * 3000 + list(range(300))), queries.tokenizer_path()).collect()
    assert sum(seen) == 3300 and max(seen) < 600
    at = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and at[0][0] == 0


def test_curve_visits_every_cell_by_unit_steps():
    import numpy as np

    for d, b in ((1, 4), (2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << b)] * d, indexing="ij"), -1).reshape(-1, d)
        key = packing.hilbert(cells, b)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


# -- op 3 --------------------------------------------------------------------------------------------------------


def test_rule_measures_are_brute_force(spark, texts):
    extra = ["x y z a b " * 5, "a b c d e f a b c d e", "#1 $2 %3\n#1 $2 %3\n\n \n", "SHOUT LOUD NOW PLEASE I BEG YOU SO MUCH DEAR", "q " * 20_000]
    docs = [*texts, *extra]
    got = {r.doc_id: r for r in rules.ledger(frame(spark, docs)).collect()}
    for i, t in enumerate(docs):
        w = [x.decode() for x in (t or "").encode().split()]
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(5)}
        ls = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(ls) - len(set(ls)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert bool(r.fail_bits & 3) == (len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_policies_and_ablations_read_only_bits(spark, texts):
    docs = frame(spark, [*texts, "#" * 40 + " a b c d e f g h i j k"])
    led = rules.ledger(docs).cache()
    kept = led.filter(rules.passes(rules.STRICT)).count()
    assert rules.keep(docs).count() == kept and rules.keep(docs).columns == docs.columns
    for r in rules.ablations(led, rules.STRICT).collect():
        without = rules.Policy("x", tuple(n for n in rules.STRICT.rules if n != r.rule))
        assert led.filter(rules.passes(without)).count() == kept + r.n_only
    assert rules.ledger(frame(spark, [])).count() == 0 and rules.keep(frame(spark, [None, ""])).count() == 0


# -- op 4 --------------------------------------------------------------------------------------------------------


def brute_spans(rows, size):
    count, first = Counter(), {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted(words, key=lambda x: x[0]):
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            count[k] += 1
            first.setdefault(k, i)
    out = []
    for i, w in words:
        now = None
        for a in range(len(w) - size + 1):
            if count[k := tuple(w[a : a + size])] > 1:
                if now and a <= now[1]:
                    now[1] = a + size
                else:
                    out += [tuple(now)] if now else []
                    now = [a, a + size, first[k], i]
        out += [tuple(now)] if now else []
    return sorted((i, a, b - a, f) for a, b, f, i in out)


@pytest.mark.parametrize(("size", "gram", "hot"), [(50, 12, 20_000), (8, 3, 20_000), (5, 5, 20_000), (8, 3, 2), (5, 5, 30)])
def test_repeated_passages_are_brute_force(spark, monkeypatch, texts, size, gram, hot):
    """Also where suffixes that begin alike count as very many."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = suffixes.repeats(frame(spark, texts), size, gram)
    assert sorted(map(tuple, got.collect())) == brute_spans(list(enumerate(texts)), size)


def test_repeated_passages_edges(spark):
    long = " ".join(map(str, range(60)))
    got = suffixes.repeats(frame(spark, [long, long, None, "", long + " x", " ".join(["z"] * 130)], [3, 3, 4, 5, None, 6])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.start_word, r.n_words, r.source_doc_id) for r in got if r.doc_id != 6) == [(False, 3, 0, 60, 3), (False, 3, 0, 60, 3), (True, None, 0, 60, 3)]
    assert [(r.start_word, r.n_words) for r in got if r.doc_id == 6] == [(0, 130)]
    assert suffixes.repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("size", "hot"), [(50, 20_000), (8, 20_000), (8, 2)])
def test_later_passages_are_removed(spark, monkeypatch, texts, size, hot):
    """Words of windows that occurred before, by id and place, go; equal long texts stay once."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = suffixes.remove(frame(spark, texts), size, min(12, size // 2))
    seen, longs, want = set(), set(), {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        if len(w) >= size and tuple(w) in longs and t in texts[:i]:
            gone = [True] * len(w)
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            if k in seen:
                gone[a : a + size] = [True] * size
            seen.add(k)
        longs.add(tuple(w))
        want[i] = ([x for x, g in zip(w, gone) if not g], sum(gone))
    assert {r.doc_id: ((r.text or "").encode().split(), r.n_removed) for r in got.collect()} == want
    assert got.columns == [*frame(spark, texts).columns, "n_removed"]
    for r in got.filter("n_removed = 0").collect():
        assert r.text == texts[r.doc_id]


def test_texts_longer_than_a_slice(spark):
    """Every kernel on a text of more than its slice, beside short ones."""
    from quire.llm import kernels

    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(160_000))
    assert len(long) > kernels.SLICE_BYTES
    docs = frame(spark, [long, "a b c d e", long + " tail", "x " * 60, None])
    assert {r.doc_id: r.component_id for r in jaccard.NearDuplicates(docs, 5, 80).clusters().collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    spans = {(r.doc_id, r.start_word, r.n_words, r.source_doc_id) for r in suffixes.repeats(docs).collect()}
    assert spans == {(0, 0, 160_000, 0), (2, 0, 160_000, 0), (3, 0, 60, 3)}
    assert {r.doc_id: r.n_removed for r in suffixes.remove(docs).collect()} == {0: 0, 1: 0, 2: 160_000, 3: 59, 4: 0}
    assert quality.score(docs, None).count() == 5


def thue_morse(one, two, size):
    return "".join((one, two)[bin(i).count("1") & 1] for i in range(size))


@pytest.mark.parametrize("size", (16, 64, 2048))
def test_crafted_words_do_not_collide(spark, size):
    """Words that every polynomial modulo 2**64 takes for equal, from 1,024 letters on."""
    x, y = thue_morse("a", "b", size), thue_morse("b", "a", size)
    got = jaccard.NearDuplicates(frame(spark, [f"p q r {x}", f"p q r {y}", f"P q r {x}"]), 4, 85).clusters().collect()
    assert sorted((r.doc_id, r.component_id, r.class_rep) for r in got) == [(0, 0, 0), (1, 1, 1), (2, 0, 0)]
    assert {r.doc_id for r in jaccard.keep_first(frame(spark, [f"p q r s {x}", f"p q r s {y}"])).collect()} == {0, 1}
    head, tail = " ".join(f"h{i}" for i in range(30)), " ".join(f"t{i}" for i in range(30))
    docs = frame(spark, [f"{head} {x} {tail}", f"{head} {y} {tail}"])
    assert suffixes.repeats(docs).isEmpty()
    assert {r.doc_id: r.n_removed for r in suffixes.remove(docs).collect()} == {0: 0, 1: 0}


def test_word_hashes_depend_on_the_bytes_alone():
    from quire.llm import kernels

    rng = random.Random(3)
    words = list({"".join(rng.choice("abcé") for _ in range(rng.choice((1, 3, 7, 8, 9, 16, 17, 63, 64, 65, 300)))) for _ in range(3000)})
    order = [rng.choice(words) for _ in range(6000)] + words
    hashed = []
    for seed in (0, 1):
        _, _, data, offsets = next(kernels.slices(pa.array([" ".join(order)])))
        hashed.append(kernels.hash_words(kernels.find_words(data, offsets), seed))
        assert len(set(zip(order, hashed[-1].tolist()))) == len(words) == len(set(hashed[-1].tolist()))
    assert not (hashed[0] == hashed[1]).any()


def test_sets_are_hashed_anew_after_a_collision(spark, monkeypatch):
    """The first hash of a set is the same for all: the second shows it, and another seed is taken."""
    real = jaccard._sketch

    def colliding(batches, width, threshold, seed):
        for b in real(batches, width, threshold, seed):
            yield b if seed else b.set_column(3, "cid", pa.array([None if x is None else 7 for x in b.column(3).to_pylist()], pa.int64()))

    monkeypatch.setattr(jaccard, "_sketch", colliding)
    got = jaccard.NearDuplicates(frame(spark, ["a b c d e f", "g h i j k l", "a b c d e f", None]), 5, 80).clusters().collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1), (2, 0), (3, 3)]


def test_one_row_of_each_component_stays(spark):
    """Rows that share id and text, rows without id, and the largest id there is."""
    t, u = "a b c d e f g", "h i j k l m n"
    docs = frame(spark, [t, t, t, u, u, None, None, "x y", "x y"], [4, 4, None, None, None, 1, 1, (1 << 63) - 1, 9])
    left = jaccard.keep_first(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect()) == [(False, 1, ""), (False, 1, ""), (False, 4, t), (False, 9, "x y"), (True, 0, u)]
    ids = {(r.doc_id, r.component_id) for r in jaccard.NearDuplicates(docs.filter("doc_id > 9")).clusters().collect()}
    assert ids == {((1 << 63) - 1, (1 << 63) - 1)}


def kept_suffixes(*ranges, batch):
    """What _compare keeps of sorted ranges, each read in batches of so many rows."""
    out = set()
    for rows in ranges:
        parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + batch])], names=["grams", "text_hash", "places"]) for a in range(0, len(rows), batch)]
        out |= {(t, p) for b in suffixes._compare(iter(parts)) for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())}
    return out


def test_suffix_that_opens_a_range_is_kept_however_many_copies_it_has():
    before, after = [(1, 1, 0), (7, 2, 5)], [(7, 3, 4)] * 300 + [(8, 4, 0), (9, 5, 0)]
    assert {(2, 5), (3, 4)} <= kept_suffixes(before, after, batch=256)
    rng = random.Random(4)
    rows = sorted((rng.randrange(12), rng.randrange(6), rng.randrange(2)) for _ in range(30) for _ in range(rng.choice((1, 1, 9))))
    alike = {(t, p) for g, t, p in rows if any(g == h and (t, p) != (u, q) for h, u, q in rows)}
    for cut in (c for c in range(1, len(rows)) if rows[c] != rows[c - 1]):
        for batch in (1, 3, 4, 256):
            assert alike <= kept_suffixes(rows[:cut], rows[cut:], batch=batch)


# -- op 5 --------------------------------------------------------------------------------------------------------


def sellers(item, text):
    row = list(range(len(item) + 1))
    best = len(item)
    for c in text:
        new = [0]
        for k, x in enumerate(item, 1):
            new.append(min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance_is_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert decontam.least_distance(decontam.peq(item), len(item), text)[0] == min(len(item), sellers(item, text))


def test_decontamination_is_brute_force(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate((5, 12, 20, 30))] + [(8, None), (9, "  "), (10, "ab")]
    docs = [None, "", "zz ab zz", prose(rng, 60)]
    for _, t in items[:4]:
        for edits in (0, 1, 3, 6, 12, 25):
            s = list(t.upper() if edits == 1 else t)
            for _ in range(edits):
                at = rng.randrange(len(s))
                s[at : at + rng.randrange(2)] = rng.choice(("", "q", "w"))
            docs.append(f"{prose(rng, 20)}\n{''.join(s)}  {prose(rng, 9)}")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in enumerate(docs):
        for i, x in items:
            x, y = decontam.normal(x), decontam.normal(t)
            if x and y and (k := sellers(x, y)) <= decontam.budget(len(x)):
                want[d, i] = k
    assert got == want and len(want) > 12
    clean = decontam.clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in want} and clean.columns[1] == "text"


def test_decontamination_in_chunks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK_CHARS", 20)
    items = spark.createDataFrame([(i, f"item number {i} of the list") for i in range(9)], "item_id long, text string")
    docs = frame(spark, [f"x item number {i} of the list y" for i in range(9)])
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).filter("distance = 0").collect()} == {(i, i) for i in range(9)}
    assert decontam.matches(frame(spark, []), items).count() == 0 and decontam.clean(docs, items.limit(0)).count() == 9


def test_clean_drops_only_the_rows_that_leak(spark):
    """Rows that share an id, or have none, are judged by their own texts; items without id or with a repeated one count."""
    item = "the quick brown fox jumps over the lazy dog again and again"
    items = spark.createDataFrame([(None, item), (7, "nothing like it at all in there"), (7, item.upper())], "item_id long, text string")
    docs = frame(spark, [f"a {item} b", "clean text", f"c {item}", "clean too", None, None], [None, None, 3, 3, 3, None])
    left = decontam.clean(docs, items).collect()
    assert sorted(r.text or "" for r in left) == ["", "", "clean text", "clean too"] and left[0].__fields__ == docs.columns


def test_items_with_one_id_are_texts_of_one_item(spark):
    """The nearest text counts, whichever comes first; columns with the names used inside pass."""
    item = "the quick brown fox jumps over the lazy dog again and again"
    texts = [(7, item), (7, item.replace("quick", "quack")), (None, item), (None, item.replace("lazy", "hazy"))]
    docs = spark.createDataFrame([(1, f"a {item} b", "x", 2), (2, "nothing", "y", 3)], "doc_id long, text string, tag string, item_id int")
    for rows in (texts, texts[::-1]):
        items = spark.createDataFrame(rows, "item_id long, text string")
        assert {(r.doc_id, r.item_id, r.distance) for r in decontam.matches(docs, items).collect()} == {(1, 7, 0), (1, None, 0)}
        assert [tuple(r) for r in decontam.clean(docs, items).collect()] == [(2, "nothing", "y", 3)]


# -- op 6 --------------------------------------------------------------------------------------------------------


def test_url_verdicts(spark):
    cases = [
        ("http://a.com/x", "com/", "allow"), ("http://a.com", None, "allow"), ("https://EXAMPLE.com/en/1", "example.com/en/", "block"), ("https://www.example.com/en/1?q", "www.example.com/en/", "allow"),
        ("https://m.example.com/en", "com/", "allow"), ("http://x.net/es/", "net/es/", "block"), ("http://x.net/es", None, "allow"), ("http://xnet/es/", None, "allow"), ("http://net/fr/a#b", "net/fr/", "block"),
        ("http://free-bets.example.org/fr/2", None, "block"), ("http://freebets.org/", None, "allow"), ("http://10.0.0.7:80/a", None, "block"), ("http://u@a.org/", None, "block"), ("http://a.org/Setup.EXE", None, "block"), ("http://a.org/setup.exe.html", None, "allow"), ("http://a.org/en?f=x.exe", None, "allow"),
        ("http://xn--80ak6aa92e.org/", None, "block"), ("http://a-b-c-d-e.org/", None, "block"), ("http://a-b.org/c-d-e-f", None, "allow"), ("http://x12345678.org/", None, "block"), ("http://a.org/12345678", None, "allow"),
        ("no scheme", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("x://", None, "allow"), ("http://A.Net/ES/1", None, "allow"),
    ]
    rows = [(i, u, "h", "t") for i, (u, _, _) in enumerate(cases)]
    pages = spark.createDataFrame([*rows, rows[2], rows[12]], "page_id long, url string, host string, token string")
    got = urls.judge(pages, urls.rules_frame(spark, (*urls.LISTED, *urls.OWN))).collect()
    assert len(got) == len(cases) + 2
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(i, rule, v) for i, (_, rule, v) in enumerate(cases)}
    assert {r.page_id: (r.host, r.path) for r in got}[3] == ("www.example.com", "/en/1")
    assert urls.judge(pages.limit(0), urls.rules_frame(spark, urls.LISTED)).count() == 0


def test_url_columns_with_the_names_used_inside(spark):
    pages = spark.createDataFrame([(1, "http://a.org/casino", 5, "h", 7, "t")], "page_id long, url string, _id int, _host string, rule_id int, token string")
    assert [tuple(r) for r in urls.judge(pages, urls.rules_frame(spark, urls.OWN)).collect()] == [(1, "a.org", "/casino", None, "block")]


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = [("com",)] * 9 + [("example",)] * 3 + [("en",)] * 5
    filed = urls.file_rules(urls.rules_frame(spark, urls.LISTED), spark.createDataFrame(pages, "token string"))
    assert {r.rule_id: r.token for r in filed.collect()}[1] == "example"


def test_thousands_of_rules_from_a_table(spark):
    """Verdicts are those of trying every rule on every url, and a url runs the expressions of a few rules only."""
    import re

    rng = random.Random(12)
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    bad, hosts = [name() for _ in range(2000)], [name() for _ in range(40)]
    rules = [*urls.LISTED, *map(urls.word_rule, bad), *(urls.host_rule(f"{name()}.{rng.choice(hosts)}.org", rng.choice(("/", "/a/", "/a")), rng.choice(("allow", "block"))) for _ in range(2000)), *urls.SHAPES]
    sites = [r.name.split("/")[0] for r in rules if r.rank and ".org" in r.name]
    pages = [f"https://{rng.choice((f'{name()}.com', f'www.{rng.choice(sites)}', rng.choice(sites)))}/{rng.choice(('a', 'a/b', rng.choice(bad), 'x-' + rng.choice(bad) + '.html', name(), rng.choice(bad) + 'tail'))}" for _ in range(400)] + [None, "no url", "http://127.0.0.1/a"]
    table = spark.createDataFrame([(i, r.name, r.pattern, r.action, r.rank, list(r.tokens)) for i, r in enumerate(rules)], "rule_id long, name string, pattern string, action string, rank long, tokens array<string>")
    docs = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(docs, table).collect()}
    compiled = [re.compile(r.pattern.replace("(?i)", ""), re.I if "(?i)" in r.pattern else 0) for r in rules]
    for i, url in enumerate(pages):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        text = "".join(m.groups()) if m else ""
        fits = [(r.rank, k, r) for k, r in enumerate(rules) if compiled[k].search(text)]
        won = max((f for f in fits if f[0]), key=lambda f: f[:2], default=None)
        want = (won[2].name, won[2].action) if won else (None, "block" if any(r.action == "block" for _, _, r in fits) else "allow")
        assert got[i] == want, url
    assert sum(v == "block" for _, v in got.values()) > 100 and sum(r is not None for r, _ in got.values()) > 100
    parts = F.array_union(F.array(F.lit("")), F.split(F.lower(F.concat(urls.host_of("url"), urls.path_of("url"))), urls.SEPARATOR))
    tokens = docs.select("page_id", F.explode(parts).alias("token"))
    fetched = tokens.join(urls.file_rules(table, tokens.select("token")), "token").groupBy("page_id").count().agg(F.avg("count"), F.max("count")).first()
    assert fetched[0] < 10 and fetched[1] < 40, fetched  # of 4,010 rules


# -- op 7 --------------------------------------------------------------------------------------------------------


def shingle_set(t, width):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, width, threshold):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize(("width", "threshold"), [(4, 85), (5, 80), (1, 50), (3, 100)])
def test_near_duplicates_are_brute_force(spark, texts, width, threshold):
    got = jaccard.NearDuplicates(frame(spark, texts), width, threshold).clusters()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(list(enumerate(texts)), width, threshold)


@pytest.mark.parametrize("listed", [8, 0])
def test_near_duplicates_around_the_threshold(spark, monkeypatch, listed):
    """A family whose members are as similar as the threshold, a chain, and strangers that share a passage; with every round by pivots, too."""
    monkeypatch.setattr(jaccard, "LISTED", listed)
    rng = random.Random(11)
    base, passage = [f"w{rng.randrange(999)}" for _ in range(120)], [f"p{i}" for i in range(60)]
    docs = []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(12)}"
        docs.append(" ".join(w))
    chain = list(base[:100])
    for k in range(20):
        chain[5 * k : 5 * k + 2] = [f"c{k}", f"d{k}"]
        docs.append(" ".join(chain))
    docs += [" ".join([*passage, *(f"s{rng.randrange(10**6)}" for _ in range(40))]) for _ in range(40)]
    got = jaccard.NearDuplicates(frame(spark, docs), 4, 85).clusters()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(list(enumerate(docs)), 4, 85)


def shuffled(spark, since=-1):
    """(bytes that stages of larger ids than `since` wrote to shuffles, the largest id)."""
    jvm, stages = spark.sparkContext._jvm, spark._jsc.sc().statusStore()
    found = stages.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    rows = [(found.apply(i).stageId(), found.apply(i).shuffleWriteBytes()) for i in range(found.size())]
    return sum(n for i, n in rows if i > since), max((i for i, _ in rows), default=-1)


def test_keys_of_one_set_move_once_and_short(spark):
    """Of documents without a partner, each filed key moves as less than twelve bytes, its hash and the set's were sixteen."""
    rng = random.Random(6)
    near = jaccard.NearDuplicates(frame(spark, [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(2000)]), 5, 80)
    keys, since = near.filed.selectExpr("sum(size(keys))").first()[0], shuffled(spark)[1]
    assert near.components().isEmpty() and keys > 50_000
    assert shuffled(spark, since)[0] < 12 * keys


def test_differences_are_kept_for_those_that_may_meet(spark):
    """Pairs whose blocks hold no third set are compared, and keep no differences."""
    rng = random.Random(7)
    docs = [[f"w{rng.randrange(10**6)}" for _ in range(150)] for _ in range(40)]
    stored, real = [], jaccard.NearDuplicates._next
    near = jaccard.NearDuplicates(frame(spark, [" ".join(w) for d in docs for w in (d, [*d[:-12], *(f"x{rng.randrange(10**6)}" for _ in range(12))])]), 5, 80)
    near._next = lambda compared, labels: stored.extend(compared.select("linked", "delta").collect()) or real(near, compared, labels)
    assert near.components().count() == 80
    assert len(stored) == 40 and all(r.linked and not r.delta for r in stored)


@pytest.mark.parametrize("listed", [8, 0])
def test_near_duplicates_beyond_the_broadcasts(spark, monkeypatch, texts, listed):
    """Keys that are joined by shuffles, and of which the first count sees four bits only."""
    monkeypatch.setattr(jaccard, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(jaccard, "COUNTED", 15)
    monkeypatch.setattr(jaccard, "LISTED", listed)
    got = jaccard.NearDuplicates(frame(spark, texts), 4, 85).clusters()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(list(enumerate(texts)), 4, 85)


def test_near_duplicates_edges(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", "A B C D E F", None, "", "a b", "a b"], [4, 4, 2, 1, None, 9, None])
    got = jaccard.NearDuplicates(docs, 5, 80).clusters().collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 9), (1, 1), (2, 2), (4, 2), (4, 2), (9, 9)]
    kept = jaccard.keep_first(docs, 5, 80)
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (1, ""), (2, "A B C D E F"), (9, "a b")]
    assert kept.columns == docs.columns
    assert jaccard.NearDuplicates(frame(spark, []), 4, 85).clusters().count() == 0


# -- op 8 --------------------------------------------------------------------------------------------------------


def test_pairwise_identity_is_the_double_sum():
    import numpy as np

    rng = np.random.default_rng(0)
    m = quality.Model(0.3, rng.normal(size=quality.SIZE).astype(np.float32), rng.normal(size=(quality.SIZE, quality.RANK)).astype(np.float32))
    x = quality.Features(np.array([3, 9, 70, 5, 9], np.int32), np.array([0.5, 1, 2, 1, 3], np.float32), np.array([0, 3, 5]))
    for i, (a, b) in enumerate(((0, 3), (3, 5))):
        idx, val = x.index[a:b], x.value[a:b]
        want = m.bias + (m.weight[idx] * val).sum() + sum(m.factor[idx[p]] @ m.factor[idx[q]] * val[p] * val[q] for p in range(len(idx)) for q in range(p))
        assert abs(quality.margin(m, x)[i] - want) < 1e-3


def test_quality_is_learnt_and_held_out_rows_are_not(spark, texts):
    rng = random.Random(4)
    good, bad = [prose(rng, 80) + "." for _ in range(150)], [" ".join(["SPAM!!", "###", "win"] * 30) for _ in range(150)]
    docs = frame(spark, [*good, *bad, None, "", *texts], [*range(302), *range(302, 302 + len(texts))])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 302 + len(texts) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.7) == (i < 150) for i in held) >= 0.97 * len(held)
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out("doc_id"), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert (quality.fit(docs, flipped).weight == model.weight).all()
    assert quality.fit(docs, labels.limit(0)) is None and {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.score(docs.drop("n_chars"), model).count() == len(got)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_quality_is_the_same_in_any_order(spark):
    """Several texts of an id, in two orders: one model."""
    rng = random.Random(4)
    texts = [prose(rng, 30) if i % 2 else "junk ### " * 20 + str(i) for i in range(120)] * 2
    texts = [f"{t} {i}" for i, t in enumerate(texts)]
    rows = list(zip(texts, [i % 120 for i in range(240)]))
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    models = []
    for order in (rows, rows[::-1]):
        models.append(quality.fit(frame(spark, [t for t, _ in order], [i for _, i in order]), labels))
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(*models))


def test_quality_of_held_out_documents(spark):
    """Ranks and verdicts for labelled documents that the model never saw."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").filter(quality.held_out("doc_id")).select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows) / len(rows)
    assert len(rows) > 800 and auc > 0.99 and right > 0.97
    few = quality.fit(docs, labels, max_bytes=50_000)
    assert few is not None and not (few.weight == model.weight).all()


# -- op 9 --------------------------------------------------------------------------------------------------------


def best_capacity(sizes, shards):
    from functools import lru_cache

    @lru_cache(None)
    def least(i, k):
        if k == 1 or i == len(sizes):
            return sum(sizes[i:])
        return min(max(sum(sizes[i:j]), least(j, k - 1)) for j in range(i, len(sizes) + 1))

    return least(0, shards)


def test_capacity_is_minimax():
    rng = random.Random(6)
    for _ in range(150):
        sizes = [rng.choice((1, 2, 5, 30)) for _ in range(rng.randrange(1, 14))]
        k = rng.randrange(1, 6)
        assert sharding.smallest_capacity(sizes, k) == best_capacity(sizes, k)


@pytest.mark.parametrize("seed", range(4))
def test_cuts_without_all_groups_are_exact(spark, seed):
    rng = random.Random(seed)
    n = 4000
    sizes = [rng.randrange(1, 90) if rng.random() < 0.98 else 5000 for _ in range(n)]
    if seed == 1:
        sizes[1234] = sum(sizes) // 2
    keys = sorted(rng.sample(range(-(10**6), 10**9 if seed == 2 else 10**6), n))
    groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
    ends = sharding.cuts(groups, 16, ranges=32, near=40)
    shard = [sum(k > e for (e,) in ends) for k in keys]
    load = Counter()
    for s, z in zip(shard, sizes):
        load[s] += z
    assert max(load.values()) == sharding.smallest_capacity(sizes, 16)


def test_shards_keep_groups_and_number_rows(spark, texts):
    docs = [*texts, *["same text here"] * 60]
    got = sharding.shard(frame(spark, docs), 4).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(docs)))
    place, slots, load = {}, defaultdict(list), Counter()
    for r in got:
        t = docs[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        assert place.setdefault(t, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = {}
    for t in docs:
        order[t or ""] = order.get(t or "", 0) + len((t or "").encode()) + 1
    assert max(load.values()) == sharding.smallest_capacity(list(order.values()), 4)


def test_shards_edges(spark):
    assert sharding.shard(frame(spark, []), 4).count() == 0
    got = sharding.shard(frame(spark, ["a", "b", None, "a"], [None, 1, 1, None]), 16).collect()
    assert len(got) == 4 and len({(r.shard, r.slot) for r in got}) == 4


@pytest.mark.parametrize("share", [0.3, 0.5, 0.97])
def test_shards_with_a_dominant_group(spark, share):
    """60,000 groups and one of a large share of all bytes, at default parameters; ids at both ends of the range, and none."""
    n = 60_000
    small = n * 7
    ids = F.when(F.col("id") == 0, -(1 << 63)).when(F.col("id") == 1, (1 << 63) - 1).when(F.col("id") % 5 != 2, F.col("id"))
    docs = spark.range(n).select(ids.alias("doc_id"), F.format_string("%06d", "id").alias("text"))
    big = "x" * 9999
    copies = int(share / (1 - share) * small / 10_000)
    docs = docs.unionByName(spark.range(copies).select((F.col("id") + 30_000).alias("doc_id"), F.lit(big).alias("text")))
    got = sharding.shard(docs, 16).toPandas()
    assert len(got) == n + copies and got.groupby("text_crc32").shard.nunique().max() == 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    order = got.groupby("text_crc32", as_index=False).agg({"size": "sum", "shard": "first"})
    load = got.groupby("shard")["size"].sum()
    total = small + copies * 10_000
    assert load.sum() == total and load.max() <= max(copies * 10_000 + 7, -(-total // 16) + 7) and len(order) == n + 1


# -- op 10 -------------------------------------------------------------------------------------------------------


def test_bundles_round_trip(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(warc, "FRAME_BYTES", 700)
    body = ["x" * 150, None, "", "y" * 99, "y" * 99, "x" * 150, "é\r\n\r\nWARC/1.1\r\n" * 20, "z" * 5000, "x" * 150, "é\r\n\r\nWARC/1.1\r\n" * 20]
    rows = [(i, f"http://h/{i}" if i % 4 else None, b, "d", 1) for i, b in enumerate(body)] + [(20, "http://a\r\nb", "w" * 120, "d", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first int")
    folder = warc.new_folder(spark)
    index = warc.write_bundles(pages, folder)
    got = warc.read_bundles(index, folder).collect()
    assert len(got) == len(rows) == index.count()
    want = {(i, len((b or "").encode()), hashlib.sha256((b or "").encode()).hexdigest(), "response", None) for i, b in enumerate(body) if i not in (5, 8, 9)}
    want |= {(i, len(body[i].encode()), hashlib.sha256(body[i].encode()).hexdigest(), "revisit", f) for i, f in ((5, 0), (8, 0), (9, 6))}
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id != 20} == want
    assert {r.record_type for r in got if r.page_id == 20} == {"response"}
    head, payload = warc.fetch(index, folder, 6)
    assert payload == body[6].encode() and head["WARC-Type"] == "response"
    assert warc.read_bundles(warc.write_bundles(pages.limit(0), warc.new_folder(spark)), folder).count() == 0


def test_bundles_are_ordinary_zstandard(spark):
    import io

    import zstandard

    pages = spark.createDataFrame([(i, "http://h/", "p" * 200 + str(i)) for i in range(5)], "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    names = {r.bundle for r in warc.write_bundles(pages.coalesce(1), folder).collect()}
    from pyarrow import fs

    at, base = fs.FileSystem.from_uri(folder)
    data = at.open_input_file(f"{base}/{names.pop()}").read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 5
