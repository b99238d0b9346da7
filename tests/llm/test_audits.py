"""License scans, source divergence and centroid clustering against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quire.llm")
from test_operators import frame, prose  # noqa: E402

from quire.llm import centroids, divergence, licenses, queries  # noqa: E402

# -- op 11 -------------------------------------------------------------------------------------------------------


def license_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def brute_phrases(text):
    w = license_words(text)
    at = [(k, t.label) for t in licenses.PHRASES for k in range(len(w)) if w[k : k + len(t.text.split())] == t.text.split()]
    starts = [k for k, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def edited(rng, text, edits):
    """The words with so many of them replaced, dropped or doubled, none in the first ten."""
    w = text.split()
    for _ in range(edits):
        i = rng.randrange(10, len(w))
        w[i : i + 1] = rng.choice(([], ["other"], [w[i], "and"]))
    return " ".join(w)


@pytest.fixture(scope="module")
def licensed():
    rng = random.Random(7)
    t = {x.name: x.text for x in licenses.TEMPLATES}
    texts = [None, "", " \n", "MIT", "mit license", "the MIT-License; mit\tlicense MIT licenses", "General Public License general public license", "Apache License apache license é"]
    texts += [f"{prose(rng, 20)} {t[n]} {prose(rng, 20)}" for n in t]
    texts += [f"{prose(rng, 9)} {edited(rng, t[n], e)} {prose(rng, 9)}" for n in ("mit-grant", "bsd-conditions", "gpl-notice", "unlicense") for e in (1, 2, 4)]
    texts += [f"{t['mit-grant']} {prose(rng, 6000)} {t['isc-grant']} mit license {t['mit-grant']}", prose(rng, 20_000), "mit license " * 3000]
    texts += [" ".join(t["mit-grant"].split()[:40]), "this software and any other software to deal in"]
    return texts


@pytest.mark.parametrize("few", (licenses.FEW, (0, 0)))
def test_license_phrases_are_brute_force(spark, licensed, tmp_path, monkeypatch, few):
    monkeypatch.setattr(licenses, "FEW", few)
    ids = [*range(len(licensed) - 2), None, None]
    frame(spark, licensed, ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_license_votes(spark, str(tmp_path)).collect()
    found = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    assert found == Counter((i, *brute_phrases(t)) for i, t in zip(ids, licensed))
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {"", *r.labels.split(",")} and (r.score > 0) == bool(r.labels) for r in got)


def test_edited_licenses_are_found(spark, licensed):
    got = {r.id: r for r in licenses.Scan(frame(spark, licensed)).labelled().collect()}
    for k, t in enumerate(licenses.TEMPLATES):
        r = got[8 + k]
        assert t.label in r.labels and r.score == 1.0
        # Words around it may match the template's end, but nothing before its own place.
        assert any(s.template == k and s.start == 20 and s.length == len(licenses.words(t.text)) for s in r.spans)
    assert got[8 + [t.name for t in licenses.TEMPLATES].index("cc-by-nc")].labels == ["cc-by-nc"]
    assert "gpl" in got[8 + [t.name for t in licenses.TEMPLATES].index("lgpl-notice")].labels  # by its phrase alone
    first = 8 + len(licenses.TEMPLATES)
    for i, (n, e) in enumerate((n, e) for n in ("mit-grant", "bsd-conditions", "gpl-notice", "unlicense") for e in (1, 2, 4)):
        t = next(t for t in licenses.TEMPLATES if t.name == n)
        r = got[first + i]
        assert t.label in r.labels, (n, e)
        whole, template = license_words(licensed[first + i]), license_words(t.text)
        best = max((s for s in r.spans if licenses.TEMPLATES[s.template].name == n), key=lambda s: s.matched)
        assert best.matched == lcs(whole, template) == lcs(whole[best.start : best.start + best.length], template)
    both = got[first + 12]
    assert both.labels == ["isc", "mit"] and sum(licenses.TEMPLATES[s.template].name == "mit-grant" for s in both.spans) == 2
    assert not got[len(licensed) - 1].labels and not got[len(licensed) - 2].labels


def test_common_words_are_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice((b"a", b"b", b"c", b"d")) for _ in range(rng.randrange(12))] for _ in range(2))
        n, first, last = licenses.common_words(a, b)
        assert n == lcs(a, b) and (not n or lcs(a[first : last + 1], b) == n > lcs(a[first:last], b) and n > lcs(a[first + 1 : last + 1], b))


def test_license_edges(spark):
    assert licenses.Scan(frame(spark, [])).labelled().isEmpty()
    same = licenses.Scan(frame(spark, ["mit license"] * 3 + [None, None], [1, 1, None, None, 2])).labelled().collect()
    assert sorted((r.id is None, r.id or 0, tuple(r.labels)) for r in same) == [(False, 1, ("mit",)), (False, 1, ("mit",)), (False, 2, ()), (True, 0, ()), (True, 0, ("mit",))]
    own = [licenses.Template("own", "mine", "one two three four five six seven eight nine ten")]
    spans = licenses.Scan(frame(spark, ["x one two three four five nine six seven eight ten y", "one two three four"]), own).spans().collect()
    assert [(r.id, r.label, r.start_word, r.n_words, round(r.share, 3)) for r in spans] == [(0, "mine", 1, 10, 0.9)]
    with pytest.raises(ValueError):
        licenses.positions(spark, [licenses.Template("one", "x", "word")])


# -- op 12 -------------------------------------------------------------------------------------------------------

DOCS = "text string, lang string, source string, term int, n int, docs string, p int, rank int, doc_id long"


def sourced(spark, rows):
    return spark.createDataFrame([(t, a, s, 1, 2, "x", 3, 4, i) for i, (t, a, s) in enumerate(rows)], DOCS)


def brute_divergence(rows, least, top):
    terms = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), a or "", s or "") for t, a, s in rows]
    docs = defaultdict(Counter)
    for w, a, _ in terms:
        docs[a].update(set(w))
    kept = {a: sorted(t for t, n in docs[a].items() if n >= least) for _, a, _ in terms}
    count, whole = defaultdict(Counter), defaultdict(Counter)
    for w, a, s in terms:
        own = [t for t in w if t in set(kept[a])]
        count[a, s].update(own)
        whole[a].update(own)

    def weights(c, a):
        n, v = sum(c.values()), len(kept[a])
        return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept[a]}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    p, q, out = {g: weights(count[g], g[0]) for g in count}, {a: weights(whole[a], a) for a in kept}, []
    for a, s in p:
        pairs = [(-sum(f(p[a, s][t], p[b][t]) for t in kept[a]), b[1].encode()) for b in p if b[0] == a and b[1] != s]
        more = [(-f(p[a, s][t], q[a][t]), t.encode()) for t in kept[a] if count[a, s][t] and p[a, s][t] > q[a][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
            out += [(a, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("width", (1 << 18, 16))
def test_divergence_is_brute_force(spark, width, monkeypatch):
    """The narrow sketch lets every term pass, the wide one few in vain: the result is the same."""
    rng = random.Random(6)
    pool = ["alpha", "Beta", "BETA", "gamma7delta", "é", "日本", "ö-ö", "eps", "zeta", "rare"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(pool, [len(pool) - k for k in range(len(pool))], k=rng.randrange(40))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "c", None, "é"))) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "lone", "x"), ("12 34", "lone", "y"), ("only here", "solo", "z"), ("alpha " * 5000, "en", "a")] + [("same text beta", "en", "copy")] * 40
    monkeypatch.setattr(divergence, "HELD_ROWS", 40)
    got = sorted(tuple(r) for r in divergence.Audit(sourced(spark, rows), min_docs=6, width=width).report(top=4).collect())
    assert got == brute_divergence(rows, 6, 4)
    assert divergence.Audit(sourced(spark, [])).report().isEmpty()


def test_sketch_never_underestimates_and_discards(spark):
    rng = random.Random(8)
    rows = [(" ".join({f"{x}" for x in ("".join(rng.choices("abcdefghij", k=4)) for _ in range(30))} | {"everywhere"}), "en", "s") for _ in range(100)]
    docs = sourced(spark, rows).select("lang", "source", "text")
    table = divergence.sketch(docs, 10)
    true = Counter(t for w, _, _ in rows for t in set(w.split()))
    batch = docs.toArrow().to_batches()
    passed = {(t, n) for b in divergence._survivors(iter(batch), table, 10) for t, n in zip(b.column("term").to_pylist(), b.column("docs").to_pylist())}
    assert {t for t, n in true.items() if n >= 10} <= {t for t, _ in passed} and ("everywhere", 100) in passed
    assert len(passed) < 0.05 * len(true) + sum(n >= 10 for n in true.values())
    with pytest.raises(ValueError):
        divergence.sketch(docs, 10, width=1000)


def test_weights_beyond_64_bits(spark):
    big = 4 * 10**12
    got = spark.range(1).select(divergence.weight(F.lit(big), F.lit(3 * big), F.lit(5)).alias("p")).first().p
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 10)


# -- op 13 -------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, cluster int, id int, q int")


def brute_lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in range(len(c)):
            if mine := [q for (_, q), o in zip(kept, own) if o == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [(i, *near(q)) for i, q in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last), key=repr)


@pytest.mark.parametrize("spread", (0.02, 2.0, 300.0))
def test_clusters_are_brute_force(spark, spread):
    """From vectors of which most are tied or equal to such that are all different."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, spread) for _ in range(64)]) for i in range(120)]
    rows += [(rng.randrange(120), rows[rng.randrange(120)][1]) for _ in range(30)] + [(None, rows[0][1]), (None, rows[1][1])]
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]), (905, [float("nan")] + [0.5] * 63), (906, [float("-inf")] * 64), (907, [-0.0] * 64)]
    got = centroids.report(centroids.cluster(vectors(spark, rows)))
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lloyd(rows, 16, 3, 64)


def test_cluster_edges(spark):
    assert centroids.report(centroids.cluster(vectors(spark, []))).isEmpty()
    few = [(i, [float(i)] * 64) for i in range(5)]
    assert sorted(map(tuple, centroids.report(centroids.cluster(vectors(spark, few))).collect()), key=repr) == brute_lloyd(few, 16, 3, 64)
    large = [(1, [3e38] * 64), (2, [2.0e6] * 64), (3, [-2.0e6] * 64)]
    got = centroids.report(centroids.cluster(vectors(spark, large), k=1)).collect()
    assert {r.id for r in got} == {2, 3} and all(r.distance == 64 * (128 * 10**6) ** 2 for r in got)


def test_rounds_compare_only_what_has_changed():
    """After a round without moves nothing is computed; owners are those of a full comparison."""
    rng = np.random.default_rng(3)
    q, c = rng.integers(-9, 9, (200, 8)), rng.integers(-9, 9, (6, 8))
    full = lambda c: tuple(np.array(x) for x in zip(*(min((int(((v - x) ** 2).sum()), j) for j, x in enumerate(c)) for v in q)))
    owner, distance = centroids._nearest(q, np.full(200, -1), np.zeros(200, np.int64), c, np.ones(7, bool))
    for _ in range(5):
        d, o = full(c)
        assert (owner == o).all() and (distance == d).all()
        moved = np.append(rng.random(6) < 0.4, False)
        c = np.where(moved[:6, None], c + rng.integers(-2, 3, c.shape), c)
        moved[:6] &= True
        owner, distance = centroids._nearest(q, owner, distance, c, moved)
    same = centroids._nearest(q, owner, distance, c * 0 + 10**6, np.zeros(7, bool))
    assert (same[0] == owner).all() and (same[1] == distance).all()
