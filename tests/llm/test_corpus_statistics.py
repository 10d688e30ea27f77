"""Collocations, source mixing and whitening."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import collocations, mixing, queries, whitening
from postlake.llm.common import read
from tests.conftest import SF_MED, SF_SMALL
from tests.llm import helpers as H
from tools.check_oracle import rows_of


@pytest.mark.parametrize("name", ["op11_collocations", "op12_source_mix"])
def test_query_equals_sql(spark, name):
    got, want = rows_of(queries.QUERIES[name](spark, SF_MED).toPandas()), rows_of(H.oracle(SF_MED, queries.ORACLE[name]))
    assert got[0] == want[0] and len(got[1]) == len(want[1]) > 0
    assert [x for x in zip(got[1], want[1]) if x[0] != x[1]][:3] == []


# --- Collocations -------------------------------------------------------

def brute_collocations(rows, top, least, share=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(H.LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and 100 * b >= share * a and b >= least and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in counts.items() if p[0] in q):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, rows=60):
    """Zipf-like words with fixed phrases, long and short pieces, several languages."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Über", "naïve", "漢字", "a.b", "x\x00y"]
    fixed = ["alpha beta gamma", "beta gamma delta", "new york", "w0 w0 w0 w0", "of the"]
    out = []
    for _ in range(rows):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else words[min(int(draw.expovariate(0.4)), len(words) - 1)] for _ in range(draw.randrange(40))]
        out.append((draw.choice(["en", "en", "en", "de", None, "und"]), draw.choice([" ", "\t ", "  "]).join(parts) + draw.choice(["", ".", "\n", " !"])))
    return out + [("en", None), ("en", ""), (None, "..."), ("fr", "lone word")]


@pytest.mark.parametrize("top, least, first", [(2000, 3, 4), (3, 2, 1), (5, 3, 1)])
def test_collocations_against_brute_force(spark, monkeypatch, top, least, first):
    monkeypatch.setattr(collocations, "FIRST", first)  # so that small tables take several waves
    monkeypatch.setattr(collocations, "STEP", 2)
    rows = corpus(top + least)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("w1", F.lit("x")).withColumn("n", F.lit(1)).withColumn("a.b", F.lit(1))
    got = [tuple(r) for r in collocations.collocations(docs, top=top, least=least).collect()]
    assert sorted(got) == brute_collocations(rows, top, least)


def test_collocations_with_full_filters_and_small_blocks(spark, monkeypatch):
    """Filters that let everything through, and blocks of a few words, change nothing."""
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = brute_collocations(rows, 50, 2)
    assert sorted(tuple(r) for r in collocations.collocations(docs, top=50, least=2, most_bits=64).collect()) == want
    pairs = collocations.collocations(docs, top=10**6, least=2, most_words=2).count()
    assert pairs >= len([x for x in want if x[2].count(" ") == 1])
    held = collocations.TOKENS
    try:
        collocations.TOKENS = 7
        text = b" ".join(b"v%d" % (i % 5) for i in range(100)) + b". end of it"
        for size in (1, 2, 3):
            counts = collocations.Counts("en", size, {"words": ONES, "pairs": ONES, "right": ONES, "left": ONES} if size > 1 else {})
            for block in collocations.blocks_of([text, text], size):
                counts.add(block)
            sums = {tuple(r[f"w{i + 1}"] for i in range(size)): r["n"] for b in counts.take() for r in b.to_pylist()}
            whole = Counter()
            for piece in (text.split(b". ")) * 2:
                w = piece.split()
                whole.update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
            assert sums == whole
    finally:
        collocations.TOKENS = held


ONES = np.full(64, 2**64 - 1, np.uint64)


def test_scores_are_exact(spark):
    draw = random.Random(4)
    rows = [(a, a + draw.randrange(10**12), a + draw.randrange(10**3)) for a in (draw.randrange(1, 10**13) for _ in range(200))]
    rows += [(10**14, 10**14, 10**14), (10**14 - 1, 10**14, 10**14)]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    got = df.select("a", "l", "r", collocations.exact_floor(F.col("a"), F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got)


def test_collocations_awkward(spark):
    got = collocations.collocations(H.awkward(spark), least=2).collect()
    assert {r.lang for r in got} <= {"en", "de", "fr", "und"} and any("lorem ipsum" in r.phrase for r in got)
    assert collocations.collocations(H.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(H.empty(spark), most_words=4)


# --- Mixing -------------------------------------------------------------

def filled(sizes, weights, share, epochs):
    """Water-filling in exact fractions, clamping one round at a time."""
    caps = [Fraction(s) * Fraction(str(epochs)) for s in sizes]
    w = [Fraction(str(x)) for x in weights]
    left, open_, out = Fraction(sum(sizes)) * Fraction(str(share)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while True:
        total = sum(w[i] for i in open_)
        part = {i: w[i] * left / total if total else Fraction(0) for i in open_}
        over = {i for i in open_ if w[i] > 0 and (part[i] > caps[i] or not total)}
        if not over:
            for i in open_:
                out[i] = part[i]
            return [float(x) for x in out]
        for i in over:
            out[i] = caps[i]
            left -= caps[i]
        open_ -= over


@pytest.mark.parametrize("seed", range(4))
def test_water_filling_against_fractions(spark, seed):
    draw = random.Random(seed)
    sizes = [draw.choice([0, 1, 5, draw.randrange(10**6), draw.randrange(10**12)]) for _ in range(30)]
    weights = [draw.choice([1, 2, 3, 0.25, 100, 0]) for _ in sizes]
    share, epochs = draw.choice([(1.5, 2), (0.1, 1), (3.5, 4), (5, 2)])
    df = spark.createDataFrame([(str(i), s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, words bigint, weight double")
    got = {r.source: r.target for r in mixing.water_fill(df, share, epochs).collect()}
    want = filled(sizes, weights, share, epochs)
    if sum(s for s, w in zip(sizes, weights) if w) * epochs < sum(sizes) * share:
        want = [float(s * epochs) if w else 0.0 for s, w in zip(sizes, weights)]
    assert [got[str(i)] for i in range(len(sizes))] == pytest.approx(want, rel=1e-12)


def test_mix_on_documents(spark):
    docs = read(spark, SF_MED, "documents")
    weights = mixing.cycled_weights(mixing.ranked_sources(docs))
    got = mixing.mix(docs, weights)
    assert got.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    rows = got.collect()
    by = defaultdict(list)
    for r in rows:
        assert r.size == len([x for x in re.split(r"[\x20\x09-\x0D]+", r.text or "") if x])
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for rs in by.values():
        target = rs[0].target
        assert {(r.target, r.source_size) for r in rs} == {(target, sum(r.size for r in rs))}
        assert abs(sum(r.taken for r in rs) - target) <= 0.5
        assert sum(r.taken % r.size != 0 for r in rs if r.size) <= 1  # one document is cut
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=len(by))
    order = {s: i for i, s in enumerate(sorted(s for s in by if s is not None))}
    assert {r.source: float(r.weight) for r in weights.collect() if r.source} == {s: float((3, 1, 2)[i % 3]) for s, i in order.items()}
    # The same, whatever the partitions, and by narrow cells.
    again = mixing.mix(docs.repartition(7), weights.repartition(3), keep=["doc_id"], cell_rows=2, digits=1)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again.collect())
    other = mixing.mix(docs, weights, keep=["doc_id"], seed=1).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) != sorted((r.doc_id, r.taken) for r in other)
    for rs in _by_source(mixing.mix(docs, weights, whole_documents=True).collect()).values():
        assert all(r.taken in (0, r.size, 2 * r.size) for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
    mixed = mixing.expand(got).collect()
    assert Counter(r.doc_id for r in mixed) == {r.doc_id: -(-r.taken // r.size) for r in rows if r.taken}
    assert sum(len([x for x in re.split(r"[\x20\x09-\x0D]+", r.text) if x]) for r in mixed) == sum(r.taken for r in rows)


def _by_source(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    return by


def test_mix_awkward(spark):
    docs = H.awkward(spark)
    got = mixing.mix(docs, mixing.cycled_weights(mixing.ranked_sources(docs)))
    assert got.count() == len(H.ROWS) and H.others(got.drop("size", "source_size", "target", "taken")) == H.others(docs)
    by = _by_source(got.collect())
    assert None in by and by["src1"][0].target == 0
    assert sum(r.taken for rs in by.values() for r in rs) == pytest.approx(1.5 * sum(r.size for rs in by.values() for r in rs), abs=4)
    ranks = {r.source: r.place for r in mixing.ranked_sources(docs).collect()}
    assert ranks == {"host.example.fr": 0, "src0": 1, "src1": 2, None: 3}
    none = mixing.mix(H.empty(spark), mixing.cycled_weights(mixing.ranked_sources(H.empty(spark))))
    assert none.count() == 0
    lacking = mixing.mix(docs, spark.createDataFrame([("src0", 1), ("src0", 3), ("nobody", 9)], "source string, weight int"))
    assert lacking.count() == len(H.ROWS)
    assert all((r.taken > 0) == (r.source == "src0" and r["size"] > 0) or r.source == "src0" for r in lacking.collect())


def test_mix_is_native(spark):
    docs = read(spark, SF_SMALL, "documents")
    plan = mixing.mix(docs, mixing.cycled_weights(mixing.ranked_sources(docs)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- Whitening ----------------------------------------------------------

def dense(vectors, k=32):
    x = np.floor(np.asarray(vectors, np.float64) * 64)
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(c))
    return c, values[::-1][:k], axes[:, ::-1][:, :k], values.sum()


def check_whitened(rows, vectors, ids, k=32):
    """Residuals, variances, deviations and the stated error, against numpy."""
    c, values, axes, trace = dense([vectors[i] for i in ids], k)
    n, place = len(ids), {v: i for i, v in enumerate(ids)}
    z = np.zeros((n, len(values)))
    for r in rows:
        z[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
    assert len(rows) == z.size
    assert np.abs(z.T @ z / n - np.eye(len(values))).max() < 1e-9 and {r.identity_error for r in rows} == {rows[0].identity_error}
    assert rows[0].identity_error < 1e-9
    v = c.T @ c / n
    for j, e in enumerate(values):
        u = np.linalg.lstsq(c, z[:, j] * np.sqrt(e), rcond=None)[0]  # the axis that gave the column
        assert np.linalg.norm(v @ u - e * u) < 1e-11 * values[0] and np.linalg.norm(u) == pytest.approx(1, abs=1e-9)
    x = np.floor(np.asarray([vectors[i] for i in ids], np.float64) * 64).astype(np.int64) + 1_000_000
    exact = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert all(int(r.deviation) == exact[place[r.vec_id]] for r in rows)


def test_whitening_on_embeddings(spark):
    table = read(spark, SF_MED, "embeddings")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    usable = {i: v for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    check_whitened(queries.QUERIES["op13_whitening"](spark, SF_MED).collect(), usable, sorted(usable))


def test_jacobi_davidson_against_dense():
    """Spectra with clusters, decay, equal and zero values; subspaces far smaller than
    the space, so that corrections and restarts do the work."""
    draw = np.random.default_rng(2)
    spectra = [np.arange(200.0)[::-1] + 1, 0.9 ** np.arange(200), np.r_[np.full(5, 7.0), np.full(195, 1.0)],
               np.r_[100.0, 99.999, np.linspace(50, 0, 198)], np.r_[np.ones(10), np.zeros(190)], np.zeros(200)]
    for values in spectra:
        q = np.linalg.qr(draw.normal(size=(200, 200)))[0]
        a = q * values @ q.T
        a = (a + a.T) / 2
        calls = []
        got, axes = whitening.largest_pairs(lambda u: calls.append(u.shape[1]) or a @ u, 200, 8, block=4, most_basis=40)
        assert np.allclose(got, np.sort(values)[::-1][:8], atol=1e-11 * max(values[0], 1), rtol=0)
        assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12
        assert np.linalg.norm(a @ axes - axes * got, axis=0).max() <= 1e-12 * max(values[0], 1)
    with pytest.raises(RuntimeError):
        whitening.largest_pairs(lambda u: a @ u + draw.normal(size=u.shape), 200, 8, rounds=3)


def test_minres_against_dense():
    draw = np.random.default_rng(3)
    a = draw.normal(size=(12, 12))
    a = a + a.T  # indefinite
    right = draw.normal(size=(12, 3))
    right[:, 2] = 0
    shift = np.array([0.3, -2.0, 1.0])
    got = whitening.minres(lambda y: a @ y - y * shift, right, 12)
    want = np.stack([np.linalg.solve(a - s * np.eye(12), b) for s, b in zip(shift, right.T)], axis=1)
    assert np.allclose(got, want, atol=1e-8)
    sizes = [np.linalg.norm(right[:, 0] - (a - 0.3 * np.eye(12)) @ whitening.minres(lambda y: a @ y - y * shift[0], right[:, :1], m)[:, 0]) for m in range(8)]
    assert all(x >= y - 1e-12 for x, y in zip(sizes, sizes[1:]))  # the residual never grows


def test_whitening_awkward(spark):
    draw = np.random.default_rng(8)
    good = {i: [float(np.float32(x)) for x in draw.normal(size=5) * [9, 5, 3, 1, 0.5]] for i in range(60)}
    rows = [(i, v) for i, v in good.items()] + [
        (100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
        (104, []), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("x", F.lit(1)).withColumn("a.b", F.lit(1))
    check_whitened(whitening.whiten(table).collect(), good, sorted(good), 5)
    assert {r.component for r in whitening.whiten(table, components=2).collect()} == {1, 2}
    for few in (rows[60:], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], []):
        assert whitening.whiten(spark.createDataFrame(few, "vec_id bigint, embedding array<double>")).count() == 0
    # Dimensions that copy each other leave fewer components; repeated rows and null ids count.
    flat = [(None if i < 2 else i // 2, [float(i // 2 % 7), float(i // 2 % 7), 1.0]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id bigint, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and len(got) == 40 and got[0].identity_error < 1e-9 and got[0].explained == pytest.approx(1)
    # Large entries: deviations beyond 64 bits stay exact.
    big = [(i, [float(v) * 1e12, float(i)]) for i, v in enumerate(draw.integers(-9, 9, 20))]
    x = [[int(np.floor(c * 64)) for c in v] for _, v in big]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((20 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    got = whitening.whiten(spark.createDataFrame(big, "vec_id bigint, embedding array<double>"), components=1).collect()
    assert {r.vec_id: int(r.deviation) for r in got} == want
