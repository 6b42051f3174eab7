"""Whitening, MinHash near-duplicates and hard negatives against brute force, with nulls, ties, repeats, hot groups and odd sizes."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import minhash, negatives, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=12, seed=3, labels=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(labels, d)) * 0.3
    rows = [(i, [float(np.float32(v)) for v in centres[i % labels] + rnd.normal(size=d) * 0.4], i % labels) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(40)]  # one vector many times
    return rows


ODD = [(1000, None, 1), (1001, [], 1), (1002, [0.1] * 5, 1), (1003, [None] + [0.1] * 11, 1), (1004, [float("nan")] + [0.1] * 11, 1), (1005, [float("inf")] + [0.1] * 11, 0), (None, [0.2] * 12, 2), (5, [0.3, -0.3] * 6, 0), (5, [0.3, -0.3] * 6, 0), (1006, [0.0] * 12, None), (1007, [0.0] * 12, 1)]


def whole(v):
    return [math.floor(256 * c) for c in v]


def fit_rows(rows, d=12):
    return [(i, whole(v)) for i, v, _ in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]


# --- 11 whitening

@pytest.mark.parametrize("n,k", [(1, 4), (2, 4), (9, 9), (64, 6)])
@pytest.mark.parametrize("kind", ["random", "repeated", "diagonal", "graded"])
def test_components_match_the_spectrum(n, k, kind):
    rnd = np.random.default_rng(n)
    q, _ = np.linalg.qr(rnd.normal(size=(n, n)))
    e = {"random": rnd.random(n), "repeated": np.repeat(rnd.random(n), 2)[:n], "diagonal": rnd.integers(0, 3, n).astype(float), "graded": 10.0 ** -np.arange(n)}[kind]
    a = np.diag(e) if kind == "diagonal" else q @ np.diag(e) @ q.T
    values, u = whitening.components((a + a.T) / 2, k)
    assert u.shape == (n, min(k, n)) and np.allclose(values, np.sort(e)[::-1][:k], atol=1e-13)
    assert np.abs(u.T @ u - np.eye(min(k, n))).max() < 1e-13 and np.abs(a @ u - u * values).max() < 1e-13


def test_polar_of_an_ill_conditioned_matrix():
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(20, 20)))
    e = np.array([-1, 1] * 10) * 10.0 ** -np.linspace(0, 12, 20)
    assert np.abs(whitening.polar(q @ np.diag(e) @ q.T) - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-3
    e = np.array([-1, 1] * 10) * 10.0 ** -np.linspace(0, 4, 20)
    assert np.abs(whitening.polar(q @ np.diag(e) @ q.T) - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-11


def test_whitening_matches_numpy(spark):
    rows = vectors() + ODD
    df = spark.createDataFrame([(*r, 1.0) for r in rows], VECTORS + ", x double").repartition(5)
    got = whitening.whiten(df).collect()
    kept = fit_rows(rows)
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    want = defaultdict(list)
    for i, x in kept:
        for c, w in enumerate((np.array(x) - s / n) @ u / np.sqrt(e)):
            want[i, c + 1].append((sum((n * a - int(b)) ** 2 for a, b in zip(x, s)), w))
    sign = {}
    for r in got:
        dev = sorted(want[r["vec_id"], r["component"]])
        assert r["deviation"] in [v for v, _ in dev]
        assert math.isclose(r["explained"], e[r["component"] - 1] / np.trace(cov), rel_tol=1e-10)
        w = next(w for v, w in dev if v == r["deviation"])
        if abs(w) > 0.1:
            sign.setdefault(r["component"], np.sign(w * r["whitened"]))
        assert abs(abs(w) - abs(r["whitened"])) < 1e-8
        assert abs(w) < 0.1 or np.sign(w * r["whitened"]) == sign[r["component"]]


def test_whitening_edge_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame(ODD[:2])).count() == 0
    one = whitening.whiten(frame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(c, 1, 0, None, None, None) for c in (1, 2)] * 2
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)])).collect()
    assert sum(r["whitened"] is not None for r in line) == 5 and {r["component"] for r in line} == {1, 2, 3}
    assert all(math.isclose(r["explained"], 1) for r in line if r["component"] == 1)
    huge = whitening.whiten(frame([(1, [1e15, 0.0], 0), (2, [-1e15, 1.0], 0), (3, [0.0, 2.0], 0)])).collect()
    assert len(huge) == 6 and any(r["deviation"] is None for r in huge)
    far = whitening.whiten(frame([(1, [3e38, 0.0], 0), (2, [0.0, 1.0], 0)]))
    assert far.count() == 4


# --- 12 MinHash

def near_texts(seed=5):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(1, 90))]
        texts.append(" ".join(t))
        for _ in range(rnd.randint(0, 4)):
            u = list(t)
            for _ in range(rnd.randint(0, 1 + len(t) // 15)):
                u[rnd.randrange(len(u))] = rnd.choice(vocab)
            texts.append(" ".join(u))
    base = [rnd.choice(vocab) for _ in range(60)]
    for _ in range(150):  # a large group of near copies
        u = list(base)
        for _ in range(rnd.randint(0, 4)):
            u[rnd.randrange(60)] = rnd.choice(vocab)
        texts.append(" ".join(u))
    passage = " ".join(base[:30])
    texts += [passage + " " + " ".join(rnd.choice(vocab) for _ in range(rnd.randint(20, 60))) for _ in range(80)]  # a passage that many share
    texts += [texts[0]] * 60 + ["One", "ONE", "one two", "one  Two", "", None, "  \t", "ß", "x\x0by z", "X Y\x1cZ"]
    rnd.shuffle(texts)
    return texts


def set_of(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(w) if len(w) == 1 else frozenset(zip(w, w[1:], strict=False))


def near_model(rows):
    """rows (id, text): (id, n, component, kept) by all pairs."""
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and top(i) != top(j):
                root[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(doc, low.get(top(i), doc))
    return Counter((doc, len(sets[i]), (c := low.get(top(i))), doc is not None and doc == c) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("kw", [{}, {"list_block": 7, "set_block": 2000}])
def test_minhash_matches_all_pairs(spark, kw):
    rows = list(enumerate(near_texts()))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, key string").repartition(6)
    got = Counter(tuple(r) for r in minhash.near_duplicates(df, **kw).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == near_model(rows)


def test_minhash_edge_cases(spark):
    texts = near_texts()[:60]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (4, texts[5]), (None, texts[6]), (None, texts[6]), (None, "all of its own"), (None, None), (2, None), (900, "w " * 9000 + "end"), (901, " w" * 20000 + " end"), (902, "y" * 300000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == near_model(rows)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.near_duplicates(df.filter("text IS NULL")).count() == 2


# --- 13 hard negatives

def negatives_model(rows, step=50, d=12):
    """rows (place, id, label, x): results as a multiset, by all pairs."""
    live = [(p, i, lab, x) for p, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v) for x in [whole(v)]]
    out = Counter()
    for p, i, lab, x in live:
        if i is None or i % step:
            continue
        ranked = sorted(((-sum(a * b for a, b in zip(x, y)), j is None, j or 0, q, other) for q, j, other, y in live if q != p), key=lambda r: r[:4])
        for s, gone, j, *_ in [r for r in ranked if r[4] == lab][:5]:
            fits = [r for r in ranked if r[4] != lab and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            for rank, r in enumerate(fits, 1):
                out[i, None if gone else j, rank, None if r[1] else r[2], -s, -r[0]] += 1
    return out


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 40, "batch_bytes": 2000}, {"references": 1}])
def test_negatives_match_all_pairs(spark, kw):
    rows = vectors() + ODD + [(100, [0.1 * (i % 3) for i in range(12)], 2), (100, [0.2] * 12, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS + ", score int").repartition(3)
    got = Counter(tuple(r) for r in negatives.mine(df, **kw).collect())
    want = negatives_model(rows)
    assert sum(want.values()) > 60 and got == want


def test_negatives_edge_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert negatives.mine(frame([])).count() == 0 and negatives.mine(frame(ODD[:2])).count() == 0
    zero = [(i, [0.0, 0.0], i % 2) for i in range(9)]
    assert Counter(tuple(r) for r in negatives.mine(frame(zero)).collect()) == negatives_model(zero, d=2)
    assert negatives.mine(frame([(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 1)])).count() == 0  # no positive
    big = [(i, [float(np.float32(1e6 * (1 + i))), 1.0], i % 2) for i in range(6)]
    assert Counter(tuple(r) for r in negatives.mine(frame(big)).collect()) == negatives_model(big, d=2)
    assert negatives.mine(frame([(i, [3e38, 1.0], i % 2) for i in range(6)])).columns[0] == "anchor_id"


def test_score_bounds_hold():
    rnd = np.random.default_rng(4)
    x = np.floor(256 * rnd.normal(size=(400, 8)) * rnd.random((400, 1)))
    x[::50] = 0
    norms = np.linalg.norm(x, axis=1)
    theta = negatives.angles(x, norms, negatives.references_of(x, 6))
    low, high = negatives.score_bounds(theta, norms, theta, theta, norms, norms)
    s = x @ x.T
    assert (low <= s).all() and (s <= high).all() and (high - low).min() < 1000
