"""Operators on embeddings against brute force: whitening and hard negatives."""

import math
import random

import numpy as np
import pytest

from millrace.llm import negatives, whitening
from millrace.llm.queries import QUERIES

SCHEMA = "vec_id bigint, label int, embedding array<float>, x string, row bigint, i int, j int, score double, component int, n long, rank int"
CLASHES = ("x", 1, 2, 3, 0.5, 9, 8, 7)


def embeddings(spark, folder, rows):
    """A table folder with `rows` of (vec_id, label, embedding) and columns whose names clash."""
    spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def random_rows(seed, count=160, dimensions=6):
    draw = np.random.RandomState(seed)
    scale = np.linspace(0.6, 0.1, dimensions)
    out = [(i, int(draw.randint(0, 10)), [float(np.float32(v)) for v in draw.randn(dimensions) * scale]) for i in range(count)]
    out += [(300 + i, out[i][1], out[i][2]) for i in range(12)]  # copies
    out += [out[3], out[50]]  # whole rows repeated, one of them an anchor
    out += [
        (400, 1, None),
        (401, None, out[0][2]),
        (402, 2, [0.1] * (dimensions - 1) + [None]),
        (403, 2, [0.1] * (dimensions - 1) + [math.nan]),
        (404, 2, [math.inf] * dimensions),
        (405, 3, [0.25, 0.5]),
        (450, 3, []),
        (None, 4, out[1][2]),
        (406, 5, [0.0] * dimensions),
    ]
    return out


def integers(vector):
    return [math.floor(256 * v) for v in vector]


def is_usable(vector):
    return vector is not None and all(v is not None and math.isfinite(v) for v in vector)


# Whitening


def expected_whitening(vectors, components=4):
    """(n, sums, eigenvalues, eigenvectors, trace) over the different vectors."""
    fit = np.array(sorted({tuple(v) for v in vectors}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1][:components], basis[:, ::-1][:, :components], values.sum()


def test_whitening_equals_brute_force(spark, folder):
    rows = random_rows(1)
    got = QUERIES["op11_polynomial_whitening"](spark, embeddings(spark, folder, rows)).collect()
    held = [(i, integers(v)) for i, _, v in rows if is_usable(v) and len(v) == 6]
    n, sums, values, basis, trace = expected_whitening([v for _, v in held])
    assert len(got) == 4 * len(held)
    got = sorted(got, key=lambda r: (r["component"], r["vec_id"] is None, r["vec_id"] or 0))
    held = sorted(held, key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([v for _, v in held])
    want = (x - sums / n) @ basis / np.sqrt(values)
    white = np.array([r["whitened"] for r in got]).reshape(4, -1).T
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white - want * signs).max() < 1e-9
    for i, (vec_id, v) in enumerate(held):
        own = got[i :: len(held)]
        assert [r["component"] for r in own] == [1, 2, 3, 4]
        assert {r["vec_id"] for r in own} == {vec_id} and {r["n"] for r in own} == {n}
        assert {r["deviation"] for r in own} == {int(sum((n * a - int(s)) ** 2 for a, s in zip(v, sums)))}
        assert np.allclose([r["explained"] for r in own], values / trace, rtol=1e-12)
    assert {r["identity_error"] < 1e-10 for r in got} == {True}


def test_whitening_of_odd_tables(spark, folder):
    query = QUERIES["op11_polynomial_whitening"]
    few = [[], [(1, 1, None)], [(1, 1, [0.5, 0.25])], [(1, 1, []), (2, 1, [])], [(1, 1, [0.5, 0.25]), (2, 0, [0.5, 0.25])]]
    for k, rows in enumerate(few):
        assert query(spark, embeddings(spark, f"{folder}{k}", rows)).count() == 0
    # Two different vectors spread in one direction only.
    got = query(spark, embeddings(spark, f"{folder}x", [(1, 1, [0.5, 0.25]), (2, 0, [0.0, 0.0]), (2, 0, [0.0, 0.0])])).collect()
    assert sorted((r["vec_id"], round(abs(r["whitened"]), 9), r["explained"]) for r in got) == [(1, 1.0, 1.0), (2, 1.0, 1.0), (2, 1.0, 1.0)]


def test_equal_eigenvalues_get_orthogonal_components(spark):
    unit = [[0] * k + [s] + [0] * (4 - k) for k in range(5) for s in (-7, 7)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(unit)], "vec_id bigint, v array<bigint>")
    model = whitening.fit_whitening(spark, rows, "v", 3)
    assert np.allclose(model.values, 49 / 5) and np.allclose(model.explained, 0.2)
    assert np.abs(model.components @ model.components.T - np.eye(3)).max() < 1e-14
    assert model.identity_error < 1e-12


def test_entries_beyond_doubles(spark):
    big = 2**61
    rows = spark.createDataFrame([(1, [big, 1]), (2, [big - 3, 5]), (3, [big - 1, 4])], "vec_id bigint, v array<bigint>")
    model = whitening.fit_whitening(spark, rows, "v", 2)
    assert model.sums == [3 * big - 4, 10]
    # The covariance does not feel the offset.
    near = np.array([[0, 1], [-3, 5], [-1, 4]])
    values = np.linalg.eigvalsh(np.cov(near.T, bias=True))[::-1]
    assert np.allclose(model.values, values, rtol=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_characteristic_polynomial(spark, seed):
    draw = np.random.RandomState(seed)
    half = draw.randint(-30, 31, (5, 3 + seed))
    if seed == 0:
        half[0] = half[1] = 0  # zero columns: the reduction has no pivot there
    matrix = (half @ half.T).tolist()
    got = whitening.characteristic_polynomial(spark, matrix)
    # Faddeev and Le Verrier's recurrence in whole numbers.
    m, want, a = np.zeros((5, 5), dtype=object), [1], np.array(matrix, dtype=object)
    for k in range(1, 6):
        m = a @ m + want[-1] * np.eye(5, dtype=int).astype(object)
        want.append(-int((a @ m).trace()) // k)
    assert got == [int(w) for w in want[::-1]]


def test_roots_are_counted_and_isolated():
    polynomial = np.polynomial.polynomial.polyfromroots([2, 2, 3, 5]).astype(int).tolist()
    assert [whitening.roots_above(polynomial, p) for p in (0, 2, 3, 4, 5)] == [4, 2, 1, 1, 0]
    roots = whitening.largest_roots(polynomial, 4, 40)
    assert [r.times for r in roots] == [1, 1, 2]
    assert all(abs(float(r.middle) - v) < 1e-9 for r, v in zip(roots, (5, 3, 2)))
    assert whitening.largest_roots([0, 0, 1], 2) == []


# Hard negatives


def expected_negatives(rows, positives=5, negatives_=3):
    held = []
    for k, (i, label, v) in enumerate(rows):
        if label is not None and is_usable(v):
            held.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, integers(v), k))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for anchor in held:
        if anchor[0] is None or anchor[0] % 50:
            continue
        others = [h for h in held if h[3] != anchor[3] and len(h[2]) == len(anchor[2])]
        score = lambda h, a=anchor: sum(p * q for p, q in zip(a[2], h[2]))
        same = sorted(((score(h), h[0]) for h in others if h[1] == anchor[1]), key=order)[:positives]
        rest = [(score(h), h[0]) for h in others if h[1] != anchor[1]]
        for p, positive in same:
            fit = sorted((s for s in rest if 50 * p <= 100 * s[0] <= 95 * p), key=order)[:negatives_]
            out += [(anchor[0], positive, k, i, p, s) for k, (s, i) in enumerate(fit, 1)]
    return sorted(out, key=repr)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("blocks", [(512, 8192), (3, 20)])
def test_negatives_equal_brute_force(spark, folder, blocks, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", blocks[0])
    monkeypatch.setattr(negatives, "CANDIDATES", blocks[1])
    rows = random_rows(2, count=260)
    got = QUERIES["op12_tree_bound_negatives"](spark, embeddings(spark, folder, rows))
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == expected_negatives(rows)


def test_negatives_with_ties_and_hot_copies(spark, folder):
    random.seed(3)
    base = [[random.choice((-0.5, 0.25, 0.5)) for _ in range(3)] for _ in range(4)]
    rows = [(i, i % 3 if i % 2 else 1, base[0] if i % 3 else random.choice(base)) for i in range(210)]
    got = QUERIES["op12_tree_bound_negatives"](spark, embeddings(spark, folder, rows))
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == expected_negatives(rows)


def test_negatives_of_odd_tables(spark, folder):
    few = [[], [(50, None, [0.5])], [(50, 1, [0.5])], [(50, 1, [0.5]), (1, 1, [0.5])], [(51, 1, [0.5]), (1, 2, [0.5])]]
    for k, rows in enumerate(few):
        assert QUERIES["op12_tree_bound_negatives"](spark, embeddings(spark, f"{folder}{k}", rows)).count() == 0


def test_bounds_leave_out_only_what_cannot_enter():
    draw = np.random.RandomState(5)
    centres = draw.randint(-100, 100, (4, 12)) * 4
    anchors = np.repeat(centres, 10, axis=0) + draw.randint(-3, 4, (40, 12))
    rows = np.repeat(centres, 500, axis=0) + draw.randint(-20, 21, (2_000, 12))
    ids = np.arange(len(rows))
    windows = [[(-np.inf, np.inf), (0.0, 40_000.0)] for _ in anchors]
    count = negatives.Counted()
    nothing = np.zeros(len(rows), dtype=bool)
    best = negatives.tree_search(anchors, windows, rows, ids, ids, lambda a, part: nothing[part], 3, count)
    scores = anchors @ rows.T
    for a, found in enumerate(best):
        for (lo, hi), held in zip(windows[a], found.held):
            inside = [i for i in np.lexsort((ids, -scores[a])) if lo <= scores[a, i] <= hi][:3]
            assert held[1].tolist() == inside
    assert count["scored"] < 0.7 * count["pairs"]


def test_scores_beyond_doubles():
    anchors, rows = np.array([[2**31, 1]]), np.array([[2**31, 0], [2**31, 1], [-(2**31), 5]])
    ids = np.arange(3)
    best = negatives.tree_search(anchors, [[(-np.inf, np.inf)]], rows, ids, ids, lambda a, part: np.zeros(3, bool)[part], 2)
    assert best[0].held[0][0].tolist() == [2**62 + 1, 2**62] and best[0].held[0][1].tolist() == [1, 0]


def test_spanning_tree_is_minimal():
    points = np.random.RandomState(6).randint(-50, 50, (30, 3))
    order, parent, edge = negatives.spanning_tree(points)
    assert sorted(order) == list(range(30)) and all(list(order).index(parent[k]) < list(order).index(k) for k in order[1:])
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    inside, total = {0}, 0.0
    while len(inside) < 30:
        d, k = min((gaps[i, j], j) for i in inside for j in range(30) if j not in inside)
        inside.add(k)
        total += d
    assert abs(edge.sum() - total) < 1e-6
