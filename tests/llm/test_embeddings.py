"""Whitening and hard negatives against plain numpy and plain Python."""

import random

import numpy as np
import pytest

from lintlake.llm import hard_negatives, whitening


def _matrices():
    rng = np.random.default_rng(7)
    turned = lambda values: (lambda q: q @ np.diag(values) @ q.T)(
        np.linalg.qr(rng.normal(size=(len(values), len(values))))[0])
    yield np.zeros((0, 0))
    yield np.array([[3.0]])
    yield np.zeros((5, 5))
    yield 4.0 * np.eye(6)
    yield turned([5.0, 5, 5, 2, 2, 1, 0, 0])
    yield turned([1.0, 1 - 1e-9, 1 - 2e-9, 1e-8, 0, -3])
    yield turned([1e12, 1.0, 1e-6])
    yield turned([0.0] * 9 + [7.0])
    yield turned(list(range(20)))
    for d in (2, 3, 17, 64):
        x = rng.normal(size=(200, d)) @ rng.normal(size=(d, d))
        yield np.cov(x.T, bias=True).reshape(d, d)


@pytest.mark.parametrize("a", list(_matrices()), ids=lambda a: f"{len(a)}")
def test_components_equal_a_library_decomposition(a):
    a = (a + a.T) / 2
    values, vectors = whitening.components(a)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max(initial=0) <= 1e-13 * scale * max(len(a), 1)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max(initial=0) < 1e-12
    assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-13 * scale * max(len(a), 1)


def test_polar_factor_is_the_sign():
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(9, 9)))[0]
    values = np.array([9, 4, 1e-3, 1e-9, -1e-9, -1e-2, -1, -5, -80.0])
    found = whitening.polar(q @ np.diag(values) @ q.T)
    assert np.abs(found - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-5
    assert np.abs(found @ found.T - np.eye(9)).max() < 1e-13


def _whitened(rows, k=4):
    kept = [(i, x) for i, x in rows if x is not None]
    lengths = [len(x) for _, x in kept]
    d = max(lengths, key=lambda n: (lengths.count(n), n))
    kept = [(i, x) for i, x in kept if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.int64)
    n, sums = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(d, d))
    order = np.argsort(-values)[:k]
    values, vectors, trace = values[order], vectors[:, order], values.sum()
    out = []
    for i, x in kept:
        x = np.array(x)
        w = (x - sums / n) @ vectors / np.sqrt(np.abs(values))
        for c in range(len(order)):
            out.append((i, c + 1, n, int(sum(int(v) ** 2 for v in n * x - sums)), w[c], values[c] / trace))
    return out, values


def test_whitening_equals_plain_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [int(v) for v in np.floor(rng.normal(size=6) * [90, 70, 50, 30, 20, 10] + 1000)])
            for k in range(500)]
    rows += [(None, rows[3][1]), rows[5], (900, rows[5][1]), (901, None), (902, [1, 2])]
    frame = spark.createDataFrame([(i, x, "a", 1) for i, x in rows],
                                  "id long, x array<long>, component string, n int").repartition(5)
    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[4])
    found = sorted(map(tuple, whitening.whiten(frame).collect()), key=key)
    want = sorted(_whitened(rows)[0], key=key)
    assert len(found) == len(want) == 4 * 503
    signs = {c: np.sign(sum(f[4] * w[4] for f, w in zip(found, want) if f[1] == c)) for c in range(1, 5)}
    by_key = {}
    for w in want:
        by_key.setdefault((w[0], w[1]), w)
    for f in found:
        w = by_key[f[0], f[1]]
        assert f[:4] == w[:4]
        assert abs(f[4] * signs[f[1]] - w[4]) < 1e-9 and abs(f[5] / w[5] - 1) < 1e-9
        assert 0 <= f[6] < 1e-9


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, x array<long>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None)])).count() == 0
    assert whitening.whiten(make([(1, [])])).count() == 0
    # One distinct vector, and vectors along one line.
    alone = whitening.whiten(make([(1, [2, 3]), (2, [2, 3])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in alone] == [
        (1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)] * 2
    line = whitening.whiten(make([(k, [k, 2 * k, 0]) for k in range(4)])).collect()
    assert {r["component"] for r in line} == {1, 2, 3}
    for r in line:
        if r["component"] == 1:
            assert abs(abs(r["whitened"]) - abs(r["id"] - 1.5) / np.sqrt(1.25)) < 1e-12
            assert abs(r["explained"] - 1) < 1e-12
        else:
            assert r["whitened"] is None and r["explained"] == 0.0
    # Far from zero and large: sums stay exact, the deviation saturates.
    far = whitening.whiten(make([(k, [10**12 + k, -(10**12) + (k * k) % 7]) for k in range(50)])).collect()
    sums = [sum(10**12 + k for k in range(50)), sum(-(10**12) + (k * k) % 7 for k in range(50))]
    for r in far:
        x = [10**12 + r["id"], -(10**12) + (r["id"] ** 2) % 7]
        assert r["deviation"] == sum((50 * v - s) ** 2 for v, s in zip(x, sums)) and r["identity_error"] < 1e-9
    wide = whitening.whiten(make([(1, [2**60]), (2, [-(2**60)])])).collect()
    assert {r["deviation"] for r in wide} == {2**63 - 1}


def _mined(rows, anchors, k=5, m=5):
    best = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None:
            best[i] = min(best.get(i, (label, x)), (label, x))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a in (i for i in best if anchors(i)):
        label, x = best[a]
        others = [(i, *v) for i, v in best.items() if i != a and len(v[1]) == len(x)]
        own = sorted((-dot(x, y), i) for i, y_label, y in others if y_label == label)[:k]
        rest = sorted((-dot(x, y), i) for i, y_label, y in others if y_label != label)
        for score, positive in own:
            found = [(s, i) for s, i in rest if -80 * score <= -100 * s <= -100 * score][:m]
            out += [(a, positive, r + 1, i, -score, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1, 40])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", 100)
    rng = random.Random(spread)
    centres = [[rng.randint(-9, 9) for _ in range(4)] for _ in range(6)]
    rows = []
    for k in range(700):
        centre = rng.choice(centres)
        rows.append((k, rng.randint(0, 3), [c * 5 + rng.randint(-spread, spread) for c in centre]))
    rows += [(k, k % 3, [1, 1, 1, 1]) for k in range(700, 760)]  # ties
    rows += [(None, 1, [1, 1, 1, 1]), (800, None, [1, 1, 1, 1]), (801, 1, None), (810, 1, [3, 4]),
             (820, 2, [3, 4]), (830, 1, [2, 2]), rows[7], (rows[7][0], rows[7][1], [-1, 0, 0, 0]), (840, 9, [7, 7, 7, 7])]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "id long, label int, v array<long>, g string, len int")
    found = hard_negatives.hard_negatives(frame, hard_negatives.F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, found)) == _mined(rows, lambda i: i % 10 == 0)


def test_tree_bounds_spare_products(spark):
    """With clustered anchors most candidates of a child are never scored."""
    rng = np.random.default_rng(0)
    import pyarrow as pa

    centres = rng.integers(-300, 300, (8, 16))
    points = np.repeat(centres, 20, 0) + rng.integers(-1, 2, (160, 16))
    group = pa.table({
        "id": np.arange(160), "label": np.arange(160) % 8, "v": pa.array(points.tolist(), pa.list_(pa.int64())),
        "len": pa.array([16] * 160, pa.int32()), "g": pa.array([0] * 160, pa.int32()),
    })
    tree = hard_negatives._tree(group)
    assert sorted(tree.column("place").to_pylist()) == list(range(160))
    assert all(p < k for p, k in zip(tree.column("parent").to_pylist(), tree.column("place").to_pylist()))
    candidates = pa.table({
        "id": np.arange(1000, 3000), "label": rng.integers(0, 8, 2000),
        "v": pa.array((centres[rng.integers(0, 8, 2000)] + rng.integers(-9, 9, (2000, 16))).tolist(),
                      pa.list_(pa.int64())),
    })
    block = hard_negatives._Block(tree, candidates)
    top = {}
    for k, at, scores in block.walk(lambda k, low, high: high >= hard_negatives._least_of_best(low, 5)):
        top[k] = sorted((-scores).tolist())[:5]
    for k, points_of in enumerate(block.points):
        assert top[k] == sorted((-(block.vectors @ points_of)).astype(int).tolist())[:5]
    assert block.scored < 0.5 * 160 * 2000


def test_hard_negatives_of_nothing(spark):
    frame = spark.createDataFrame([], "id long, label int, v array<long>")
    assert hard_negatives.hard_negatives(frame, hard_negatives.F.lit(True)).count() == 0
    alone = spark.createDataFrame([(0, 1, [1, 2]), (1, 2, [1, 2])], "id long, label int, v array<long>")
    assert hard_negatives.hard_negatives(alone, hard_negatives.F.lit(True)).count() == 0
