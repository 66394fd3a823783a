"""The in-task grower: chunking the per-level histograms does not change the tree."""

import numpy as np

from paysift.operators import tree_local


def test_chunked_histograms_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(1)
    n, k = 3000, 3
    B = rng.integers(0, 50, size=(n, k))
    thr = [np.arange(50) + 0.5 for _ in range(k)]
    y = rng.normal(size=n) + B[:, 0] * 0.1
    w = rng.integers(1, 3, size=n).astype(float)
    a = tree_local.grow(B, thr, y, w, 10, 2, ["g", "0"], 1)
    monkeypatch.setattr(tree_local, "CELL_BUDGET", 120)
    b = tree_local.grow(B, thr, y, w, 10, 2, ["g", "0"], 1)
    assert a[0] == b[0]
    assert np.allclose([p for _, p, _ in a[1]], [p for _, p, _ in b[1]])
    assert (a[2] == b[2]).all()


def test_poisson_weights_match_the_table():
    w = tree_local.poisson_weights([f"r{i}" for i in range(20000)], 3, 5043)
    assert abs(w.mean() - 1.0) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.02
