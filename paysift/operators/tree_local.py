"""The level-wise tree grower for one group inside a task (numpy), used through
``groupBy(...).applyInPandas`` for groups of bounded size.

It follows exactly the rules of the distributed grower in ``trees.py``: the bins and
thresholds come from the same cut table (computed once in Spark for all groups), and the
variance gain, quantised ranking and tie order, hash-drawn bootstrap weights and feature
subsets are the same, so a group gets the same model on either path. It grows cells: rows in the
same bins, added up.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

RANK_OFFSET = 0.4618033988749895
# Largest (nodes x bins) histogram built at once per feature (bounds a task's memory at deep
# levels of a large group: 4 statistics x 8 bytes x 1M cells, plus their running sums).
CELL_BUDGET = 1_000_000
# Poisson(1) inverse CDF table for bootstrap weights: P(K <= j) = e^-1 * sum_{i<=j} 1/i!
POISSON_CDF = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(j + 1)) for j in range(12)]


def unit_hash(parts: list[str]) -> float:
    """Same value as ``functions.scalar.unit_hash`` for the same text parts."""
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16) / 4294967296.0


def poisson_weights(rids: list[str], tree: int, seed: int) -> np.ndarray:
    u = np.array([unit_hash([r, str(tree), f"boot{seed}"]) for r in rids])
    return np.searchsorted(np.array(POISSON_CDF), u, side="right").astype(np.float64)


def _imp(w, s, ss):
    return (ss - s * s / w) / w


def grow(B: np.ndarray, thr: list[np.ndarray], y: np.ndarray, w: np.ndarray, max_depth: int, m_features: int,
         key_parts: list[str], seed: int, min_instances: int = 1, categorical: tuple[int, ...] = (),
         vals: list[np.ndarray] | None = None):
    """``grow_cells`` of single rows with labels ``y`` and weights ``w`` > 0."""
    return grow_cells(B, thr, np.ones(len(y)), w, w * y, w * y * y, max_depth, m_features, key_parts, seed, min_instances,
                      categorical, vals)


def grow_cells(B: np.ndarray, thr: list[np.ndarray], c: np.ndarray, w: np.ndarray, wy: np.ndarray, wyy: np.ndarray,
               max_depth: int, m_features: int, key_parts: list[str], seed: int, min_instances: int = 1,
               categorical: tuple[int, ...] = (), vals: list[np.ndarray] | None = None):
    """Grow one tree of cells. ``B``: cells x features bin indices; ``c`` rows, ``w`` weight (> 0),
    ``wy`` and ``wyy`` weighted sums of the label and its square, per cell.
    Returns (internal [(node, f, thr, left categories or None)], leaves [(node, pred, n)],
    node of every cell). For a categorical feature (bins = categories, values in ``vals``) the
    categories of a node are ordered by mean label, ties by value, and splits are prefixes.

    Vectorised per level: for each feature one ``bincount`` over (node, bin) cells gives the
    per-node histograms, cumulative sums along the bins give every candidate split, and the
    best candidate per node is an argmax over a nodes x bins matrix (first maximum: lowest
    bin), compared across features in order (strictly greater wins: lowest feature)."""
    n, k = B.shape
    node = np.ones(n, dtype=np.int64)
    active = np.ones(n, dtype=bool)
    internal = []
    for _ in range(max_depth):
        rows = np.nonzero(active)[0]
        if len(rows) == 0:
            break
        ids, inv = np.unique(node[rows], return_inverse=True)
        m = len(ids)
        best_key = np.full(m, -np.inf)
        best_f = np.full(m, -1, dtype=np.int64)
        best_bin = np.zeros(m, dtype=np.int64)
        best_gain = np.zeros(m)
        best_order = {}  # (feature, node index) -> category order, for categorical candidates
        allowed = np.ones((m, k), dtype=bool)
        if m_features < k:
            for i, nd in enumerate(ids):
                u = [unit_hash(key_parts + [str(int(nd)), f"{seed}:{j}"]) for j in range(k)]
                allowed[i] = [sum(uj < u[f] for uj in u) < m_features for f in range(k)]
        for f in range(k):
            nb = len(thr[f])
            # nodes are processed in chunks so a histogram never exceeds CELL_BUDGET cells
            per = max(1, CELL_BUDGET // max(nb, 1))
            for lo in range(0, m, per):
                hi = min(m, lo + per)
                sel = (inv >= lo) & (inv < hi) if (lo > 0 or hi < m) else slice(None)
                r_sel, i_sel = rows[sel], inv[sel] - lo
                mc = hi - lo
                cell = i_sel * nb + B[r_sel, f]
                hist = [np.bincount(cell, weights=v, minlength=mc * nb).reshape(mc, nb)
                        for v in (c[r_sel], w[r_sel], wy[r_sel], wyy[r_sel])]
                order = None
                if f in categorical:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        centroid = np.where(hist[1] > 0, hist[2] / hist[1], np.inf)
                    order = np.argsort(centroid, axis=1, kind="stable")
                    hist = [np.take_along_axis(h, order, axis=1) for h in hist]
                cl, wl, sl, ssl = (np.cumsum(h, axis=1) for h in hist)
                ct, wt, st, sst = (c[:, -1:] for c in (cl, wl, sl, ssl))
                cr, wr, sr, ssr = ct - cl, wt - wl, st - sl, sst - ssl
                with np.errstate(divide="ignore", invalid="ignore"):
                    imp_t = _imp(wt, st, sst)
                    gain = imp_t - wl / wt * _imp(wl, sl, ssl) - wr / wt * _imp(wr, sr, ssr)
                    gkey = np.floor(gain / imp_t * 1e9 + RANK_OFFSET)
                valid = ((cl >= min_instances) & (cr >= min_instances) & (wl > 0) & (wr > 0)
                         & (imp_t > 0) & allowed[lo:hi, f:f + 1])
                gkey = np.where(valid, gkey, -np.inf)
                top = np.argmax(gkey, axis=1)
                top_key = gkey[np.arange(mc), top]
                better = top_key > best_key[lo:hi]
                best_key[lo:hi] = np.where(better, top_key, best_key[lo:hi])
                best_f[lo:hi] = np.where(better, f, best_f[lo:hi])
                best_bin[lo:hi] = np.where(better, top, best_bin[lo:hi])
                best_gain[lo:hi] = np.where(better, gain[np.arange(mc), top], best_gain[lo:hi])
                if order is not None:
                    for i in np.nonzero(better)[0]:
                        best_order[(f, lo + i)] = order[i]
        split = (best_f >= 0) & (best_key >= 1)  # zero gain (up to rounding) never splits
        if not split.any():
            break
        left_sets = {}
        for i in np.nonzero(split)[0]:
            f = int(best_f[i])
            if f in categorical:
                left = np.sort(best_order[(f, i)][: best_bin[i] + 1])
                left_sets[i] = left
                internal.append((int(ids[i]), f, None, [float(v) for v in vals[f][left]]))
            else:
                internal.append((int(ids[i]), f, float(thr[f][best_bin[i]]), None))
        row_split = split[inv]
        moving = rows[row_split]
        fr = best_f[inv][row_split]
        go_right = B[moving, fr] > best_bin[inv][row_split]
        if left_sets:
            node_of = inv[row_split]
            for i, left in left_sets.items():
                sel = node_of == i
                go_right[sel] = ~np.isin(B[moving[sel], best_f[i]], left)
        node[moving] = node[moving] * 2 + go_right.astype(np.int64)
        active[rows[~row_split]] = False
    leaves = []
    ids, inv = np.unique(node, return_inverse=True)
    sw = np.bincount(inv, weights=w)
    swy = np.bincount(inv, weights=wy)
    for i, nd in enumerate(ids):
        leaves.append((int(nd), float(swy[i] / sw[i]), float(sw[i])))
    return internal, leaves, node
