"""A small linear support vector machine: dual coordinate descent over sparse rows."""

from __future__ import annotations

import numpy as np


def fit_linear_svm(rows, y, dim: int, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of an L1-loss linear SVM.

    rows: list of (indices, values); y: +1 / -1.  Classes are balanced through the cost.
    """
    y = np.asarray(y, np.float64)
    pos = max(1, int((y > 0).sum()))
    neg = max(1, int((y < 0).sum()))
    upper = np.where(y > 0, cost * len(y) / (2 * pos), cost * len(y) / (2 * neg))
    w, alpha = np.zeros(dim), np.zeros(len(y))
    q = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            if q[i] <= 0:
                continue
            idx, val = rows[i]
            g = y[i] * float(w[idx] @ val) - 1
            a = min(max(alpha[i] - g / q[i], 0.0), upper[i])
            if a != alpha[i]:
                w[idx] += (a - alpha[i]) * y[i] * val
                moved = max(moved, abs(a - alpha[i]) / upper[i])
                alpha[i] = a
        if moved < 1e-3:
            break
    return w


def fit_dense_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a squared-hinge SVM over few dense columns, by Newton steps on the violating rows.

    ``weight``: how often each row occurs.  Classes are balanced through the cost; the last column
    is the bias and isn't regularised.
    """
    c = weight * np.where(y > 0, 1 / max(weight[y > 0].sum(), 1e-9), 1 / max(weight[y < 0].sum(), 1e-9)) * cost * len(y) / 2
    reg = np.ones(x.shape[1])
    reg[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda v: 0.5 * float(reg @ v**2) + float(c @ np.maximum(0, 1 - y * (x @ v)) ** 2)
    now = loss(w)
    for _ in range(steps):
        on = y * (x @ w) < 1
        xs, cs = x[on], c[on]
        full = np.linalg.solve(np.diag(reg) + 2 * (xs.T * cs) @ xs, 2 * xs.T @ (cs * y[on]))
        step, nxt = 1.0, loss(full)
        while nxt > now and step > 1e-4:
            step /= 2
            nxt = loss(w + step * (full - w))
        if now - nxt < 1e-7 * max(1.0, now):
            break
        w, now = w + step * (full - w), nxt
    return w
