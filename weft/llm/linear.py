"""Small linear support vector machines, trained on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of an L2-loss linear SVM by dual coordinate descent (Hsieh et al. 2008); y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    rng = np.random.default_rng(seed)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    # Classes weigh the same however many rows they have.
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    cost = c * len(y) / (2 * np.maximum(share, 1))
    diagonal = 0.5 / cost
    q = (x * x).sum(axis=1) + diagonal
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w
