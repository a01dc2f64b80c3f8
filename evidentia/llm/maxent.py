"""Maximum-entropy classifier (multinomial logistic regression), trained in memory on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights ``(features + 1, classes)`` by gradient descent with momentum; the last row is the
    bias. The features should be of similar scale. Without rows all weights are 0."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w = np.zeros((x.shape[1], classes))
    if not len(x):
        return w
    share = (np.ones(len(x)) if weight is None else weight)[:, None]
    share = share / share.sum()
    target = np.eye(classes)[y]
    step = 4.0 / max(1.0, (x**2 * share).sum())
    ahead, before = w.copy(), w
    for k in range(rounds):
        p = probabilities(x[:, :-1], ahead)
        w = ahead - step * 2 * (x.T @ ((p - target) * share) + ridge * ahead)
        ahead = w + k / (k + 3) * (w - before)
        before = w
    return w


def probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w[:-1] + w[-1]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)
