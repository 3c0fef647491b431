"""Follow-the-regularised-leader (FTRL-proximal) for sparse rows, with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of ``classes`` linear functions over ``size`` features; per-coordinate rates.

    A weight is zero until the sum of its gradients passes l1, which keeps models sparse.
    """

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z = np.zeros((size, classes))
        self.n = np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, w: np.ndarray, gradient: np.ndarray) -> None:
        """at: distinct features of a row; w: their weights now; gradient: one row a feature."""
        squared = gradient * gradient
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + squared) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + squared


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The factor by which scores are multiplied for the least log loss: a golden-section search over its logarithm."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(scores * np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, ratio = -4.0, 6.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
