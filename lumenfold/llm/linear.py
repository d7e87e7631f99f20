"""Two small dense learners for bounded samples: logistic calibration and a squared-hinge SVM."""

from __future__ import annotations

import numpy as np


class Calibration:
    """Logistic regression by Newton's method over standardised columns; scores lie strictly inside 0 to 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = self._wide(x)
        self.weights = np.zeros(z.shape[1])
        for _ in range(steps):
            p = self._p(z)
            hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            move = np.linalg.solve(hessian, z.T @ (y - p) - ridge * self.weights)
            self.weights += move / max(1.0, np.abs(move).max())
            if np.abs(move).max() < 1e-8:
                break

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.spread, -30, 30)]

    def _p(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._p(self._wide(x))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of the primal squared-hinge machine; y is 1 or -1, weight scales each row's loss."""
    z = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.ones(x.shape[1]), 1e-6]
    for _ in range(steps):
        inside = y * (z @ w) < 1
        za, ca = z[inside], cost * weight[inside]
        new = np.linalg.solve((za * ca[:, None]).T @ za + np.diag(ridge), za.T @ (ca * y[inside]))
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])
