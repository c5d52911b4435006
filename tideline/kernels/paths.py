"""Path simulation of asset returns: normal, constant-correlation and dynamic-correlation with clustered jumps."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Model:
    """Per-asset daily mean, variance recursion, standardised residuals, correlations and jump intensities.

    ``start`` is the state of the dynamic correlations after the last row; without it, ``corr``. ``residuals`` is an
    array (dates x assets) where paths are simulated; a model that is sent to tasks may name a table instead.
    """

    mean: np.ndarray
    omega: np.ndarray
    alpha: np.ndarray
    beta: np.ndarray
    variance: np.ndarray
    corr: np.ndarray
    dcc: tuple[float, float] = (0.03, 0.93)
    residuals: object = None
    jumps: dict = field(default_factory=dict)
    start: np.ndarray | None = None


def psd(m: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """The matrix with eigenvalues clipped from below, scaled back to its diagonal."""
    value, vector = np.linalg.eigh((m + m.T) / 2)
    out = vector @ np.diag(np.maximum(value, floor)) @ vector.T
    scale = np.sqrt(np.diag(m) / np.diag(out))
    return out * np.outer(scale, scale)


def root(m: np.ndarray) -> np.ndarray:
    """Cholesky factor, with growing jitter where the matrix isn't positive."""
    jitter = 0.0
    for k in range(8):
        try:
            return np.linalg.cholesky(m + jitter * np.eye(m.shape[-1]))
        except np.linalg.LinAlgError:
            jitter = 10.0 ** (k - 10)
    return np.linalg.cholesky(psd(m) + 1e-6 * np.eye(m.shape[-1]))


def simulate(model: Model, paths: int, steps: int, kind: str, rng: np.random.Generator) -> np.ndarray:
    """Returns of shape (paths, steps, assets). Models: 'gbm', 'garch', 'hawkes'; the first if a run isn't finite."""
    out = {"gbm": _normal, "garch": _garch, "hawkes": _hawkes}[kind](model, paths, steps, rng)
    return out if np.isfinite(out).all() else _normal(model, paths, steps, rng)


def _normal(model: Model, paths: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    sd = np.sqrt(model.variance)
    z = rng.standard_normal((paths, steps, len(sd))) @ root(model.corr).T
    return model.mean + sd * z


def _garch(model: Model, paths: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    chol, var = root(model.corr), np.tile(model.variance, (paths, 1))
    out = np.empty((paths, steps, len(model.mean)))
    for t in range(steps):
        shock = np.sqrt(var) * (rng.standard_normal(var.shape) @ chol.T)
        out[:, t] = model.mean + shock
        var = model.omega + model.alpha * shock**2 + model.beta * var
    return out


def _hawkes(model: Model, paths: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    """Variance recursions on the diffusion, correlations that follow standardised returns, self-exciting jumps."""
    n, (a, b), j = len(model.mean), model.dcc, model.jumps
    var, q = np.tile(model.variance, (paths, 1)), np.tile(model.corr if model.start is None else model.start, (paths, 1, 1))
    lam0, jump, decay = j.get("base", np.zeros(n)), j.get("excite", np.zeros(n)), j.get("decay", 0.5)
    lam, mu, sd = np.tile(lam0, (paths, 1)), j.get("mean", np.zeros(n)), j.get("sd", np.zeros(n))
    boot = model.residuals is not None and len(model.residuals) >= 50
    white = np.linalg.solve(root(np.corrcoef(model.residuals.T).reshape(n, n)), model.residuals.T).T if boot else None
    out = np.empty((paths, steps, n))
    for t in range(steps):
        d = np.sqrt(np.einsum("pii->pi", q))
        chol = np.linalg.cholesky(q / (d[:, :, None] * d[:, None, :]) + 1e-10 * np.eye(n))
        z = white[rng.integers(0, len(white), paths)] if boot else rng.standard_normal((paths, n))
        shock = np.sqrt(var) * np.einsum("pij,pj->pi", chol, z)
        hit = rng.random((paths, n)) < -np.expm1(-np.minimum(lam, 5.0))
        r = shock + hit * (mu + sd * rng.standard_normal((paths, n)))
        out[:, t] = model.mean + r
        e = r / np.sqrt(var)
        var = model.omega + model.alpha * shock**2 + model.beta * var
        q = (1 - a - b) * model.corr + a * e[:, :, None] * e[:, None, :] + b * q
        lam = lam0 + (lam - lam0) * np.exp(-decay) + jump * (np.abs(e) > 2)
    return out
