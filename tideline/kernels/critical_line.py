"""Critical lines: all corner portfolios of a bounded mean-variance problem, and what lies between them."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np


@dataclass
class Corners:
    """Corner portfolios from the largest return to the least variance; between two, weights are linear in ``trade``."""

    trade: np.ndarray  # weight of the return against half the variance, falling to 0
    weights: np.ndarray


def _start(mu: np.ndarray, low: float, high: float) -> tuple[np.ndarray, int]:
    """The portfolio of the largest return, and the asset that takes what is left between its bounds."""
    w, left, order = np.full(len(mu), low), 1 - low * len(mu), np.argsort(-mu, kind="stable")
    for k in order:
        step = min(high - low, left)
        w[k], left = low + step, left - step
        if left <= 1e-15:
            return w, int(k)
    return w, int(order[-1])


def corners(mu: np.ndarray, cov: np.ndarray, low: float = 0.0, high: float = 1.0) -> Corners | None:
    """Follows max trade * mu'w - w'cov w / 2 with sum 1 and bounds, from trade = infinity down to 0.

    With the free assets fixed, weights and multipliers are linear in ``trade``; the next corner is where a
    free asset meets a bound or a bound one's multiplier changes sign. Equal returns are told apart by a
    perturbation of 1e-12 of their range. None where the bounds can't sum to 1.
    """
    n = len(mu)
    if n * high < 1 - 1e-12 or n * low > 1 + 1e-12 or not n:
        return None
    spread = float(np.ptp(mu)) or 1.0
    mu = mu - 1e-12 * spread * np.arange(n)
    w, k = _start(mu, low, high)
    free = np.zeros(n, bool)
    free[k] = True
    trade, out_t, out_w = np.inf, [], []
    for _ in range(50 * n + 100):
        f, b = np.flatnonzero(free), np.flatnonzero(~free)
        # bordered system: cov_ff w_f - g 1 = trade mu_f - cov_fb w_b, 1'w_f = 1 - 1'w_b
        system = np.block([[cov[np.ix_(f, f)], -np.ones((len(f), 1))], [np.ones((1, len(f))), np.zeros((1, 1))]])
        right = np.stack([np.append(-cov[np.ix_(f, b)] @ w[b], 1 - w[b].sum()), np.append(mu[f], 0.0)], 1)
        (at, slope) = np.linalg.solve(system, right).T
        # gains of the assets: trade mu_i - (cov w)_i + g, zero on the free ones
        w0, w1 = np.where(free, 0.0, w), np.zeros(n)
        w0[f], w1[f] = at[:-1], slope[:-1]
        gain0, gain1 = at[-1] - cov @ w0, mu + slope[-1] - cov @ w1
        best, change = 0.0, None
        for i in f if len(f) > 1 else ():
            if abs(slope_i := w1[i]) > 1e-15:
                t = ((low if slope_i > 0 else high) - w0[i]) / slope_i
                if best < t <= trade * (1 + 1e-12):
                    best, change = t, (i, low if slope_i > 0 else high)
        for i in b:
            if gain1[i] * (1 if w[i] <= low else -1) < -1e-15:
                t = -gain0[i] / gain1[i]
                if best < t <= trade * (1 + 1e-12):
                    best, change = t, (i, None)
        if change is None:
            best = 0.0
        if not np.isfinite(trade):
            out_t.append(best if change else 0.0)
            out_w.append(w0 + w1 * (best if change else 0.0) if len(f) > 1 else w.copy())
        else:
            out_t.append(best)
            out_w.append(w0 + w1 * best)
        w = out_w[-1].copy()
        if change is None:
            break
        i, bound = change
        free[i] = bound is None
        if bound is not None:
            w[i] = bound
        trade = best
    return Corners(np.array(out_t), np.clip(np.array(out_w), low, high))


def at_return(c: Corners, mu: np.ndarray, target: float) -> np.ndarray | None:
    """The weights of least variance on the efficient half with the return ``target``; None where no corner reaches it."""
    ret = c.weights @ mu
    if target > ret[0] + 1e-12 * max(1.0, abs(ret[0])) or target < ret[-1] - 1e-12:
        return None
    k = int(np.searchsorted(-ret, 1e-12 - target, "right"))  # of corners with the same return the last has the least variance
    if k == 0 or k == len(ret):
        return c.weights[max(k - 1, 0)]
    s = max((ret[k - 1] - target) / (ret[k - 1] - ret[k]), 0.0)
    return c.weights[k - 1] + s * (c.weights[k] - c.weights[k - 1])


def least_variances(mu: np.ndarray, cov: np.ndarray, targets: np.ndarray) -> list[np.ndarray | None]:
    """Per target return the weights (at least 0) of least variance, on either half; None where no portfolio has it."""
    upper, lower = corners(mu, cov), corners(-mu, cov)  # from the largest and from the least return to the least variance
    out = [at_return(upper, mu, t) for t in targets]
    return [at_return(lower, -mu, -t) if w is None else w for w, t in zip(out, targets)]


def tangency(c: Corners, mu: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray:
    """The weights of the largest excess return over volatility: on each line between corners the best point in closed form.

    Where no portfolio earns more than ``rf`` they are the best of the efficient half; ``best_extreme`` has the best of all.
    """
    best, ratio = None, -np.inf
    lines = list(zip(c.weights[:-1], c.weights[1:])) or [(c.weights[0], c.weights[0])]
    for u, v in lines:
        d = v - u
        a, b, cc, dd, e = float(mu @ u) - rf, float(mu @ d), float(u @ cov @ u), float(u @ cov @ d), float(d @ cov @ d)
        bend = b * dd - a * e
        inner = (a * dd - b * cc) / bend if abs(bend) > 1e-300 else 0.0
        for s in (0.0, 1.0, min(max(inner, 0.0), 1.0)):
            x = u + s * d
            risk = float(x @ cov @ x)
            r = (float(mu @ x) - rf) / np.sqrt(risk) if risk > 1e-18 else -np.inf
            if r > ratio:
                best, ratio = x, r
    return c.weights[-1] if best is None else best


def best_extreme(excess: np.ndarray, cov: np.ndarray, low: float, high: float) -> np.ndarray:
    """The weights of the largest excess return over volatility where no portfolio has a positive one.

    Volatility over loss is quasi-convex, so it is greatest at an extreme portfolio: as many assets at ``high`` as fit,
    one with what is left, the others at ``low``. All of them are compared, n times (n - 1 over k), k = (1 - n low) /
    (high - low) rounded down: at most 256 thousand with the bounds 0.005 and 0.30.
    """
    n, step = len(excess), high - low
    room = 1 - n * low
    k = min(int(room / step + 1e-9), n) if step > 0 else 0
    if step <= 0 or k == n:
        return np.full(n, 1 / n)
    left, rows = max(room - k * step, 0.0), cov.sum(1)
    best, ratio, sets = None, -np.inf, combinations(range(n), k)
    while chunk := list(islice(sets, max(200_000 // n, 1))):
        at = np.array(chunk, int).reshape(len(chunk), k)
        gain = low * excess.sum() + step * excess[at].sum(1)
        cw = low * rows + step * cov[at].sum(1)
        risk = low * cw.sum(1) + step * np.take_along_axis(cw, at, 1).sum(1)
        r = (gain[:, None] + left * excess) / np.sqrt(np.maximum(risk[:, None] + 2 * left * cw + left * left * np.diag(cov), 1e-300))
        np.put_along_axis(r, at, -np.inf, 1)
        i, j = np.unravel_index(int(r.argmax()), r.shape)
        if best is None or r[i, j] > ratio:
            best, ratio = np.full(n, low), r[i, j]
            best[at[i]], best[j] = high, low + left
    return best


def multipliers(w: np.ndarray, gradient: np.ndarray, low: float, high: float) -> np.ndarray:
    """Gradients less those of the free assets' mean (of a largest value: 0 free, at most 0 at the lower bound, at least 0 at the upper)."""
    free = (w > low + 1e-9) & (w < high - 1e-9)
    if free.any():
        level = gradient[free].mean()
    else:
        lows, highs = gradient[w <= low + 1e-9], gradient[w >= high - 1e-9]
        level = lows.max() if len(lows) else highs.min()
    return gradient - level
