"""Fits of tail, variance, correlation and jump models in NumPy; pure functions of one series or panel."""

from __future__ import annotations

import math

import numpy as np


def minimise(f, start: np.ndarray, step: float = 0.2, rounds: int = 400, tol: float = 1e-9) -> np.ndarray:
    """Downhill simplex search."""
    n = len(start)
    points = [start.astype(float)] + [start + step * np.where(np.arange(n) == k, np.maximum(np.abs(start), 0.1), 0) for k in range(n)]
    pts = sorted(((f(p), p) for p in points), key=lambda x: x[0])
    for _ in range(rounds):
        if abs(pts[-1][0] - pts[0][0]) < tol:
            break
        center = np.mean([p for _, p in pts[:-1]], axis=0)
        mirrored = center + (center - pts[-1][1])
        value = f(mirrored)
        if value < pts[0][0]:
            far = center + 2 * (center - pts[-1][1])
            v = f(far)
            pts[-1] = (v, far) if v < value else (value, mirrored)
        elif value < pts[-2][0]:
            pts[-1] = (value, mirrored)
        else:
            near = center + 0.5 * ((mirrored if value < pts[-1][0] else pts[-1][1]) - center)
            v = f(near)
            if v < min(value, pts[-1][0]):
                pts[-1] = (v, near)
            else:
                best = pts[0][1]
                pts = [pts[0]] + [(f(q), q) for q in (best + 0.5 * (p - best) for _, p in pts[1:])]
        pts.sort(key=lambda x: x[0])
    return pts[0][1]


def gpd(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto tail by the profile likelihood in theta = -shape/scale."""
    x = np.asarray(excess, float)
    n, top, mean = len(x), x.max(), x.mean()

    def shape(theta: float) -> float:
        return float(np.mean(np.log1p(-theta * x)))

    def loss(theta: float) -> float:
        k = shape(theta)
        s = -k / theta if theta else mean
        return math.inf if s <= 0 or k <= -1 else n * math.log(s) + n * (k + 1)

    grid = np.concatenate([-np.geomspace(1e-4, 20, 160) / mean, np.linspace(1e-4, 0.999, 80) / top])
    best = min(grid.tolist(), key=loss)
    width = abs(best) * 0.1
    for _ in range(60):
        best = min((best - width, best, best + width), key=lambda t: loss(t) if t < 1 / top and t != 0 else math.inf)
        width *= 0.7
    k = shape(best)
    return k, -k / best


def evt_var(r: np.ndarray, level: float = 0.99, tail: float = 0.10) -> float:
    """Value at risk by peaks over threshold: the losses over their (1-tail) quantile.

    Fewer than 60 rows: nan; fewer than 20 excesses: the historical value.
    """
    loss = -np.asarray(r, float)
    if len(loss) < 60:
        return math.nan
    u = np.percentile(loss, 100 * (1 - tail))
    excess = loss[loss > u] - u
    if len(excess) < 20:
        return float(np.percentile(loss, 100 * level))
    k, s = gpd(excess)
    p = (1 - level) / tail
    return float(u - s * math.log(p) if abs(k) < 1e-6 else u + s / k * (p**-k - 1))


def _recursion(e2: np.ndarray, omega: float, alpha: float, beta: float, start: float) -> np.ndarray:
    out, v = np.empty(len(e2) + 1), start
    for t, x in enumerate(e2.tolist()):
        out[t] = v
        v = omega + alpha * x + beta * v
    out[-1] = v
    return out


def garch(r: np.ndarray, mean: bool = True) -> dict:
    """GARCH(1,1) by maximum likelihood; params, residuals over volatility, next variance.

    Falls back to 0.05 var, 0.10, 0.85 when the search fails or rows are fewer than 60.
    """
    r = np.asarray(r, float)
    mu = float(r.mean()) if mean and len(r) else 0.0
    e2 = (r - mu) ** 2
    var = float(e2.mean()) if len(r) else 0.0
    omega, alpha, beta, ok = 0.05 * var, 0.10, 0.85, False
    if len(r) >= 60 and var > 1e-16:
        squash = lambda z: (math.exp(z[0]), 1 / (1 + math.exp(-z[1])), 1 / (1 + math.exp(-z[2])))

        def loss(z: np.ndarray) -> float:
            z = np.clip(z, -12, 12)
            w, persistence, share = squash(z)
            a, b = persistence * share * 0.9999, persistence * (1 - share) * 0.9999
            v = _recursion(e2 / var, w * 0.1, a, b, 1.0)[:-1]
            return float(np.sum(np.log(v) + e2 / var / v)) if np.isfinite(v).all() and (v > 0).all() else 1e12

        z = np.clip(minimise(loss, np.array([-0.7, 3.0, -2.1]), rounds=160), -12, 12)
        w, persistence, share = squash(z)
        omega, alpha, beta, ok = 0.1 * w * var, persistence * share * 0.9999, persistence * (1 - share) * 0.9999, True
    v = _recursion(e2, omega, alpha, beta, var)
    resid = (r - mu) / np.sqrt(np.maximum(v[:-1], 1e-16))
    return {"mean": mu, "omega": omega, "alpha": alpha, "beta": beta, "next_var": float(v[-1]), "resid": resid, "ok": ok}


def dcc(resid: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(a, b, long-run correlation) of dynamic conditional correlations: a grid, refined once.

    a in 0.0001..0.2, b in 0.7..0.9998, a+b under 0.9999; 0.03 and 0.93 with under 60 rows.
    """
    z = np.asarray(resid, float)
    n, k = z.shape
    base = np.corrcoef(z.T).reshape(k, k)
    if n < 60 or k < 2:
        return 0.03, 0.93, base

    def loss(a: float, b: float) -> float:
        if not (1e-4 <= a <= 0.2 and 0.7 <= b <= 0.9998 and a + b < 0.9999):
            return math.inf
        q, total = base.copy(), 0.0
        for row in z:
            d = np.sqrt(np.diag(q))
            c = q / np.outer(d, d)
            sign, logdet = np.linalg.slogdet(c)
            if sign <= 0:
                return math.inf
            total += logdet + row @ np.linalg.solve(c, row)
            q = (1 - a - b) * base + a * np.outer(row, row) + b * q
        return total

    best = min(((a, b) for a in (0.005, 0.02, 0.05, 0.1) for b in (0.75, 0.85, 0.92, 0.97)), key=lambda x: loss(*x))
    best = min(((best[0] * x, best[1] + y) for x in (0.7, 1, 1.4) for y in (-0.02, 0, 0.015)), key=lambda x: loss(*x))
    return (*best, base) if math.isfinite(loss(*best)) else (0.03, 0.93, base)


def dcc_state(resid: np.ndarray, a: float, b: float, base: np.ndarray) -> np.ndarray:
    """Q after the last row, from the long-run correlation on."""
    q = base.copy()
    for row in np.asarray(resid, float):
        q = (1 - a - b) * base + a * np.outer(row, row) + b * q
    return q


def hawkes(r: np.ndarray, vol: np.ndarray, k: float = 2.0, decay: float = 0.5) -> dict:
    """Base rate, excitation, mean and sd of jumps from the extreme rows (beyond k volatilities)."""
    r, vol = np.asarray(r, float), np.asarray(vol, float)
    hit = np.abs(r) > k * vol
    base = float(hit.mean()) if len(r) else 0.0
    rho = 0.0
    if 2 < hit.sum() < len(hit):
        rho = float(np.corrcoef(hit[1:], hit[:-1])[0, 1]) if hit[1:].std() and hit[:-1].std() else 0.0
    big = (np.abs(r) - k * vol)[hit] * np.sign(r[hit])
    return {"base": base, "excite": decay * min(max(2 * rho, 0.0), 0.8), "decay": decay, "mean": float(big.mean()) if len(big) else 0.0, "sd": float(big.std(ddof=1)) if len(big) > 1 else 0.0}
