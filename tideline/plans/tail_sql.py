"""Peaks over threshold said in SQL: the profile likelihood on a grid, and rounds of finer grids around its best point."""

from __future__ import annotations

from tideline.operators.tails import FINER, ROUNDS


def tail_var(returns: str, level: float = 0.99, tail: float = 0.10, least: int = 20) -> str:
    """ticker, var_evt of ``returns`` (ticker, ret)."""
    parts = [
        f"loss as materialized (select ticker, -ret loss from ({returns}))",
        f"cut as (select ticker, quantile_cont(loss, {1 - tail}) u, quantile_cont(loss, 0.99) plain from loss group by 1 having count(*) >= 60)",
        "x as materialized (select ticker, u, plain, loss - u x from loss join cut using(ticker) where loss > u)",
        "n as (select ticker, count(*) m, any_value(u) u, any_value(plain) plain from x group by 1)",
        f"xs as materialized (select ticker, x from x join n using(ticker) where m >= {least})",
        "g0 as (select ticker, list_sort(list_concat(list_transform(range(160), lambda k: -1e-4*power(20/1e-4, k/159.0::double)/mean), list_transform(range(80), lambda k: (1 - 0.9999*power(1e-6/0.9999, k/79.0::double))/top))) a from (select ticker, avg(x) mean, max(x) top from xs group by 1))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"l{r} as (select ticker, g, theta, count(*) n, avg(ln(1 - theta*x)) shape from xs join (select ticker, g, a[g] theta from (select ticker, a, unnest(range(1, len(a)+1)) g from g{r})) using(ticker) where theta <> 0 group by all)")
        parts.append(f"b{r} as materialized (select ticker, arg_min({{'g': g, 'theta': theta, 'shape': shape}}, n*ln(-shape/theta) + n*(shape + 1)) p from l{r} where -shape/theta > 0 and shape > -1 group by 1)")
        parts.append(f"g{r + 1} as (select ticker, list_transform(range({FINER + 1}), lambda k: lo + (hi - lo)*k/{FINER}.0::double) a from (select ticker, a[greatest(p.g - 1, 1)] lo, a[least(p.g + 1, len(a))] hi from b{r} join g{r} using(ticker)))")
    far = f"case when abs(p.shape) < 1e-6 then u - (-p.shape/p.theta)*ln({(1 - level) / tail}::double) else u + (-1/p.theta)*(power({(1 - level) / tail}::double, -p.shape) - 1) end"
    return f"with {', '.join(parts)} select ticker, case when m < {least} then plain else {far} end var_evt from n left join b{ROUNDS} using(ticker)"
