"""Least squares said in SQL: sums per key, one sweep of the cross sums per factor, then what is read off them."""

from __future__ import annotations

FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma")


def _cell(a: str, b: str, names: tuple[str, ...]) -> str:
    return f"c_{a}_{b}" if names.index(a) <= names.index(b) else f"c_{b}_{a}"


def swept(rows: str, by: str, factors: tuple[str, ...] = FACTORS) -> str:
    """n, means ``m_``, sums of squares ``v_``, swept cross sums ``c_`` and ``sound`` per key of ``rows``.

    After all sweeps the factors' cells are the negative inverse, those with y the slopes, y's own the rest of squares.
    """
    names = ("y", *factors)
    cells = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    sums = ", ".join(f"count(*)*covar_pop({a}, {b}) c_{a}_{b}" for a, b in cells)
    out = f"select {by}, count(*) n, {', '.join(f'avg({c}) m_{c}' for c in names)}, {sums} from ({rows}) group by {by}"
    out = f"select *, {', '.join(f'c_{c}_{c} v_{c}' for c in names)}, true sound from ({out})"
    for p in factors:
        pivot = f"nullif(c_{p}_{p}, 0)"
        new = [f"sound and c_{p}_{p} > 1e-10*v_{p} as sound"]
        for a, b in cells:
            if a == b == p:
                x = f"-1/{pivot}"
            elif p in (a, b):
                x = f"c_{a}_{b}/{pivot}"
            else:
                x = f"c_{a}_{b} - {_cell(a, p, names)}*{_cell(b, p, names)}/{pivot}"
            new.append(f"{x} as c_{a}_{b}")
        out = f"select * replace ({', '.join(new)}) from ({out})"
    return out


def regression(rows: str, by: str = "ticker", factors: tuple[str, ...] = FACTORS, least: int = 63) -> str:
    """n, alpha, se_alpha, t_alpha, ir, r2, sigma, and beta_, se_ and t_ of each factor per key; null under ``least`` rows."""
    k, names = len(factors), ("y", *factors)
    alpha = "m_y" + "".join(f" - c_y_{f}*m_{f}" for f in factors)
    spread = " + ".join(f"m_{f}*m_{g}*{_cell(f, g, names)}" for f in factors for g in factors)
    parts = ", ".join(f"case when ok then c_y_{f} end beta_{f}, case when ok then sqrt(greatest(-c_{f}_{f}*s2, 0)) end se_{f}" for f in factors)
    fits = f"select *, sound and n >= {max(least, k + 2)} ok, greatest(c_y_y, 0) rss, greatest(c_y_y, 0)/nullif(n-{k + 1}, 0) s2 from ({swept(rows, by, factors)})"
    fits = f"select {by}, n, case when ok then {alpha} end alpha, case when ok then sqrt(greatest(s2*(1.0/n - ({spread})), 0)) end se_alpha, case when ok then sqrt(rss/(n-1)) end sigma, case when ok then case when v_y > 1e-12 then 1-rss/v_y else 0 end end r2, {parts} from ({fits})"
    ratios = ", ".join(f"case when se_{f} > 1e-12 then beta_{f}/se_{f} end t_{f}" for f in factors)
    return f"select *, case when se_alpha > 1e-12 then alpha/se_alpha end t_alpha, case when sigma > 1e-12 then alpha/sigma*sqrt(252) end ir, {ratios} from ({fits})"


def columns(factors: tuple[str, ...] = FACTORS) -> str:
    """The double columns of ``regression``."""
    return " ".join(["alpha se_alpha t_alpha ir r2 sigma", *[f"beta_{f} se_{f} t_{f}" for f in factors]])


def vifs(rows: str, factors: tuple[str, ...] = FACTORS) -> str:
    """factor, vif: the diagonal of the inverse correlations."""
    one = swept(f"select 1 k, 0.0::double y, * from ({rows})", "k", factors)
    return f"select unnest([{', '.join(repr(f) for f in factors)}]) factor, unnest([{', '.join(f'-c_{f}_{f}*v_{f}' for f in factors)}]) vif from ({one})"


def condition(rows: str, factors: tuple[str, ...] = FACTORS) -> str:
    """cond: largest over least eigenvalue of the correlations.

    Both are 1 plus an outer root of the characteristic polynomial of (correlations - 1), whose coefficients
    come from the traces of its powers; steps by Newton's rule from outside reach it from one side.
    """
    k = len(factors)
    pairs = [(i, j, f"corr({a}, {b})" if i != j else "1.0") for i, a in enumerate(factors) for j, b in enumerate(factors)]
    base = f"select unnest([{', '.join(str(i) for i, _, _ in pairs)}]) i, unnest([{', '.join(str(j) for _, j, _ in pairs)}]) j, unnest([{', '.join(x for _, _, x in pairs)}]) x from ({rows})"
    powers = [f"m1 as materialized (select i, j, case when i = j then x - 1 else x end x from ({base}))"]
    powers += [f"m{p} as materialized (select a.i, b.j, sum(a.x*b.x) x from m{p - 1} a join m1 b on a.j = b.i group by 1, 2)" for p in range(2, k + 1)]
    traces = "traces as (select " + ", ".join(f"(select sum(x) from m{p} where i = j) p{p}" for p in range(1, k + 1)) + ")"
    es, chain = ["1.0"], "select * from traces"
    for p in range(1, k + 1):
        value = " + ".join(f"({'-' if q % 2 == 0 else ''}{es[p - q]}*p{q})" for q in range(1, p + 1))
        chain = f"select *, ({value})/{p} e{p} from ({chain})"
        es.append(f"e{p}")
    at = lambda cs: "".join("(" for _ in cs[1:]) + cs[0] + "".join(f")*z + {c}" for c in cs[1:])
    poly = [f"({'-' if p % 2 else ''}{es[p]})" for p in range(k + 1)]
    slope = [f"{k - p}*{c}" for p, c in enumerate(poly[:-1])]
    rest = f"({at(poly)})/nullif({at(slope)}, 0)"
    step = f"steps(side, turn, z) as (select side, 0, side*sqrt(p2) from traces, (values (1), (-1)) s(side) union all select side, turn + 1, coalesce(z - {rest}, z) from steps, coefficients where turn < 100)"
    return f"with recursive {', '.join(powers)}, {traces}, coefficients as materialized ({chain}), {step} select max(1+z) filter (side > 0)/greatest(max(1+z) filter (side < 0), 1e-300) cond from steps where turn = 100"
