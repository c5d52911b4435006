"""Mean-variance problems said in SQL: every choice of free and bound assets is one linear system; the best feasible answer wins."""

from __future__ import annotations

#: Assets by name, their yearly means as a list, their covariances as a list of rows.
_DATA = "names as (select list(ticker order by ticker) t, list(mu order by ticker) m from ({mu})), grid as (select list(r order by a) c from (select a, list(cov order by b) r from ({cov}) group by 1))"
#: Gauss-Jordan, a column at a time: the systems' leading blocks are positive, so none needs another pivot.
_SOLVE = """solved(key, m, k) as (select key, m, 0 from systems union all
    select key, list_transform(range(1, len(m)+1), lambda i: case when i = k+1 then list_transform(m[k+1], lambda x: x/m[k+1][k+1]) else list_transform(range(1, len(m[i])+1), lambda j: m[i][j] - m[i][k+1]*m[k+1][j]/m[k+1][k+1]) end), k+1 from solved where k < len(m)),
done as (select key, m from solved where k = len(m))"""


def frontier(mu: str, cov: str, points: int = 80) -> str:
    """point, target, vol, ret and weights (a list): least variances at target returns with weights of at least 0, the efficient half."""
    return f"""with recursive {_DATA.format(mu=mu, cov=cov)},
subsets as (select list_filter(range(1, len(t)+1), lambda i: (s >> (i-1)) & 1 = 1) key from names, (select unnest(range(1, 1 << (select len(t) from names))) s) where bit_count(s) >= 2),
systems as (select key, list_concat(list_transform(key, lambda i: list_concat(list_transform(key, lambda j: c[i][j]), [1.0::double, m[i], 0, 0])),
    [list_concat(list_transform(key, lambda j: 1.0::double), [0.0::double, 0, 1, 0]), list_concat(list_transform(key, lambda j: m[j]), [0.0::double, 0, 0, 1])]) m from subsets, names, grid),
{_SOLVE},
targets as (select p point, list_min(m) + (list_max(m)*1.05 - list_min(m))*p/{points - 1}.0::double target from names, (select unnest(range({points})) p)),
weights as (select point, target, list_transform(range(1, len(t)+1), lambda i: case when list_contains(key, i) then d.m[list_position(key, i)][len(key)+3] + target*d.m[list_position(key, i)][len(key)+4] else 0 end) w from done d, names, targets),
valued as (select point, target, w, sqrt(list_sum(list_transform(range(1, len(w)+1), lambda i: w[i]*list_dot_product(c[i], w)))) vol, list_dot_product(m, w) ret from weights, names, grid where list_min(w) >= -1e-10),
best as (select * from valued where isfinite(vol) qualify row_number() over (partition by point order by vol) = 1)
select * from best where ret >= (select arg_min(ret, vol) from best) - 1e-6"""


def tangency(mu: str, cov: str, low: float, high: float, rf: float = 0.035) -> str:
    """ticker, weight, multiplier: the largest excess return over volatility with weights in [low, high].

    Homogenised: least variance of y with excess return 1 and y = kappa w. Choices are low, free or high per asset.
    """
    bound = f"case s when 0 then {low}::double when 2 then {high}::double else 0 end"
    return f"""with recursive {_DATA.format(mu=mu, cov=cov)},
choices as (select list_transform(range(0, len(t)), lambda i: (s // (3**i)::bigint) % 3) st from names, (select unnest(range((3**(select len(t) from names))::bigint)) s)),
keyed as (select {{'st': st, 'f': list_filter(range(1, len(st)+1), lambda i: st[i] = 1), 'b': list_transform(st, lambda s: {bound})}} key from choices),
excess as (select list_transform(m, lambda x: x - {rf}) e from names),
systems as (select key, list_concat(list_transform(key.f, lambda i: list_concat(list_transform(key.f, lambda j: c[i][j]), [1.0::double, e[i], list_dot_product(c[i], key.b), 0])),
    [list_concat(list_transform(key.f, lambda j: 1.0::double), [0.0::double, 0, list_sum(key.b) - 1, 0]), list_concat(list_transform(key.f, lambda j: e[j]), [0.0::double, 0, list_dot_product(e, key.b), 1]),
    list_concat(list_transform(key.f, lambda j: list_dot_product(c[j], key.b)), [list_sum(key.b) - 1, list_dot_product(e, key.b), list_sum(list_transform(range(1, len(key.b)+1), lambda i: key.b[i]*list_dot_product(c[i], key.b))), 0])]) m from keyed, excess, grid where len(key.f) >= 2),
{_SOLVE},
weights as (select list_transform(range(1, len(key.st)+1), lambda i: case when key.st[i] = 1 then m[list_position(key.f, i)][len(key.f)+4]/m[len(key.f)+3][len(key.f)+4] else key.b[i] end) w from done
    union all select list_transform(range(1, len(key.st)+1), lambda i: case when key.st[i] = 1 then 1 - list_sum(key.b) else key.b[i] end) from keyed where len(key.f) = 1),
valued as (select w, list_transform(range(1, len(w)+1), lambda i: list_dot_product(c[i], w)) cw from weights, grid where list_min(w) >= {low} - 1e-10 and list_max(w) <= {high} + 1e-10 and abs(list_sum(w) - 1) < 1e-9),
best as (select w, cw, list_dot_product(e, w)/list_dot_product(w, cw) theta from valued, excess where isfinite(list_sum(w)) order by list_dot_product(e, w)/sqrt(list_dot_product(w, cw)) desc limit 1),
slopes as (select unnest(t) ticker, unnest(w) weight, unnest(list_transform(range(1, len(w)+1), lambda i: e[i] - theta*cw[i])) g from best, names, excess)
select ticker, weight, g - coalesce(avg(g) filter (weight > {low} + 1e-9 and weight < {high} - 1e-9) over (), max(g) filter (weight <= {low} + 1e-9) over (), min(g) over ()) multiplier from slopes"""
