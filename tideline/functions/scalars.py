"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def norm_ppf(p) -> Column:
    """Normal quantile by a rational approximation in sqrt(-2 ln q) (fixed coefficients)."""
    p = _c(p)
    q = F.when(p < 0.5, p).otherwise(1 - p)
    t = F.sqrt(-2 * F.log(q))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p <= 0, F.lit(-math.inf)).when(p >= 1, F.lit(math.inf)).when(p < 0.5, -x).otherwise(x)


def erfc(x) -> Column:
    """Complementary error function by a rational approximation of Chebyshev type; error under 1.2e-7 relative."""
    x = _c(x)
    t = 1 / (1 + 0.5 * F.abs(x))
    poly = F.lit(0.0)
    for a in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + a
    y = t * F.exp(-x * x + poly)
    return F.when(x >= 0, y).otherwise(2 - y)


def norm_cdf(x) -> Column:
    return 0.5 * erfc(-_c(x) / math.sqrt(2))


def psr_z(ir, n, skew, kurt) -> Column:
    """z of the probabilistic Sharpe ratio; null where the variance term is not positive."""
    ir, n, skew, kurt = map(_c, (ir, n, skew, kurt))
    v = 1 - skew * ir + (kurt - 1) / 4 * ir * ir
    return F.when(v > 0, ir * F.sqrt(n - 1) / F.sqrt(F.greatest(v, F.lit(1e-300))))


def expected_max_ir(trials, n) -> Column:
    """Expected maximum information ratio of independent trials over n rows; 0 for one trial or under two rows."""
    k, n = _c(trials), _c(n)
    g = EULER_GAMMA
    value = ((1 - g) * norm_ppf(1 - 1 / k) + g * norm_ppf(1 - 1 / (k * math.e))) / F.sqrt(n)
    return F.when((k <= 1) | (n < 2), 0.0).otherwise(value)


def t_stat(value, se) -> Column:
    return F.when(_c(se) > 1e-12, _c(value) / _c(se))


def bond_coupon(symbol) -> Column:
    """Coupon of symbols like ``T 3 3/4 06/30/27`` or ``T 4.5 12/31/28``."""
    s = _c(symbol)
    whole = F.regexp_extract(s, r"^\S+\s+(\d+)\s+\d+/\d+\s+\d{2}/\d{2}/\d{2}$", 1)
    up, down = (F.regexp_extract(s, r"^\S+\s+\d+\s+(\d+)/(\d+)\s+\d{2}/\d{2}/\d{2}$", k) for k in (1, 2))
    plain = F.regexp_extract(s, r"^\S+\s+(\d+(?:\.\d+)?)\s+\d{2}/\d{2}/\d{2}$", 1)
    mixed = whole.try_cast("double") + up.try_cast("double") / F.nullif(down.try_cast("double"), F.lit(0.0))
    return F.coalesce(mixed, plain.try_cast("double"))


def bond_maturity(symbol) -> Column:
    return F.nullif(F.regexp_extract(_c(symbol), r"(\d{2}/\d{2}/\d{2})$", 1), F.lit(""))


def broker_ticker(code) -> Column:
    """``AAPL_US_EQ`` -> ``AAPL``: the type suffix, then a country of two or three capitals, come off."""
    return F.regexp_replace(F.regexp_replace(_c(code), r"(?i)_(EQ|ETF|FUND)$", ""), r"_[A-Z]{2,3}$", "")


def dot_dash(ticker) -> Column:
    return F.replace(_c(ticker), F.lit("."), F.lit("-"))


def matches(query: str, *columns) -> Column:
    """Case-insensitive substring of any column; a blank query matches nothing."""
    q = query.strip().lower()
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(_c(c)), F.lit(q))
    return out if q else F.lit(False)


def promotion_note(signal, t, ir, day) -> Column:
    return F.format_string("FF5 signal=%s t=%.2f IR=%.2f [%s]", _c(signal), _c(t), _c(ir), F.date_format(_c(day), "yyyy-MM-dd"))


def note_date(note) -> Column:
    return F.to_date(F.nullif(F.regexp_extract(_c(note), r"\[(\d{4}-\d{2}-\d{2})\]$", 1), F.lit("")))


def is_promoted(note) -> Column:
    return F.coalesce(F.startswith(_c(note), F.lit("FF5 signal=")), F.lit(False))


def fmt_pct(x, digits: int = 1) -> Column:
    """Signed percent, N/A for null."""
    return F.when(_c(x).isNull(), "N/A").otherwise(F.format_string(f"%+.{digits}f%%", _c(x) * 100))


def fmt_eur(x) -> Column:
    """Whole euros with thousands, N/A for null."""
    return F.when(_c(x).isNull(), "N/A").otherwise(F.concat(F.lit("€"), F.format_number(_c(x), 0)))


def fmt_float(x, digits: int = 2) -> Column:
    return F.when(_c(x).isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", _c(x)))


def millis(t) -> Column:
    return F.timestamp_millis(_c(t))


def iso_day(text) -> Column:
    return F.substring(_c(text), 1, 10)


def trading_cost(mv, adv, commission: float = 5.0, half_spread_bp: float = 5.0, kappa: float = 0.10, sigma: float = 0.015) -> Column:
    """Commission, half spread and square-root impact of a position; 0 where mv is not positive."""
    mv, adv = _c(mv), _c(adv)
    return F.when(mv > 0, commission + mv * half_spread_bp / 1e4 + mv * kappa * sigma * F.sqrt(mv / adv)).otherwise(0.0)


def capital_gains_tax(gain, rate: float = 0.33, free: float = 1270.0) -> Column:
    return rate * F.greatest(_c(gain) - free, F.lit(0.0))


def margin_call(nav, borrowed, maintenance: float = 0.25) -> Column:
    """If at any step of the nav array (nav - borrowed) / nav falls under maintenance."""
    b = _c(borrowed)
    return F.exists(_c(nav), lambda x: F.coalesce(F.try_divide(x - b, x), F.lit(-1.0)) < maintenance)


def weight_bounds(n) -> tuple[Column, Column]:
    n = _c(n)
    low = F.greatest(F.lit(0.001), 0.5 / n)
    return low, F.greatest(F.least(F.lit(0.4), 5.0 / n), 2 * low)
