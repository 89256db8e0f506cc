"""Scalar column functions: pure ``Column -> Column`` expressions, all JVM-side.

Text parsing uses the ``try_*`` forms, so malformed input yields NULL
instead of failing the job under ANSI mode.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- codes and dates

def right_code(right) -> Column:
    """CALL -> C, PUT -> P, anything else passes through unchanged."""
    r = _c(right)
    return F.when(r == "CALL", "C").when(r == "PUT", "P").otherwise(r)


def third_friday(d) -> Column:
    """P5: third Friday of the month of ``d`` (first Friday on/after the 1st, plus 14 days)."""
    first = F.trunc(_c(d), "MM")
    return F.date_add(F.next_day(F.date_sub(first, 1), "FRI"), 14)


def trade_date_by_cutoff(ts, cutoff_hour: int = 7) -> Column:
    """A timestamp before ``cutoff_hour`` o'clock belongs to the previous day."""
    return F.to_date(_c(ts) - F.make_dt_interval(F.lit(0), F.lit(cutoff_hour)))


def iso_date_prefix(text) -> Column:
    """Date from the first 10 characters of an ISO timestamp text; bad text -> NULL."""
    return F.try_to_date(F.substring(_c(text), 1, 10), "yyyy-MM-dd")


def yyyymmdd_date(text) -> Column:
    """Date from ``YYYYMMDD[ time]`` (text before the first space, strict parse)."""
    return F.try_to_date(F.split_part(_c(text), F.lit(" "), F.lit(1)), "yyyyMMdd")


def expiry_date(text) -> Column:
    """Expiry text in either ``YYYY-MM-DD`` (current feed) or ``YYYYMMDD`` (legacy)."""
    t = _c(text)
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "yyyyMMdd"))


def text_number(text) -> Column:
    """Optional numeric text field: empty or malformed -> NULL, NaN -> NULL."""
    v = F.nullif(_c(text), F.lit("")).try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


# ---------------------------------------------------------------- fallbacks

def price_fallback(last, close, model) -> Column:
    """P10: first of Last, Close, Model price that is non-null and > 0 (NULL if none)."""
    return F.coalesce(*[F.when(_c(x) > 0, _c(x)) for x in (last, close, model)])


def spot_fallback(last, close, bid, ask) -> Column:
    """First truthy (non-null, non-zero) of Last, Close, Bid, Ask; valid only if > 0."""
    first = F.coalesce(*[F.nullif(_c(x), F.lit(0.0)) for x in (last, close, bid, ask)])
    return F.when(first > 0, first)


def right_open_interest(right, call_oi, put_oi) -> Column:
    """The call OI field for right C, else the put one."""
    return F.when(_c(right) == "C", _c(call_oi)).otherwise(_c(put_oi))


# ---------------------------------------------------------------- normal distribution, greeks

# Abramowitz-Stegun 26.2.17 coefficients (p, b1..b5).
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)


def norm_pdf(x) -> Column:
    x = _c(x)
    return F.lit(INV_SQRT_2PI) * F.exp(-0.5 * x * x)


def norm_cdf(x) -> Column:
    """Standard normal CDF by Abramowitz-Stegun 26.2.17 (abs error < 7.5e-8); Spark has no erf."""
    x = _c(x)
    ax = F.abs(x)
    t = 1.0 / (1.0 + AS_P * ax)
    poly = t * (AS_B[0] + t * (AS_B[1] + t * (AS_B[2] + t * (AS_B[3] + t * AS_B[4]))))
    upper = 1.0 - norm_pdf(ax) * poly
    return F.when(x >= 0, upper).otherwise(1.0 - upper)


def bs_d1(spot, strike, iv, t_years) -> Column:
    s, k, v, t = _c(spot), _c(strike), _c(iv), _c(t_years)
    return F.try_divide(F.log(s / k) + 0.5 * v * v * t, v * F.sqrt(t))


def bs_gamma(spot, strike, iv, t_years) -> Column:
    """Black-Scholes gamma with r = 0: pdf(d1) / (S sigma sqrt(T)); NULL when undefined."""
    d1 = bs_d1(spot, strike, iv, t_years)
    return F.try_divide(norm_pdf(d1), _c(spot) * _c(iv) * F.sqrt(_c(t_years)))


def bs_delta(spot, strike, iv, t_years, right) -> Column:
    """Black-Scholes delta with r = 0: N(d1) for calls, N(d1) - 1 for puts."""
    nd1 = norm_cdf(bs_d1(spot, strike, iv, t_years))
    return F.when(_c(right) == "C", nd1).otherwise(nd1 - 1.0)
