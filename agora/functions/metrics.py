"""Column functions for the dashboard arithmetic (all built-in expressions,
so they stay inside whole-stage codegen)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money_sum(x) -> Column:
    """SUM of a DECIMAL(10,2) column as DECIMAL(20,2), 0 when there are no
    rows (``COALESCE(SUM(x), 0)``)."""
    return F.coalesce(F.sum(_c(x)), F.lit(0)).cast("decimal(20,2)")


def percentage(value, total) -> Column:
    """FN1: 0 if total <= 0 else clamp(round(value / total * 100), 0, 100) as int."""
    v, t = _c(value).cast("double"), _c(total).cast("double")
    raw = F.round(v / t * F.lit(100.0), 0)
    return (F.when(t <= 0, F.lit(0))
             .otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))
             .cast("int"))


def growth_percent(current, previous) -> Column:
    """FN2: previous <= 0 -> 100 if current > 0 else 0; else round(delta%, 1)."""
    cur, prev = _c(current).cast("double"), _c(previous).cast("double")
    return (F.when(prev <= 0, F.when(cur > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
             .otherwise(F.round((cur - prev) / prev * F.lit(100.0), 1)))


def goal_target(total_revenue, target_revenue) -> Column:
    """FN3: the list-price target, or max(revenue, 1) when it is not positive."""
    tot, tgt = _c(total_revenue).cast("double"), _c(target_revenue).cast("double")
    return F.when(tgt > 0, tgt).otherwise(F.greatest(tot, F.lit(1.0)))


def bar_max(value_max) -> Column:
    """FN4: the bar scale, the set's maximum floored at 1 (1 for an empty set)."""
    return F.greatest(F.lit(1.0), F.coalesce(_c(value_max).cast("double"), F.lit(1.0)))


def discount_percent(discount, price) -> Column:
    """FN7: 0 if price <= 0 else round(discount / price * 100, 1)."""
    d, p = _c(discount).cast("double"), _c(price).cast("double")
    return F.when(p <= 0, F.lit(0.0)).otherwise(F.round(d / p * F.lit(100.0), 1))


def promotion_discount(price, discount_type, discount_value) -> Column:
    """FN8: percent -> round(price * value / 100, 2) (not capped); fixed ->
    min(value, price); no promotion -> 0. Exact decimal (``* 0.01``). NULL
    where the amount does not fit DECIMAL(10,2)."""
    p, ty, v = _c(price), _c(discount_type), _c(discount_value)
    return (F.when(ty == "percent", F.round(p * v * F.lit(0.01).cast("decimal(3,2)"), 2))
             .when(ty == "fixed", F.least(v, p))
             .otherwise(F.lit(0))
             .try_cast("decimal(10,2)"))


def final_price(price, discount) -> Column:
    """FN8: max(price - discount, 0)."""
    gone = _c(discount)
    return F.when(gone.isNotNull(), F.greatest(_c(price) - gone, F.lit(0))).try_cast("decimal(10,2)")


def money_text(x) -> Column:
    """FN16: two decimals with thousands commas. ``format_number`` rounds
    half-even, so round half-up first as the reference does."""
    return F.format_number(F.round(_c(x).cast("decimal(38,6)"), 2), 2)


def month_start(d: _dt.date, months_back: int = 0) -> _dt.date:
    """First day of the month ``months_back`` before ``d`` (FN11)."""
    y, m = d.year, d.month - months_back
    while m <= 0:
        m += 12
        y -= 1
    return _dt.date(y, m, 1)


def month_bound(as_of: _dt.date, months_back: int) -> Column:
    """``DATE_FORMAT(as_of - INTERVAL n MONTH, '%Y-%m-01')`` as a NTZ literal."""
    return F.lit(month_start(as_of, months_back).isoformat() + " 00:00:00").cast("timestamp_ntz")


def exact_avg(sum_col: Column, count_col: Column, in_scale: int, out_scale: int) -> Column:
    """Average of non-negative values carrying ``in_scale`` decimals, rounded
    half-up to ``out_scale`` decimals with integer arithmetic only, so the
    result is exact whatever the count (no double, no double rounding).
    NULL when the count is 0."""
    units = (sum_col.cast("decimal(38,%d)" % in_scale) * F.lit(10 ** in_scale)).cast("decimal(38,0)")
    n = count_col.cast("decimal(38,0)")
    num = units * F.lit(2 * 10 ** (out_scale - in_scale)) + n
    den = n * F.lit(2)
    q = F.when(n > 0, ((num - F.pmod(num, den)) / den).cast("decimal(38,0)"))
    return (q / F.lit(10 ** out_scale)).cast("decimal(20,%d)" % out_scale)
