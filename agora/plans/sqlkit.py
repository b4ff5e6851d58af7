"""Helpers to write the DuckDB oracle SQL for each registered query.

Every oracle statement starts with the fixture derivation prelude (the
eight marketplace tables as CTEs over the driver's views) and then states
the reference's SQL in bulk form (one id -> all ids, ``LIMIT`` per id ->
window rank), written independently of the Spark operators.
"""

from __future__ import annotations

import datetime as _dt

from agora.config import AS_OF, DEMO_DOMAIN
from agora.functions.metrics import month_start
from agora.sources.derive import duckdb_prelude

_PRELUDE = None


def prelude() -> str:
    global _PRELUDE
    if _PRELUDE is None:
        _PRELUDE = duckdb_prelude()
    return _PRELUDE


def oracle(body: str, ctes: str = "") -> str:
    """Full oracle statement: prelude, optional extra CTEs, final SELECT."""
    extra = ("," + ctes.strip().lstrip(",")) if ctes.strip() else ""
    return f"{prelude()}{extra}\n{body.strip()}"


def real(alias: str) -> str:
    """The reference's real-user predicate under the database's collation."""
    return f"strip_accents(lower({alias}.email)) NOT LIKE '%{DEMO_DOMAIN.lower()}'"


def fold(x: str) -> str:
    """What the database's collation compares: no case, accents or trailing spaces."""
    return f"strip_accents(lower(rtrim({x})))"


def d(x: _dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


def month_ts(as_of: _dt.date, back: int) -> str:
    return f"TIMESTAMP '{month_start(as_of, back).isoformat()} 00:00:00'"


AS_OF_SQL = d(AS_OF)


def avg_exact(sum_expr: str, n_expr: str, in_scale: int, out_scale: int) -> str:
    """Exact half-up average with integer arithmetic (DuckDB's AVG is DOUBLE)."""
    units = f"CAST(({sum_expr}) * {10 ** in_scale} AS HUGEINT)"
    q = (f"CASE WHEN ({n_expr}) > 0 THEN ({units} * {2 * 10 ** (out_scale - in_scale)} + ({n_expr})) "
         f"// (2 * ({n_expr})) END")
    frac = "0." + "0" * (out_scale - 1) + "1"
    return (f"CAST(CAST({q} AS DECIMAL(38,0)) * CAST({frac} AS DECIMAL({out_scale + 1},{out_scale})) "
            f"AS DECIMAL(20,{out_scale}))")


def msum(expr: str) -> str:
    return f"CAST(COALESCE(SUM({expr}), 0) AS DECIMAL(20,2))"


def pct(v: str, t: str) -> str:
    """FN1 in SQL."""
    return (f"CAST(CASE WHEN CAST({t} AS DOUBLE) <= 0 THEN 0 ELSE "
            f"least(100.0, greatest(0.0, round(CAST({v} AS DOUBLE) / CAST({t} AS DOUBLE) * 100.0, 0))) END AS INTEGER)")


def growth(cur: str, prev: str) -> str:
    """FN2 in SQL."""
    c, p = f"CAST({cur} AS DOUBLE)", f"CAST({prev} AS DOUBLE)"
    return (f"CASE WHEN {p} <= 0 THEN (CASE WHEN {c} > 0 THEN 100.0 ELSE 0.0 END) "
            f"ELSE round(({c} - {p}) / {p} * 100.0, 1) END")


def goal_target(tot: str, tgt: str) -> str:
    """FN3 in SQL."""
    return (f"CASE WHEN CAST({tgt} AS DOUBLE) > 0 THEN CAST({tgt} AS DOUBLE) "
            f"ELSE greatest(CAST({tot} AS DOUBLE), 1.0) END")


# The sets that every report stands on, by what they mean: who is genuine, and
# which rows only concern genuine people. Names are this file's own.
FACTS = f"""
folk AS (SELECT id AS who, name AS called, role AS part, suffix(strip_accents(lower(email)), '{DEMO_DOMAIN.lower()}') AS staged FROM users),
genuine AS (SELECT who, called, part FROM folk WHERE NOT staged),
stage AS (SELECT who FROM folk WHERE staged),
asks AS (FROM service_requests SEMI JOIN genuine ON who = client_id),
market AS (FROM asks ANTI JOIN stage ON who = selected_provider_id),
won AS (FROM asks SEMI JOIN genuine ON who = selected_provider_id),
offers AS (FROM bids SEMI JOIN genuine ON who = provider_id SEMI JOIN asks ON asks.id = request_id),
income AS (
  SELECT x.*, won.selected_provider_id AS seller, won.title, strftime(x.created_at, '%Y-%m') AS month_key,
         strftime(x.created_at, '%b') AS month_label
  FROM transactions x, won WHERE won.id = x.request_id)"""


def report(body: str, more: str = "") -> str:
    """``body`` over the facts, with further named queries on top of them."""
    return oracle(body, FACTS + (",\n" + more if more else ""))


def place(order: str, owner: str = "", name: str = "rank") -> str:
    """Position in an ordered list, one list for each owner."""
    part = f"PARTITION BY {owner} " if owner else ""
    return f"CAST(row_number() OVER ({part}ORDER BY {order}) AS INTEGER) AS {name}"
