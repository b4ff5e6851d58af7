"""Date-dependent operators at another ``as_of`` (1998-06-15), where
promotions are active and the month windows fall inside the data, checked
against the same oracle SQL with its date literals moved."""

import datetime as dt
import os

import pytest

import __spark_entry__ as E
from agora.config import AS_OF
from agora.operators import admin, listings, provider
from agora.plans.sqlkit import d, month_ts
from agora.plans.verify import compare, duck
from agora.sources.tables import load

SF = "/root/testdata/sf0.001"
DAY = dt.date(1998, 6, 15)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")

CASES = {
    "active_promotions": lambda t: listings.active_promotions(t, DAY),
    "provider_overview": lambda t: provider.provider_overview(t, DAY),
    "admin_overview": lambda t: admin.admin_overview(t, DAY),
    "admin_summary": lambda t: admin.admin_summary(t, DAY),
    "monthly_revenue": lambda t: admin.monthly_revenue(t, DAY),
    "provider_monthly_revenue": lambda t: provider.provider_monthly_revenue(t, DAY),
    "revenue_trend": lambda t: provider.revenue_trend(t, DAY),
}


def moved(sql: str) -> str:
    for back in (0, 1, 5):
        sql = sql.replace(month_ts(AS_OF, back), month_ts(DAY, back))
    return sql.replace(d(AS_OF), d(DAY))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(CASES))
def test_other_as_of(spark, con, name):
    sql = moved(E.oracle_sql()[name])
    assert d(AS_OF) not in sql
    r = compare(spark, con, name, lambda s, sf: CASES[name](load(s, sf)), sql, SF)
    assert r["same_columns"] and r["rows"] == r["oracle_rows"] and r["same_values"], \
        (r["spark_only"], r["oracle_only"])
    if name == "active_promotions":
        assert r["rows"] > 0
