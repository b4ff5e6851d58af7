"""Column helpers: PHP input rules, metrics, money text, sparkline."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from agora.functions import metrics as M
from agora.functions import text as X
from agora.operators.provider import sparkline


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).collect()[0]["r"]


def test_php_float_and_int(spark):
    cases = {"12abc": 12.0, "1e3": 1000.0, ".5x": 0.5, "abc": 0.0, " 7": 7.0, "-5": -5.0,
             "": 0.0, None: 0.0, "\t3.25 usd": 3.25, "+4.": 4.0}
    for raw, want in cases.items():
        assert one(spark, X.php_float, raw) == want, raw
    assert one(spark, X.php_int, "12.9abc") == 12
    assert one(spark, X.php_int, "-3.7") == -3
    assert one(spark, X.php_int, "1e3") == 1000


def test_php_trim_and_date(spark):
    assert one(spark, X.php_trim, " \t a b \n") == "a b"
    assert one(spark, X.php_trim, None) == ""
    assert one(spark, X.parse_date, " 2001-07-15 ") == dt.date(2001, 7, 15)
    assert one(spark, X.parse_date, "soon") is None


def test_percentage_growth_goal(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 0.0), (7.0, 5.0), (-1.0, 4.0), (1.0, 200.0)], "v double, t double")
    got = [r[0] for r in df.select(M.percentage("v", "t")).collect()]
    assert got == [33, 0, 100, 0, 1]  # 0.5 rounds half up
    g = spark.createDataFrame([(10.0, 0.0), (0.0, 0.0), (15.0, 10.0), (5.0, 10.0)], "c double, p double")
    assert [r[0] for r in g.select(M.growth_percent("c", "p")).collect()] == [100.0, 0.0, 50.0, -50.0]
    h = spark.createDataFrame([(50.0, 0.0), (0.0, 0.0), (50.0, 200.0)], "r double, t double")
    assert [r[0] for r in h.select(M.goal_target("r", "t")).collect()] == [50.0, 1.0, 200.0]


def test_money_text_rounds_half_up(spark):
    df = spark.createDataFrame([(D("0.125000"),), (D("1234567.005000"),), (D("0.000000"),)], "v decimal(20,6)")
    assert [r[0] for r in df.select(M.money_text("v")).collect()] == ["0.13", "1,234,567.01", "0.00"]


def test_exact_avg(spark):
    df = spark.createDataFrame([(469, 200), (7, 3), (0, 0)], "s long, n long")
    got = [r[0] for r in df.select(M.exact_avg(F.col("s"), F.col("n"), 0, 2)).collect()]
    assert got == [D("2.35"), D("2.33"), None]


def test_promotion_discount(spark):
    df = spark.createDataFrame(
        [(D("100.00"), "percent", D("150.00")), (D("50.00"), "fixed", D("80.00")),
         (D("900.00"), "percent", D("20.00")), (D("10.00"), None, None), (D("33.33"), "percent", D("15.00"))],
        "p decimal(10,2), ty string, v decimal(10,2)")
    out = df.select("p", M.promotion_discount("p", "ty", "v").alias("d")).withColumn("f", M.final_price("p", "d"))
    got = [(r["d"], r["f"]) for r in out.collect()]
    assert got == [(D("150.00"), D("0.00")), (D("50.00"), D("0.00")), (D("180.00"), D("720.00")),
                   (D("0.00"), D("10.00")), (D("5.00"), D("28.33"))]


def test_month_bounds():
    assert M.month_start(dt.date(2001, 3, 31), 1) == dt.date(2001, 2, 1)
    assert M.month_start(dt.date(2001, 1, 15), 5) == dt.date(2000, 8, 1)


def test_sparkline_shapes(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "owner int")
    series = spark.createDataFrame(
        [(2, "2001-05", D("50.00")), (3, "2001-05", D("0.00")), (3, "2001-06", D("100.00")), (3, "2001-07", D("25.00"))],
        "owner int, month_key string, revenue decimal(20,2)")
    got = {r["owner"]: (r["months"], r["points"]) for r in sparkline(series, ["owner"], base).collect()}
    assert got[1] == (0, "10,72 190,72")
    assert got[2] == (1, "10,20 190,20")
    assert got[3] == (3, "10,78 100,20 190,63.5")
