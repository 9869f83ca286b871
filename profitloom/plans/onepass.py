"""Many reports from one pass over the order table.

The order table is grouped by week, day, payment method, city and code at once with grouping sets:
each order becomes one partial row per report inside its task, and all reports share one exchange of
sums. The result has a row per week, day, method, city or code, so it is small, and written
once it feeds every report on the page without the orders being touched again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitloom import config as C
from profitloom.config import ProfitConfig
from profitloom.functions.money import AMOUNT, as_double, cast, money_out, quote, total
from profitloom.plans.trends import WEEK

#: Grouping columns in order, one per report.
SETS = ("week", "order_date", "payment_method", "city", "discount_code")
SUMS = ("revenue_excl_mva", "total_cost", "profit", "total_discount", "first_line_discount")


def report_sums(orders: DataFrame) -> DataFrame:
    """Order count and exact sums by each of ``SETS``; ``report`` names the column that a row is of."""
    wide = orders.selectExpr(WEEK, "order_date", "payment_method", "city", "discount_code", *SUMS)
    columns = [F.col(c) for c in SETS]
    # A set bit of the grouping id says that a column isn't in the row's set; the first column has the highest.
    others = (1 << len(SETS)) - 1
    names = " ".join(f"when {others & ~(1 << (len(SETS) - 1 - i))} then {quote(c)}" for i, c in enumerate(SETS))
    grouped = wide.groupingSets([[c] for c in columns], *columns).agg(
        F.expr(f"case grouping_id() {names} end as report"),
        F.expr("count(1) as orders"),
        *[F.expr(f"{cast(total(c), AMOUNT)} as {c}") for c in SUMS],
    )
    return grouped.select("report", *SETS, "orders", *SUMS)


def _of(sums: DataFrame, name: str) -> DataFrame:
    return sums.filter(f"report = {quote(name)}")


def _out(*names: str) -> list[str]:
    return [f"{money_out(c)} as {c}" for c in names]


def weekly_profit(sums: DataFrame) -> DataFrame:
    return _of(sums, "week").selectExpr("week", *_out("revenue_excl_mva", "total_cost", "profit")).orderBy("week")


def weekly_aov(sums: DataFrame) -> DataFrame:
    mean = f"{as_double('revenue_excl_mva')} / orders"
    return _of(sums, "week").selectExpr("week", *_out("revenue_excl_mva"), "orders", f"{money_out(mean)} as aov").orderBy("week")


def daily_orders(sums: DataFrame) -> DataFrame:
    return _of(sums, "order_date").selectExpr("order_date", "orders").orderBy("order_date")


def payment_summary(sums: DataFrame) -> DataFrame:
    names = " ".join(f"when {quote(k)} then {quote(v)}" for k, v in C.PAYMENT_NAMES.items())
    rows = _of(sums, "payment_method").orderBy(F.col("revenue_excl_mva").desc(), "payment_method")
    label = f"case payment_method {names} else payment_method end as payment_method"
    return rows.selectExpr(label, "orders", *_out("revenue_excl_mva"))


def city_top(sums: DataFrame, cfg: ProfitConfig) -> DataFrame:
    rows = _of(sums, "city").orderBy(F.col("orders").desc(), "city").limit(cfg.top_n)
    return rows.selectExpr("city", "orders", *_out("revenue_excl_mva"))


def discount_usage(sums: DataFrame) -> DataFrame:
    rows = _of(sums, "discount_code").orderBy(F.col("orders").desc(), "discount_code")
    return rows.selectExpr(
        "discount_code", "orders", *_out("first_line_discount"), f"{money_out('total_discount')} as all_line_discount",
        *_out("revenue_excl_mva", "profit"),
    )
