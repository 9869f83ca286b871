"""Card fee transactions (S2) and the wallet ledger (S3)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom.config import ProfitConfig
from profitloom.functions.money import MONEY, cast, total
from profitloom.schemas import CARD_TRANSACTION, WALLET_ENTRY


def read_card_transactions(spark: SparkSession, path: str | None) -> DataFrame:
    """Landed balance transactions; a shop without that feed has no rows."""
    if path is None:
        return spark.createDataFrame([], CARD_TRANSACTION)
    return spark.read.schema(CARD_TRANSACTION).json(path)


def read_wallet_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    if path is None:
        return spark.createDataFrame([], WALLET_ENTRY)
    return spark.read.schema(WALLET_ENTRY).json(path)  # a folder per day, read by day


def card_fees_by_order(transactions: DataFrame) -> DataFrame:
    """Fee per order id, summed over the order's charges (order_id, actual_fee)."""
    return (
        transactions.filter("type = 'charge' and coalesce(source_order_id, 0) <> 0")
        .groupBy(F.col("source_order_id").alias("order_id"))
        .agg(F.expr(f"{total(cast('fee', MONEY))} as actual_fee"))
    )


def wallet_window(cfg: ProfitConfig, start: date | None = None, end: date | None = None):
    """First and last ledger day, both included."""
    end = end or cfg.as_of
    return start or end - timedelta(days=cfg.wallet_window_days), end


def wallet_fee_summary(ledger: DataFrame, start: date, end: date) -> DataFrame:
    """One row: fees, captured amount, average rate and number of captures."""
    wanted = ledger.filter(
        f"ledger_date between date'{start}' and date'{end}' "
        "and entryType in ('capture', 'capture-fee')"
    )
    sums = wanted.selectExpr(
        "coalesce(sum(abs(amount)) filter (where entryType = 'capture-fee'), 0) as fees",
        "coalesce(sum(amount) filter (where entryType = 'capture'), 0) as captured",
        "count_if(entryType = 'capture') as num_transactions",
    )
    return sums.selectExpr(
        "fees / 100d as total_fees",
        "captured / 100d as total_captured",
        "case when captured > 0 then (fees / 100d) / nullif(captured / 100d, 0d) else 0d end"
        " as avg_rate",
        "num_transactions",
    )
