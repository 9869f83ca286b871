"""Retail profit analytics as plain Spark DataFrame jobs."""

from profitloom.config import ProfitConfig

__all__ = ["ProfitConfig"]
