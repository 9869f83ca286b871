"""Joins that hold up when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def left_join_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, spread_by: str, fits: bool
) -> DataFrame:
    """Left join with a table that has one row per key.

    A lookup measured to fit is broadcast. A larger one is repeated ``SALTS`` times
    and met by rows spread over the copies, so a hot key is shared by as many tasks.
    ``spread_by`` names columns that tell the rows of one key apart.
    """
    if fits:
        return rows.join(F.broadcast(lookup), key, "left")
    copies = lookup.selectExpr("*", f"explode(sequence(0, {SALTS - 1})) as salt")
    salted = rows.selectExpr("*", f"cast(pmod(xxhash64({spread_by}), {SALTS}) as int) as salt")
    return salted.join(copies, [key, "salt"], "left").drop("salt")
