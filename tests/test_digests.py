"""Differing rows found by digests against comparing all rows."""

import random

import pytest

from profitloom.plans import digests as D

SCHEMA = "k long, a string, b decimal(20,4)"
COLUMNS = ["a", "b"]


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def compare(left, right):
    trees = D.build_tree(left, "k", COLUMNS), D.build_tree(right, "k", COLUMNS)
    ranges = D.differing_ranges(*trees)
    found = D.differing_rows(left, right, ranges, "k", COLUMNS)
    return {r["key"]: r["difference"] for r in found.collect()}, sorted(str(r["node"]) for r in ranges.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_planted_differences_are_found_and_nothing_else(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**9), rng.choice(["x", "", None]), None) for _ in range(500)]
    rows += [(None, "n", None), (7, "twice", None), (7, "twice", None), (8, None, None), (-5, "minus", None)]
    other = [r for r in rows if r[0] not in (rows[3][0],)] + [(999_999_999_999, "more", None)]
    other[10] = (other[10][0], "changed", None)
    other.remove((7, "twice", None))
    other[other.index((8, None, None))] = (8, "", None)
    other[other.index((None, "n", None))] = (None, "m", None)
    got, ranges = compare(table(spark, rows), table(spark, other, 5))
    want = {rows[3][0]: "missing right", other[10][0]: "changed", 7: "changed", 8: "changed", None: "changed",
            999_999_999_999: "missing left"}
    assert got == want
    assert set(ranges) == {str(None if k is None else int(k / D.SPAN)) for k in want}
    assert compare(table(spark, rows), table(spark, rows[::-1], 7)) == ({}, [])


def test_empty_sides(spark):
    rows = [(1, "a", None), (2, "b", None)]
    assert compare(table(spark, []), table(spark, [])) == ({}, [])
    assert compare(table(spark, rows), table(spark, []))[0] == {1: "missing right", 2: "missing right"}
