"""Reciprocal overlaps: all pairs by brute force, exact bounds, and a plan whose candidates are few."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import interval_join


def alike(a, b, least, most):
    shared = max(min(a[3], b[3]) - max(a[2], b[2]), 0)
    return a[1] == b[1] and shared / max(a[3] - a[2], b[3] - b[2], 100) >= least and (most is None or abs(a[2] - b[2]) <= most)


@pytest.mark.parametrize("least,most", [(0.9, None), (0.9, 40), (0.8, None), (0.5, 200)])
def test_all_pairs(spark, least, most):
    r, sides = random.Random(int(100 * least)), []
    for _ in range(2):
        spans = [(i, r.randrange(2), s := r.randrange(-300, 3000), s + r.choice((0, 1, 79, 80, 90, 100, 101, 1000, 900, 800, 1250, r.randrange(1, 4000), 100_000))) for i in range(250)]
        sides.append(spans + [(1000 + k, 5, 0, n) for k, n in enumerate((80, 90, 100, 1000, 900, 800, 1_000_000, 900_000, 800_000))])
    a, b = sides
    left, right = spark.createDataFrame(a, "l long, chrom long, start long, end long"), spark.createDataFrame(b, "r long, chrom long, start long, end long")
    found = interval_join.reciprocal_join(left, right, least, most_shift=most)
    if most is not None:
        found = found.filter(F.abs(F.col("start") - F.col("right_start")) <= most)
    assert sorted(map(tuple, found.select("l", "r").collect())) == sorted((x[0], y[0]) for x in a for y in b if alike(x, y, least, most))


def test_nested_lengths_do_not_meet(spark):
    """40,000 short spans within as many long ones: overlaps would be 1.6 billion."""
    rows = spark.range(40_000)
    short = rows.selectExpr("id AS l", "0L AS chrom", "id AS start", "id + 500 AS end")
    wide = rows.selectExpr("id AS r", "0L AS chrom", "id - 100000 AS start", "id + 100000 AS end")
    assert interval_join.reciprocal_join(short, wide, 0.8).count() == 0
