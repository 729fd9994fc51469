"""What the steps of joint genotypes shuffle: observations are written once, reads are dealt once; all pairs by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import genotype, interval_join


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("margin", [0, 1, 300, 2500])
def test_flat_join_finds_all_pairs(spark, margin):
    r = random.Random(margin)
    left = [(i, r.randrange(2), s := r.randrange(-4000, 9000), s + r.choice((0, 1, 1, 1, 40, 2500))) for i in range(400)]
    right = [(i, r.randrange(2), s := r.randrange(-4000, 9000), s + r.choice((0, 1, 60, 999, 1000, 1001, 7000))) for i in range(200)]
    a, b = spark.createDataFrame(left, "l long, chrom long, start long, end long"), spark.createDataFrame(right, "r long, chrom long, start long, end long")
    found = interval_join.flat_join(a, b, margin=margin)
    same = interval_join.interval_join(a, b, margin=margin)
    assert found.columns == same.columns
    rows = sorted((x.l, x.r, x.start, x.right_end) for x in found.collect())
    assert rows and rows == sorted((x.l, x.r, x.start, x.right_end) for x in same.collect())
    assert [x[:2] for x in rows] == sorted((i, j) for i, c, s, e in left for j, d, x, y in right if c == d and x < y and s - margin < e + margin and s - margin < y and x < e + margin)


def test_points_are_written_once(spark):
    """Wide variants beside narrow ones make no more rows of the observations."""
    points = spark.range(5000).selectExpr("id", "0L AS chrom", "id * 7 AS start", "id * 7 + 1 AS end")
    spans = spark.range(12).selectExpr("id AS r", "0L AS chrom", "0L AS start", "10L << id AS end")
    made = []
    for join in (interval_join.flat_join, interval_join.interval_join):
        rows = join(points, spans, margin=300)
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        made.append((rows.count(), "_level" in plan))
    assert made[0][0] == made[1][0] and not made[0][1] and made[1][1]


def test_reads_are_dealt_once_for_their_alleles(spark):
    scores = spark.range(2000).select(F.struct((F.col("id") % 300).alias("qname")).alias("read"), (F.col("id") % 2).cast("int").alias("condition"), (F.col("id") % 3).cast("int").alias("allele"), (F.col("id") % 7).cast("double").alias("score"))
    found = genotype.best_alleles(scores)
    assert exchanges(found) == 1
    assert found.count() == found.select("read").distinct().count()
