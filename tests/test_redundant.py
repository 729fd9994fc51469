"""Duplications that their first insertion explains: against all pairs, and with a plan that meets each duplication with one insertion."""

import random

import pytest

from strandline.operators import cluster, sweep


def brute(dups, ins, longest, margin, ratio):
    out = []
    for i, chrom, start, end in dups:
        near = [(s, e, z) for c, s, e, z in ins if c == chrom and start - margin < e and s < end + margin and s < e]
        if end - start <= longest and near and min(near)[2] * ratio >= end - start:
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("longest_insertion", [1, 3000])
def test_all_pairs(spark, longest_insertion):
    r = random.Random(longest_insertion)
    dups = [(i, r.randrange(3), s := r.randrange(-500, 30_000), s + r.randrange(1, 3000)) for i in range(300)]
    ins = [(r.randrange(4), s := r.randrange(-700, 40_000), s + r.randrange(1, longest_insertion + 1), r.randrange(4000)) for _ in range(60)] + [(0, 5000, 5000, 9999)]
    ins += ins[:10]
    d, i = spark.createDataFrame(dups, "id long, chrom long, start long, end long"), spark.createDataFrame(ins, "chrom long, start long, end long, size long")
    assert sorted(x.id for x in cluster.redundant_duplications(d, i, 2500).collect()) == brute(dups, ins, 2500, 100, 1.1)
    assert cluster.redundant_duplications(d, i.limit(0)).count() == 0 == cluster.redundant_duplications(d.limit(0), i).count()


def test_no_pairs_of_a_deep_place(spark):
    """200,000 duplications and as many insertions within 2,000 bases: all pairs would be 40 billion."""
    rows = spark.range(200_000).selectExpr("id", "0L AS chrom", "id % 1000 AS start", "id % 1000 + 1000 AS end")
    assert cluster.redundant_duplications(rows, rows.selectExpr("chrom", "start", "start + 1 AS end", "2000L AS size")).count() == 200_000


def test_running_max(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(5000), r.randrange(-9, 9000)) for k in range(2) for _ in range(200)]
    found = sweep.running_max(spark.createDataFrame(rows, "k long, pos long, v long"), ["k"], "pos", "v", "top", 100).collect()
    for k in range(2):
        order, top = sorted((p, v) for j, p, v in rows if j == k), []
        for i in range(len(order)):
            top.append((*order[i], max((v for _, v in order[:i]), default=None)))
        assert sorted((x.pos, x.v, x.top is None, x.top) for x in found if x.k == k) == sorted((p, v, t is None, t) for p, v, t in top)
