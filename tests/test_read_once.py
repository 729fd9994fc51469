"""What several steps read is settled: the plans of results don't hold the steps before anew."""

import random

from pyspark.sql import functions as F

from strandline.operators import cluster, interval_join
from strandline.plans import call_queries, pipeline_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_synced_boundaries(spark, sf_dir):
    """Paths were found again for each step that reads them."""
    found = plan(call_queries.synced_boundaries(spark, sf_dir))
    assert "FlatMapGroupsInPandas" not in found and "lineitem" not in found


def test_islands_write_a_point_once(spark):
    """A point was written once for each level of the islands' widths."""
    r = random.Random(2)
    rows = [(k, p, p + r.choice((1, 40))) for k in range(2) for p in (r.randrange(60_000) for _ in range(300))] + [(0, p, p + 1) for p in range(100_000, 130_000, 400)]
    df = spark.createDataFrame(rows, "k long, start1 long, end1 long")
    found = cluster.with_islands(df, ["k"], 500)
    assert "_level" not in plan(found)
    want, last = {}, {}
    for k, s, e in sorted(rows):
        island, reach = last.get(k, (s, s))
        island = island if s <= reach + 500 else s
        last[k] = island, max(reach, e) if island != s else e
        want[k, s, e] = island
    got = found.collect()
    assert len(got) == len(rows) and {(x["k"], x["start1"], x["end1"]): x["island"] for x in got} == want


def test_tile_join(spark):
    r = random.Random(3)
    cuts = sorted(r.sample(range(-5000, 50_000), 80))
    tiles = spark.createDataFrame([(a, b) for a, b in zip(cuts[::2], cuts[1::2])] + [(7, 7)], "start long, end long").withColumn("chrom", F.lit(1))
    points = spark.createDataFrame([(1, p) for p in [*cuts, *(c - 1 for c in cuts), *range(-6000, 51_000, 777)]], "chrom int, pos long")
    one, two = (sorted(map(tuple, f(points, tiles, bucket=100).collect())) for f in (interval_join.tile_join, interval_join.point_join))
    assert one == two and one


def test_discovered_neighbours(spark, sf_dir):
    """What the reads observe was found three times, the clips' clusters twice."""
    assert "Window" not in plan(pipeline_queries.discovered_neighbours(spark, sf_dir))
