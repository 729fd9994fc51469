"""Neighbouring ends: all observations count, and candidate pairs are no rows."""

import random

import duckdb

import __spark_entry__
from strandline.operators import cluster
from tests.test_neighbours import brute


def test_observations_of_all_numbers_count(spark, tmp_path):
    """The table's every third observation alone has pairs, as the SQL says."""
    events = spark.range(0, 6000, 3).selectExpr("id AS event_id", "timestamp'2024-01-01 00:00:00' AS ts", "id % 900 AS user_id", "'x' AS event_type", "1.0D AS value", "'' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = __spark_entry__.queries()["neighbour_pairs"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    rows = sorted(map(tuple, found.select("id", "next_id", "fit").collect()))
    assert rows and rows == sorted(con.execute(__spark_entry__.oracle_sql()["neighbour_pairs"]).fetchall())


def test_crowded_ends_write_no_candidate_pairs(spark):
    """Hundreds of ends that all are candidates of each other, of all widths: no join over buckets, the same pairs."""
    r = random.Random(7)
    starts = [r.randrange(4000) for _ in range(400)]
    ends = [(i, 1, s, s + r.choice((1, 1, 40, 3000)), i % 2, i % 7 == 0) for i, s in enumerate(starts)]
    seen = [(i, 1, p, p + r.choice((1, 500))) for i in range(400) for p in (r.randrange(8000) for _ in range(3))]
    b, o = spark.createDataFrame(ends, "id long, chrom long, start long, end long, dir int, is_indel boolean"), spark.createDataFrame(seen, "id long, chrom long, start long, end long")
    found = cluster.neighbour_pairs(b, o, 5000)
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("_b#" in j or "bucket" in j for j in joins)
    assert sorted(map(tuple, found.select("id", "next_id", "fit").collect())) == brute(ends, seen, 5000)
