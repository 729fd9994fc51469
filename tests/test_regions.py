"""Tables clustered by bin: what regions read is right, and the rest isn't read."""

import random

import pytest

from strandline.operators import interval_join
from strandline.sources import regions

SCHEMA = "id long, chrom string, start long, end long"


def rows_of(n):
    r = random.Random(3)
    out = [(i, f"c{i % 5}", s, s + (r.choice((0, 100, 5000, 200_000)) if i % 400 else 90_000_000)) for i in range(n) for s in [r.randrange(700_000_000)]]
    return out + [(n, None, 5, 9), (n + 1, "c1", None, 9), (n + 2, "c1", 5, None), (n + 3, "c1", 5, 9)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("regions") / "t"), rows_of(20_000)
    regions.write_indexed(spark.createDataFrame(rows, SCHEMA).repartition(6), path, row_group=1 << 16)
    return path, rows


WANTED = [("c1", 0, 10), ("c1", 67_108_000, 67_110_000), ("c2", 300_000_000, 301_000_000), ("c4", 100_000_000, 400_000_000), ("c9", 0, 10**9), ("c3", 7, 7)]


def brute(rows, wanted):
    return sorted(i for i, c, s, e in rows if s is not None and e is not None and s < e and any(c == k and s < b and e > a and a < b for k, a, b in wanted))


def test_rows_of_regions(spark, table):
    path, rows = table
    found = regions.read_regions(spark, path, WANTED)
    assert set(found.columns) == {"id", "chrom", "start", "end"}
    assert sorted(r["id"] for r in found.collect()) == brute(rows, WANTED) != []
    many = spark.createDataFrame(WANTED, "chrom string, start long, end long")
    assert sorted(r["id"] for r in regions.reads_of_regions(spark, path, many, ["id"]).collect()) == brute(rows, WANTED)
    whole = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["id"] for r in interval_join.interval_semi(whole, many, ["id"]).collect()) == brute(rows, WANTED)
    assert spark.read.parquet(path).count() == len(rows)
    assert regions.read_regions(spark, path, []).count() == 0


def test_the_rest_is_not_read(spark, table):
    path, rows = table
    wanted = [("c2", 300_000_000, 300_500_000)]
    found = regions.read_regions(spark, path, wanted)
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    metric = lambda name: scan.metrics().apply(name).value()
    assert metric("numFiles") <= len(spark.read.parquet(path).inputFiles()) / 8
    assert metric("numOutputRows") < len(rows) / 8
    plan = found._jdf.queryExecution().toString()
    partition, pushed = plan.split("PartitionFilters")[1].split("PushedFilters")[:2]
    assert "slot" in partition and "bin" in pushed and "chrom" in pushed


def test_defined_cases(spark, tmp_path):
    path = str(tmp_path / "t")
    regions.write_indexed(spark.createDataFrame([], SCHEMA), path)
    with pytest.raises(ValueError):
        regions.write_indexed(spark.createDataFrame([(1, 2, 3, 4)], "chrom long, start long, end long, bin long"), str(tmp_path / "u"))
    with pytest.raises(ValueError):
        regions.read_regions(spark, path, [("c1", 0, 1)] * (regions.MOST_REGIONS + 1))
