"""CIGARs are filtered by identity once: in one step of ``discover``, and each part of the share counted once."""

from pyspark.sql import functions as F

from strandline.functions import cigar
from strandline.plans import pipelines
from strandline.settings import DiscoverSettings


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_share_is_counted_once(spark):
    df = spark.createDataFrame([("10=2X3D5=",), ("5S",), (None,), ("",), ("3I7=",)], "c string")
    found = df.select(cigar.text_identity(F.col("c")).alias("i"))
    assert plan(found).split("Project")[1].count("regexp") == 3
    assert [r["i"] for r in found.collect()] == [15 / 18, None, None, None, 7 / 8]


def test_discover_filters_reads_once(spark, monkeypatch):
    plans = []
    for name in ("settle", "stored"):
        real = getattr(pipelines, name)
        monkeypatch.setattr(pipelines, name, lambda df, real=real: (plans.append(df._jdf.queryExecution().analyzed().toString()), real(df))[1])
    rows = [(s, 10 * i + s, 0, 0, 1000 + i % 3, 1300 + i % 3, 0, 60, 0, "150=60D90=" if i % 2 else "150=60I90=", "A" * 10) for i in range(12) for s in range(2)]
    reads = spark.createDataFrame(rows, "sample long, qname long, seg long, chrom long, start long, end long, strand long, mapq long, flag long, cigar string, seq string")
    found = pipelines.discover(reads, settings=DiscoverSettings(disable_cnv=True))
    assert found["clusters"].count() > 0
    assert sum("regexp_count" in p for p in plans) == 1
