"""Functions over runs go through them once: each step of a fold is interpreted, so a second pass costs as much as the first."""

from pyspark.sql import functions as F

from strandline.functions import cigar
from strandline.plans import alignment_queries


def steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(")


def test_passes(spark, sf_dir):
    """The clips had 18 lambdas."""
    assert steps(alignment_queries.clipped_edges(spark, sf_dir)) <= 9
    assert steps(alignment_queries.closest_position(spark, sf_dir)) <= 5


def test_results(spark):
    rows = [("5S10=3D10=2I10=4S", 100, 111), ("10=3D10=", 0, -1), ("10=3D10=", 0, 500), ("4H3S2I", 5, 5), ("*", 5, 5), (None, 5, 5), ("5=0X5=", 10, 15), ("5=", None, 3), ("5=", 3, None)]
    df = spark.createDataFrame(rows, "text string, pos long, at long").withColumn("runs", cigar.parse(F.col("text")))
    near = lambda first: cigar.closest_read_position(F.col("runs"), F.col("pos"), F.col("at"), first)
    found = [tuple(x) for x in df.select(near(True), near(False)).collect()]
    assert found == [(14, 15), (None, 0), (19, None), (None, None), (None, None), (None, None), (5, 5), (None, None), (None, None)]
    joined = spark.range(1).select(cigar.render(cigar.compress(cigar.parse(F.lit("0S3=4=0I2X0D1X5S")))), cigar.render(cigar.compress(cigar.parse(F.lit("*"))))).first()
    assert tuple(joined) == ("7=3X5S", "")
