"""Final records: order, duplicates, merged copy-number rows, accuracy by size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_order(records: DataFrame) -> DataFrame:
    """By chromosome, position, inversions first, id."""
    return records.orderBy("chrom", "pos", F.desc("is_inversion"), "id")


def dedup(records: DataFrame, same: Sequence[str]) -> DataFrame:
    """Of records that agree in ``same`` (nulls equal), the first in order."""
    first = Window.partitionBy(*same).orderBy(F.desc("is_inversion"), "id")
    return records.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def merge_equal_segments(segments: DataFrame) -> DataFrame:
    """segments (sample, chrom, start, end, copies, expected) that agree in place: the samples below and above, the type."""
    from ..functions.variants import cnv_type

    below, above = F.count_if(F.col("copies") < F.col("expected")), F.count_if(F.col("copies") > F.col("expected"))
    rows = segments.groupBy("chrom", "start", "end").agg(below.alias("below"), above.alias("above"), F.max("sample").alias("base_sample"))
    return rows.withColumn("type", cnv_type(F.col("below"), F.col("above"))).filter("type is not null")


SIZE_BINS = (500, 5000)


def size_bin(size):
    out = F.lit(f"{SIZE_BINS[-1]}+")
    for low, high in reversed(list(zip((0, *SIZE_BINS), SIZE_BINS))):
        out = F.when((size >= low) & (size < high), f"{low}-{high}").otherwise(out)
    return out


def accuracy(calls: DataFrame) -> DataFrame:
    """calls (label TP, FP or FN, size, type): counts, recall, precision and F1 by type and size bin; null where undefined."""
    count = lambda label: F.count_if(F.col("label") == label)
    sums = calls.withColumn("size_bin", size_bin(F.col("size"))).groupBy("type", "size_bin").agg(count("TP").alias("tp"), count("FP").alias("fp"), count("FN").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"recall": F.try_divide(tp, tp + fn), "precision": F.try_divide(tp, tp + fp), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)})
